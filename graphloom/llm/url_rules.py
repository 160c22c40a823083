"""URL filtering by host and path rules (op 6), with DataFrame expressions only."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/?#]*\.)?{_quote(self.host)}{_quote(self.path)}"

    def tokens(self) -> list[str]:
        """Literal tokens that every URL it fits must have: whole host labels, and path segments that the rule closes."""
        return [f"h:{x}" for x in self.host.split(".")] + [f"p:{x}" for x in self.path.split("/")[:-1] if x]


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\-])", r"\\\1", text)


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, verdict)


def index_rules(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by the one of their tokens that the fewest rules have (the first of these)."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens(), key=lambda t: seen[t]), []).append(r)
    return index


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("x"), F.substr(url, F.instr(url, "://") + 3)), "#", 1))
    host = F.substring_index(F.substring_index(rest, "/", 1), "?", 1)
    return F.coalesce(F.translate(F.substr(host, F.lit(2)), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    return F.coalesce(F.when(F.instr(bare, "/") > 0, F.substr(bare, F.instr(bare, "/"))), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.split(path, "/")
    closed = F.when(F.size(segments) > 1, F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, F.transform(closed, lambda x: F.concat(F.lit("p:"), x))))


def _best(candidates: Column, place: Column) -> Column:
    """The fitting candidate that wins: the longest rule, then the longer host, then block before allow."""
    fits = F.filter(candidates, lambda r: F.rlike(place, r["pattern"]))
    ranked = F.transform(fits, lambda r: F.struct(F.length(r["name"]).alias("size"), F.length(r["host"]).alias("host_size"), r["verdict"].alias("verdict"), r["name"].alias("name")))
    return F.array_max(ranked)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_inline: int = 512) -> DataFrame:
    """Judge each URL: ``page_id, host, path, rule, verdict``, one row per input row.

    Each rule is indexed by its rarest literal token.  The tokens of a URL (host labels, closed path segments)
    fetch candidate rules, and only these are tried as regular expressions; the longest rule that fits wins (on a
    tie the longer host, then block).  Where none fits, ``rule`` is null and the verdict is ``default``.

    Up to ``most_inline`` rules the index is a literal of the plan and rows are judged where they are read, with no
    shuffle.  Larger rule sets become a table that is joined by token; Spark chooses by its size whether to
    broadcast it, and distinct URLs are judged once, so a hot host or URL adds no work.

    A null URL, or one without ``://``, has an empty host and path and fits no rule.  Repeated rows and ids are
    judged each for itself, long URLs are read whole, other columns are not read, empty tables give no rows.
    """
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    place = F.concat(F.col("host"), F.col("path"))
    if not rules:
        best = F.lit(None).cast("struct<size:int,host_size:int,verdict:string,name:string>")
        judged = base.withColumn("best", best)
    elif len(rules) <= most_inline:
        index = index_rules(rules)
        literal = F.create_map(*[x for token, found in index.items() for x in (F.lit(token), F.array(*[_struct(r) for r in found]))])
        hits = F.filter(F.transform(_tokens(F.col("host"), F.col("path")), lambda t: F.element_at(literal, t)), lambda x: x.isNotNull())
        judged = base.withColumn("best", _best(F.flatten(hits), place))
    else:
        spark = pages.sparkSession
        rows = [(token, r.pattern, r.name, r.host, r.verdict) for token, found in index_rules(rules).items() for r in found]
        table = spark.createDataFrame(rows, "token string, pattern string, name string, host_ string, verdict string")
        urls = base.select("host", "path").distinct().select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
        fits = urls.join(table, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
        rank = F.struct(F.length("name").alias("size"), F.length("host_").alias("host_size"), "verdict", "name")
        best = fits.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max(rank).alias("best"))
        judged = base.join(best, (base["host"] == best["_h"]) & (base["path"] == best["_p"]), "left")
    return judged.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.name).alias("name"), F.lit(r.host).alias("host"), F.lit(r.verdict).alias("verdict"))
