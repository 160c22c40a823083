"""How much the sources of a language differ in their terms (op 13).

Tasks count the terms of their documents; counts meet in shards by hash of language and term.  In each shard DuckDB adds
them up, keeps the terms of enough documents, and later sums up what pairs of sources contribute through terms that
both have, and ranks terms.  Spark merges the shards' sums and rankings.

What a pair of sources has from terms that one of them lacks depends on the other's count alone, so it follows from the
number of terms with each count.  Work is thus with the terms that sources have, not with all kept terms for each pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches
from graphloom.plans.materialize import discard, materialize

#: Fixed value: shares are whole billionths, and one more.
SCALE = 1_000_000_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_PARTIAL = "shard long, lang string, source string, term string, n long, documents long"


def terms_of(text: str) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return _TERM.findall(text.encode().lower())


def _count_terms(shards: int, flush_at: int = 200_000, rows_each: int = 20_000):
    """Map side: counts of each group's terms, and in how many documents they are, for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                seed, entries = zlib.crc32(lang.encode()), list(terms.items())
                for i in range(0, len(entries), rows_each):
                    some = entries[i : i + rows_each]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([zlib.crc32(t, seed) % shards for t, _ in some], pa.int64()), pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()),
                            pa.array([t for t, _ in some], pa.binary()).cast(pa.string()), pa.array([c[0] for _, c in some], pa.int64()), pa.array([c[1] for _, c in some], pa.int64()),
                        ],
                        names=["shard", "lang", "source", "term", "n", "documents"],
                    )

        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = held.setdefault((lang, source), {})
                before, get = len(terms), terms.get
                for term, k in Counter(terms_of(text)).items():
                    entry = get(term)
                    if entry is None:
                        terms[term] = [k, 1]
                    else:
                        entry[0] += k
                        entry[1] += 1
                size += len(terms) - before
                if size >= flush_at:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def _duck() -> duckdb.DuckDBPyConnection:
    """A connection for one shard; it never writes to the machine's disk."""
    return duckdb.connect(config={"threads": "1", "temp_directory": "", "preserve_insertion_order": "false"})


def _keep_terms(least: int):
    """A shard: summed counts of the terms that enough documents of the language have; ``head`` marks one row a term."""

    def run(table: pa.Table) -> pa.Table:
        with _duck() as con:
            con.register("part", table)
            return con.sql(
                f"""WITH kept AS (SELECT lang, term FROM part GROUP BY lang, term HAVING sum(documents) >= {least}),
                summed AS (SELECT shard, lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM part SEMI JOIN kept USING (lang, term) GROUP BY ALL)
                SELECT *, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS head FROM summed"""
            ).to_arrow_table()

    return run


def _sum_pairs(ranks: int):
    """A shard: for each pair of sources, by how much terms that both have differ from what their absence would give; and the foremost terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        with _duck() as con:
            con.register("part", table)
            con.execute("CREATE MACRO f(p, q) AS (p - q) * (p - q) // q")
            con.execute(f"CREATE MACRO share(n, size) AS CAST(1 + ({SCALE}::HUGEINT * (n + 1)) // size AS BIGINT)")
            # shares are 10 ** 9 + 1 at most, so their squares are whole BIGINT; sums are HUGEINT
            con.execute(
                """CREATE TABLE k AS SELECT lang, source, term, share(n, total + terms) AS p, share(0, total + terms) AS none,
                share(sum(n) OVER (PARTITION BY lang, term), lang_total + terms) AS q FROM part"""
            )
            return con.sql(
                f"""SELECT 'pair' AS part, a.lang, a.source, b.source AS item,
                  CAST(sum(f(a.p, b.p) - f(a.p, b.none) - f(a.none, b.p) + f(a.none, b.none)) AS DECIMAL(38, 0)) AS value
                FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
                UNION ALL
                SELECT 'term', lang, source, term, CAST(f(p, q) AS DECIMAL(38, 0)) FROM k WHERE p > q
                QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f(p, q) DESC, term) <= {ranks}"""
            ).to_arrow_table()

    return run


def _share(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(10 ** 9 * (n + 1) / (total + terms)), without overflow."""
    wide = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 1), wide(total) + wide(terms))


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}").cast("decimal(38,0)")


def audit_sources(docs: DataFrame, least: int = 3, ranks: int = 200, shard_bytes: int = 16 << 20, least_shards: int = 32) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by what terms.

    Part ``pair``: each other source of the language, all ranks.  Part ``term``: terms more frequent in the source than in
    the language, to rank ``ranks``.  Null text, language and source are empty; rows are documents, so repeated rows
    count as often as they are there.  A source without terms is in pairs like any other; a language without
    kept terms gives pairs of value 0; one with a single source gives no pair.  Other columns are not read.  A table without
    rows gives none.

    A shard stands for about ``shard_bytes`` of text; there are ``least_shards`` at least, whatever the session's number of
    partitions, as each gives its foremost terms and its sums for pairs.  In it a term has a row for each source and each flush of a task.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(least_shards, -(-size // shard_bytes))
    kept = "shard long, lang string, source string, term string, n long, head boolean"
    counts = materialize(docs.mapInArrow(_count_terms(shards), _PARTIAL).groupBy("shard").applyInArrow(_keep_terms(least), kept), "terms")

    # one row for each source of a language: small beside the texts, but not bounded, so Spark chooses how to join it
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left")
    by_lang = by_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    totals = materialize(groups.join(by_lang, "lang", "left").select("lang", "source", *map(zero, ("total", "lang_total", "terms"))), "totals")
    found = materialize(counts.join(totals, ["lang", "source"]).groupBy("shard").applyInArrow(_sum_pairs(ranks), "part string, lang string, source string, item string, value decimal(38,0)"), "shards")

    mine = totals.where("terms > 0").withColumn("none", _share(F.lit(0), "total", "terms"))
    other = mine.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"))
    pairs = mine.join(other, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", (F.col("terms") * _gap("none", "other_none")).cast("decimal(38,0)").alias("value"))
    # terms that one source of a pair has n times and the other may lack
    sizes = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times"))
    alone = sizes.join(pairs, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    more = lambda a, b: (F.col("times") * (a - b)).cast("decimal(38,0)").alias("value")
    here = alone.select("lang", "source", "item", more(_gap("p", "other_none"), _gap("none", "other_none")))
    there = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), more(_gap("other_none", "p"), _gap("other_none", "none")))
    both = found.where("part = 'pair'").select("lang", "source", "item", "value")
    empty = totals.where("terms = 0")
    nothing = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    summed = neither.unionByName(here).unionByName(there).unionByName(both).unionByName(nothing).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = [F.desc("value"), F.asc("item")]
    pair = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).withColumn("part", F.lit("pair"))
    # the foremost of each of 64 slices first, so that the last window holds no more than 64 times the ranks, however many shards there are
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.pmod(F.hash("item"), F.lit(64)).alias("slice"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "slice").orderBy(*order))).where(F.col("rank") <= ranks)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = materialize(pair.select(*columns).unionByName(terms.select(*columns)), "divergence")
    discard(counts, totals, found)
    return out
