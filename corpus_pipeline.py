"""A training-data pipeline of five operators; each stage's result is written and read by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.minhash_dedup import near_duplicates
from graphloom.llm.ngram_leaks import find_leaks
from graphloom.llm.source_mix import mix_sources, texts_taken
from graphloom.llm.substrings import dedup_byte_strings
from graphloom.llm.toxicity import fit, grade_toxicity, labelled_sample
from graphloom.plans.materialize import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a grade over 0 go.  The model is fitted on the labelled documents among ``docs``.

    Rows are judged each for itself; null and empty texts have nothing toxic and stay.  Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    model = fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade_toxicity(docs, model, carry=COLUMNS).where("not toxic").select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the least id stays.

    Rows that share an id stay or go together.  Null and empty texts are copies of nothing and stay.  A row with a null
    id counts for itself and comes after all others: it goes if it is a near copy of a row with an id, and of near copies
    that have no id one stays.  Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    # ids of their own beyond the largest one for rows that have none, fixed by being written
    nameless = materialize(docs.where("doc_id is null").withColumn("_own", F.monotonically_increasing_id()), "nameless")
    if not nameless.head(1):
        kept = near_duplicates(docs, width=5, similarity=80).where("kept").select(F.col("doc_id").alias("_own")).distinct()
        return docs.join(kept, F.col("doc_id") == F.col("_own"), "left_semi").select(*COLUMNS)
    beyond = (docs.agg(F.max("doc_id")).head()[0] or 0) + 1
    named = docs.where("doc_id is not null").withColumn("_own", F.col("doc_id"))
    rows = named.unionByName(nameless.withColumn("_own", F.col("_own") + beyond))
    kept = near_duplicates(rows, "_own", width=5, similarity=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return rows.join(kept, F.col("_own") == F.col("_kept"), "left_semi").select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice are cut out.

    A cut may fall inside a character; what is left of it goes as well.  Documents with nothing left go, those that
    were null or empty before stay as they are.  Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    done = dedup_byte_strings(docs.withColumn("_none", F.col("text").isNull()), carry=("lang", "source", "n_chars", "_none"), whole_characters=True)
    cut, kept = F.col("n_removed") > 0, F.col("kept").cast("string")
    left = done.where((F.length("kept") > 0) | (F.col("n_bytes") == 0))
    return left.select("doc_id", F.when(~F.col("row._none"), kept).alias("text"), "row.lang", "row.source", F.when(cut, F.length(kept)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of ten consecutive benchmark words, or of a whole shorter item, go.

    Null and empty texts hold none and stay.  Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark, carry=COLUMNS).where(F.size("spans") == 0).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the pieces of them that a mixture of the sources takes, by slot, and their words in all.

    Columns are those of ``texts_taken``.  Documents without words are kept and nothing is taken of them.
    """
    docs = docs.select(*COLUMNS)
    return texts_taken(mix_sources(docs), docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_dedup", minhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Fitted weights, 200-byte strings and the mixture's schedule are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
