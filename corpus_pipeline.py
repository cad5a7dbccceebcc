"""The corpus pipeline: language identification, line dedup, Jaccard join, decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents. A stage begins with
JVMs that have handed back what the one before it left, since its Python workers share their executors' memory. Language profiles
and packing can't be said in SQL, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, rested, saved, small, unused
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import groups
from tessera.llm.language_id import UND, learn, predict, trained_on
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.op7 import vocabulary
from tessera.llm.packing import pack

#: Documents whose best profile agrees less than this are in none of the languages.
LEAST_SCORE = 0.15


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those with these ids: the ids that go are few beside the texts that stay, and are sent out if a count shows it."""
    return docs.join(small(saved(ids.where("doc_id is not null").distinct(), "gone-ids")), "doc_id", "left_anti").select(*_columns(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learnt language, go. What columns docs has has no bearing on it."""
    rested(spark)
    names = unused(docs.columns, "lang_pred", "score")
    rows = predict(docs, learn(trained_on(docs)), more=tuple(docs.columns), names=tuple(names))
    return rows.where((F.col(names[0]) != UND) & (F.col(names[1]) >= LEAST_SCORE)).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of lines, short ones' exact copies among them, the first occurrence stays. Documents of which nothing is left go; n_chars follows the text."""
    rested(spark)
    counts = unused(docs.columns, "n_lines", "n_removed")
    out = dedup_lines(docs, short=True, counts=tuple(counts))
    fewer = F.col(counts[1]) > 0
    out = out.where(~fewer | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(fewer, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*_columns(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies stays."""
    rested(spark)
    found = groups(docs)
    return _without(docs, found.where("doc_id != component_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    rested(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rested(spark)
    return pack(docs, vocabulary)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. A stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
