"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each result to the shared folder and reads it back for the next stage, so a
lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import contamination, line_dedup, mixing, ngram_join, quality_rules
from ledgerloom.llm.bitmap import bitmap, may_hold
from ledgerloom.llm.text import saved
from ledgerloom.session import configure

def _named(docs: DataFrame) -> DataFrame:
    """Each row under its id and the hash of its text; rows equal in both are judged alike."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs["doc_id"].alias("doc_id"),
                       F.xxhash64(docs["text"]).alias("copy"))


def _split(spark: SparkSession, docs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that cannot be among ``names`` (doc_id, copy), unshuffled, and the few that may."""
    rows = _named(docs)
    maybe = may_hold(bitmap(spark, names, "doc_id", "copy"), F.col("doc_id"), F.col("copy"))
    return rows.filter(~maybe), rows.filter(maybe)


def _without(spark: SparkSession, docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """All rows but those named in ``rejected``."""
    clean, maybe = _split(spark, docs, rejected)
    same = maybe["doc_id"].eqNullSafe(rejected["doc_id"]) & (maybe["copy"] == rejected["copy"])
    return clean.select("doc.*").unionByName(maybe.join(rejected, same, "left_anti").select("doc.*"))


def _once(spark: SparkSession, docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each name in ``repeated``, and all other rows."""
    single, maybe = _split(spark, docs, repeated)
    same = maybe["doc_id"].eqNullSafe(repeated["doc_id"]) & (maybe["copy"] == repeated["copy"])
    once = maybe.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "copy"])
    return (single.unionByName(maybe.join(repeated, same, "left_anti")).unionByName(once)).select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.judge(spark, docs)
    return _without(spark, docs, saved(judged.filter("not kept").select("doc_id", "copy").distinct(), spark, "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in an earlier one; a document that loses all its lines goes."""
    cleaned = line_dedup.dedup_lines(spark, docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
               .otherwise(F.col("doc.n_chars")).alias("n_chars")}
    return cleaned.select(*(changed.get(c, F.col("doc").getField(c).alias(c)) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null last), then the smallest hash of its text."""
    grouped = saved(ngram_join.group(spark, docs).filter("n_shingles > 0"), spark, "groups")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")
    best = grouped.groupBy("root").agg(F.min(name).alias("best"))
    judged = grouped.join(best, "root")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("copy") == F.col("best.copy"))
    rejected = saved(judged.filter(~first).select("doc_id", "copy").distinct(), spark, "rejected")
    repeated = saved(judged.filter(first).groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                     .select("doc_id", "copy"), spark, "repeated")
    return _once(spark, _without(spark, docs, rejected), repeated)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = contamination.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(spark, docs, saved(found.filter("contaminated").select("doc_id", "copy").distinct(), spark, "rejected"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document that it takes words of, how many, repeats counted."""
    return mixing.mix(spark, docs).filter("taken > 0")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies),
          ("benchmark decontamination", decontaminated), ("mixing to weights", mixed)]

# The n-gram join's groups need a recursion over candidate links of all documents; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), spark, f"stage-{number + 1}")
    return docs
