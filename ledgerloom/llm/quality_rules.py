"""Quality rules with thresholds that follow the data of each language and source.

One pass over the texts measures every document. Each measure is a whole number
per thousand; its distribution per language and source is kept as a quantile sketch:
counts of buckets whose width is at most 1/32 of their value. Sketches merge by
adding counts, so a source with few documents uses its language's sketch, and a
language with few documents that of all. A document goes if a base rule fails or
a measure lies beyond the fence of its group (the outer quartile plus a multiple of the
spread between the quartiles, or of a least spread where all documents are alike).

Defined results: null text is empty; empty texts have no words and fail the base
rule; null language or source is a value of its own; rows with the same id are
separate rows; an empty table gives no rows. Only the id, text, language and source
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import BLANKS, blank_words, saved, with_windows, word_hashes

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 3  # spreads beyond the quartile
MIN_GROUP = 100  # documents below which a group uses the merged sketch of its parent
# Least spread of each measure, in its own unit (per thousand).
SPREADS = {"symbols": 50, "dup_lines": 200, "repeats": 100, "word_length": 1000}
LOWER = ("word_length",)  # measures that are also fenced below
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(windows: str, ordered: str, length: int) -> Column:
    """Words inside windows that occur twice or more, from (hash, position) pairs in order."""
    n = F.size(ordered) - 1
    starts = F.flatten(F.zip_with(
        F.slice(ordered, F.lit(1), n), F.slice(ordered, F.lit(2), n),
        lambda a, b: F.when(a["hash"] == b["hash"], F.array(a["at"], b["at"])).otherwise(
            F.expr("cast(array() as array<int>)"))))
    starts = F.sort_array(F.array_distinct(starts))
    # Consecutive starts share words; the last window counts whole.
    covered = F.transform(F.array(starts), lambda p: F.aggregate(
        F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1),
                   lambda a, b: F.least(b - a, F.lit(length))),
        F.lit(length), lambda total, gap: total + gap))[0]
    return F.when(F.size(ordered) > 0, covered).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> DataFrame:
    """The measures of each document, in one pass and without a shuffle."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda l: F.length(F.btrim(l, F.lit(BLANKS))) > 0)
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                     F.col(text_col).alias("__text"))
    df = df.select("doc_id", F.xxhash64("__text").alias("copy"), "lang", "source", blank_words(text).alias("__words"), lines.alias("__lines"),
                   F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
                   (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    df = df.select("doc_id", "copy", "lang", "source", F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols",
                   F.size("__lines").cast("long").alias("n_lines"),
                   (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                   word_hashes(F.col("__words")).alias("__hashes"))
    df = with_windows(df, "__hashes", REPEAT_WINDOW, "__windows")
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    df = df.withColumn("__ordered", F.when(repeated, pairs).otherwise(
        F.expr("cast(array() as array<struct<hash: bigint, at: int>>)")))
    return df.select("doc_id", "copy", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                     _repeat_words("__windows", "__ordered", REPEAT_WINDOW).alias("n_repeat_words"))


def _rates() -> dict[str, Column]:
    def per_thousand(part: str, whole: str) -> Column:
        return F.floor(F.col(part) * 1000 / F.col(whole)).cast("long")

    return {"symbols": per_thousand("n_symbols", "n_words"), "dup_lines": per_thousand("n_dup_lines", "n_lines"),
            "repeats": per_thousand("n_repeat_words", "n_words"), "word_length": per_thousand("word_chars", "n_words")}


def _bucket(value: Column) -> Column:
    """The smallest value of the bucket: the five bits after the leading one are kept."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts by language, source and measure. Adding the counts of two sketches merges them."""
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), _bucket(rate).alias("bucket"))
                                for name, rate in _rates().items())))
    return (measured.filter("n_words > 0").select("lang", "source", pairs.alias("p"))
            .groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n")))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sketch.withColumn("upto", upto).withColumn("size", F.sum("n").over(group))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("size").alias("size"),
        F.min(F.when(F.col("upto") * 4 >= F.col("size"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("size") * 3, F.col("bucket"))).alias("q3"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """Lowest and highest accepted rate of every measure, one row per language and source."""
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    overall = _quartiles(sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), [])
    joined = (own.alias("o")
              .join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang"))
                    & (F.col("o.measure") == F.col("l.measure")))
              .join(overall.alias("a"), F.col("o.measure") == F.col("a.measure")))

    def chosen(column: str) -> Column:
        return (F.when(F.col("o.size") >= min_group, F.col(f"o.{column}"))
                .when(F.col("l.size") >= min_group, F.col(f"l.{column}")).otherwise(F.col(f"a.{column}")))

    picked = joined.select("o.lang", "o.source", "o.measure", chosen("q1").alias("q1"), chosen("q3").alias("q3"))
    least = F.element_at(F.create_map(*(F.lit(x) for pair in SPREADS.items() for x in pair)), F.col("measure"))
    reach = F.greatest(F.col("q3") - F.col("q1"), least) * fence
    return picked.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"high_{m}") for m in SPREADS),
        *(F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"low_{m}") for m in LOWER))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judge(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP,
          fence: int = FENCE) -> DataFrame:
    """The measures of each document, ``base_failed`` and ``kept``; ``copy`` is the hash of its text."""
    measured = saved(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col),
                     spark, "quality-measures")
    limits = saved(fences(sketches(measured), min_group, fence), spark, "quality-fences")
    joined = measured.alias("m").join(
        limits.alias("f"), F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")),
        "left")
    rates = _rates()
    beyond = F.lit(False)
    for name in SPREADS:
        beyond = beyond | (rates[name] > F.col(f"f.high_{name}"))
    for name in LOWER:
        beyond = beyond | (rates[name] < F.col(f"f.low_{name}"))
    kept = F.when(base_failed(), F.lit(False)).otherwise(~F.coalesce(beyond, F.lit(False)))
    return joined.select("m.doc_id", *(f"m.{c}" for c in MEASURES), base_failed().alias("base_failed"),
                         kept.alias("kept"), "m.copy")
