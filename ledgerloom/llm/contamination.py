"""Benchmark decontamination with a positional inverted index.

The documents are read once: every word that also occurs in a test item is stored as a
posting (document, position, term). A window of an item is looked up like a phrase: the
list of its rarest term gives the possible places, each further term (next rarest first) is
intersected at its own offset, and what is left after the last term is an exact occurrence.
The first terms of a window are few, so the long lists of common terms are read only for the
documents that survived the rare ones.

A proximity match allows for a word that was put in, dropped, changed or moved: seen from one of the window's rarest terms (one more
of them than may be missing, so that a match always has one), all other terms but ``MISSING`` stand at most ``SLACK`` words
from their places. It uses the same lists in the same order: the rare ones first, then those of the documents that are left.
Windows of fewer than ``LEAST_NEAR`` words are only looked up exactly. Exact matches are proximity matches too.

The planner chooses between broadcast and shuffle from the stored sizes of the
test terms, anchors and survivors; nothing is broadcast by hint.

Defined results: null text has no words; documents without words are not
contaminated; items without words have no windows; copies of an item (same id and
text) count once; rows of documents with the same id and text get the same result; an
empty table on either side gives no hits. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.text import letter_words, lower_az, saved

WINDOW = 10
SLACK = 2
MISSING = 1
LEAST_NEAR = 5
RARE_TERMS = 3  # intersected one by one over the lists of rare terms alone
END = ""  # no word is empty: this posting ends each document and its position is the number of words
DOC = ("doc_id", "copy")  # a document row's id and the hash of its text


def words_of(text: Column) -> Column:
    return letter_words(lower_az(text))


def item_windows(items: DataFrame, item_col: str, text_col: str, length: int) -> DataFrame:
    """One row per distinct window text of an item: item_id, window (words of it in order)."""
    words = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    return (words.select("item_id", "words", F.explode(starts).alias("at"))
            .select("item_id", F.slice("words", F.col("at"), F.lit(length)).alias("window")).distinct())


def index(spark: SparkSession, docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings of the given terms and of the end of each document, written without a shuffle."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("copy"),
                        F.posexplode(F.concat(words_of(F.col(text_col)), F.array(F.lit(END)))).alias("at", "word"))
    return saved(words.join(terms, "word").select("doc_id", "copy", "at", "term"), spark, "postings")


def _same_doc(left: str, right: str) -> Column:
    return (F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))
            & (F.col(f"{left}.copy") == F.col(f"{right}.copy")))


def ranked_terms(spark: SparkSession, postings: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows``, one row per (window_id, offset, term), with the rank of each term in its window, the rarest first."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = Window.partitionBy("window_id").orderBy("n", "offset")
    return saved(windows.alias("w").join(counts.alias("c"), "term", "left").select(
        "window_id", "offset", "term", "length", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("rank", F.row_number().over(by_rarity)), spark, "ranked-terms")


def phrase_places(spark: SparkSession, postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every exact occurrence of a window of ranked terms: doc, start, window_id, length."""
    anchors = saved(ranked.filter("rank = 1").select("window_id", "length", "offset", "term").coalesce(1), spark, "anchors")
    found = postings.join(anchors, "term").select(
        *DOC, (F.col("at") - F.col("offset")).alias("start"), "window_id", "length").filter("start >= 0")
    rare = saved(ranked.filter((F.col("rank") > 1) & (F.col("rank") <= RARE_TERMS)).select("term").distinct()
                 .coalesce(1), spark, "rare-terms")
    rare_lists = postings.join(rare, "term", "left_semi")
    for rank in range(2, RARE_TERMS + 1):
        nth = ranked.filter(F.col("rank") == rank).select("window_id", "term", "offset")
        wanted = found.join(nth, "window_id").filter(F.col("length") >= rank).select(
            *DOC, (F.col("start") + F.col("offset")).alias("at"), "term", "start", "window_id", "length")
        short = found.filter(F.col("length") < rank)
        found = wanted.alias("f").join(
            rare_lists.alias("p"), _same_doc("f", "p") & (F.col("f.at") == F.col("p.at")) & (F.col("f.term") == F.col("p.term")),
            "left_semi").select(*DOC, "start", "window_id", "length").unionByName(short)
    found = saved(found.distinct(), spark, "rare-places")

    # The rest of the terms at once: all of them must stand at their offsets.
    survivors = saved(found.select(*DOC).distinct(), spark, "survivors")
    lists = postings.alias("p").join(survivors.alias("s"), _same_doc("p", "s"), "left_semi").select("p.*")
    rest = found.join(ranked.filter(F.col("rank") > RARE_TERMS).select("window_id", "term", "offset"), "window_id").select(
        *DOC, (F.col("start") + F.col("offset")).alias("at"), "term", "start", "window_id", "length")
    matched = rest.alias("f").join(
        lists.alias("p"), _same_doc("f", "p") & (F.col("f.at") == F.col("p.at")) & (F.col("f.term") == F.col("p.term")),
        "left_semi").groupBy(*DOC, "start", "window_id", "length").agg(F.count(F.lit(1)).alias("n"))
    return (matched.filter(F.col("n") == F.col("length") - RARE_TERMS).drop("n")
            .unionByName(found.filter(F.col("length") <= RARE_TERMS)))


def near_places(spark: SparkSession, postings: DataFrame, ranked: DataFrame, *, slack: int = SLACK, missing: int = MISSING) -> DataFrame:
    """Every proximity match of a window: doc, start (may be a little before the text), window_id, length, n_terms (of the window, near their places)."""
    ranked = ranked.filter(F.col("length") >= max(LEAST_NEAR, RARE_TERMS + missing + 1))
    place = [*DOC, "start", "window_id", "length"]

    def near(found: DataFrame, terms: DataFrame, lists: DataFrame) -> DataFrame:
        shifts = F.explode(F.sequence(F.lit(-slack), F.lit(slack)))
        probes = found.join(terms.select("window_id", "offset", "term"), "window_id").select("*", shifts.alias("shift"))
        probes = probes.withColumn("at", F.col("start") + F.col("offset") + F.col("shift")).filter("at >= 0")
        met = probes.alias("f").join(
            lists.alias("p"), _same_doc("f", "p") & (F.col("f.at") == F.col("p.at")) & (F.col("f.term") == F.col("p.term")), "left_semi")
        return met.select(*found.columns, "offset").distinct().groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))

    anchors = saved(ranked.filter(F.col("rank") <= missing + 1).select("window_id", "length", "offset", "term"), spark, "near-anchors")
    found = postings.join(anchors, "term").select(
        *DOC, (F.col("at") - F.col("offset")).alias("start"), "window_id", "length").distinct()
    rare = saved(ranked.filter(F.col("rank") <= RARE_TERMS).select("term").distinct(), spark, "near-rare-terms")
    found = near(found, ranked.filter(F.col("rank") <= RARE_TERMS), postings.join(rare, "term", "left_semi"))
    found = saved(found.filter(F.col("n") >= RARE_TERMS - missing).withColumnRenamed("n", "n_rare"), spark, "near-rare-places")

    survivors = saved(found.select(*DOC).distinct(), spark, "near-survivors")
    lists = postings.alias("p").join(survivors.alias("s"), _same_doc("p", "s"), "left_semi").select("p.*")
    return (near(found, ranked.filter(F.col("rank") > RARE_TERMS), lists)
            .select(*place, (F.col("n_rare") + F.col("n")).alias("n_terms")).filter(F.col("n_terms") >= F.col("length") - missing))


def _numbered(item_windows_: DataFrame) -> DataFrame:
    """Windows by the hash of their words: the same text in several items is looked up once."""
    return item_windows_.withColumn("window_id", F.xxhash64("window"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, proximity: bool = False) -> DataFrame:
    """For each document: words, words inside windows of items, the items whose windows occur, and the hash of its text (``copy``).

    With ``proximity`` also ``n_near_items``, the number of items with a window that occurs exactly or nearly.
    """
    by_item = saved(_numbered(item_windows(items, item_col, item_text_col, window)), spark, "item-windows")
    distinct_windows = by_item.groupBy("window_id").agg(F.first("window").alias("window"))
    vocabulary = (distinct_windows.select(F.explode("window").alias("word")).distinct()
                  .select("word", F.xxhash64("word").alias("term")))
    end = spark.range(1).select(F.lit(END).alias("word"), F.xxhash64(F.lit(END)).alias("term"))
    terms = saved(vocabulary.unionByName(end).coalesce(1), spark, "test-terms")
    postings = index(spark, docs, terms, id_col, text_col)
    is_end = F.col("term") == F.xxhash64(F.lit(END))
    ends = postings.filter(is_end).select(*DOC, F.col("at").cast("long").alias("n_words"))

    offsets = distinct_windows.select("window_id", F.size("window").alias("length"),
                                      F.posexplode("window").alias("offset", "word"))
    offsets = offsets.select("window_id", "length", "offset", F.xxhash64("word").alias("term"))
    ranked = ranked_terms(spark, postings.filter(~is_end), offsets)
    places = saved(phrase_places(spark, postings.filter(~is_end), ranked), spark, "places")

    hit_words = (places.select(*DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
                 .distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit")))
    hit_items = (places.select(*DOC, "window_id").distinct()
                 .join(by_item.select("window_id", F.col("item_id").cast("string").alias("item_id")), "window_id")
                 .select(*DOC, "item_id").distinct()
                 .groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_items"),
                                    F.sha2(F.array_join(F.sort_array(F.collect_set("item_id")), ","), 256).alias("items_sha256")))
    exact = (ends.alias("e").join(hit_words.alias("h"), _same_doc("e", "h"), "left")
            .join(hit_items.alias("i"), _same_doc("e", "i"), "left").select(
                "e.doc_id", "e.n_words", F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("i.n_items", F.lit(0)).cast("long").alias("n_items"),
                F.coalesce("i.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
                F.col("h.n_hit").isNotNull().alias("contaminated"), "e.copy"))
    if not proximity:
        return exact
    near = (near_places(spark, postings.filter(~is_end), ranked).select(*DOC, "window_id").unionByName(places.select(*DOC, "window_id"))
            .distinct().join(by_item.select("window_id", "item_id"), "window_id").select(*DOC, "item_id").distinct()
            .groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")))
    return exact.alias("e").join(near.alias("n"), _same_doc("e", "n"), "left").select(
        "e.*", F.coalesce("n.n", F.lit(0)).cast("long").alias("n_near_items"))
