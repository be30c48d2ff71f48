"""Exact Jaccard join of 5-word shingle sets in metric space, and the groups that its links form.

First, sets without a chance go: the shingles with small hashes are the same sample for every set, and a set
with too many of them in no other set cannot have a link. What is left is joined whole.

1 - Jaccard is a metric. Documents with equal sets are one point. A linked pair always shares one of the
first shingles of both sets (a fifth of each, in a common order, rarest first), so a pivot is chosen for
each such shingle and draws the points that hold it: linked points always share a pivot's region. A
region compares its points with the pivot alone. Points within the radius of the pivot are linked to it, and
so to each other: the pivot takes them. The others still seek; they, and the taken points that the triangle inequality
leaves within reach of a seeker or of a point that another pivot took, form the next region with a new pivot. After a few
levels, or when none seeks, the points that are left and are not yet in one group are compared within their windows of
distance from each pivot of their region. No group is lost: pairs that are not compared are either too far apart by the
triangle inequality or by their parities, or in one group already. Parities: a set's shingles are dealt to 1,024 places by hash, and each
place says whether it has an odd number of them. Two sets differ in at least as many shingles as their parities do in places.

The order of shingles comes from counts over all those sets in 262,144 buckets, a table of fixed size; any order gives
the same links, a good one keeps frequent shingles out of the prefixes. Shingles are 64-bit hashes.

Defined results: null text and texts without words have an empty set and are linked with nothing; fewer than five
words are one shingle; copies are in one group; a null id counts as larger than any other and names no
group unless all its ids are null; rows with the same id are separate rows; an empty table gives no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bitmap import bitmap, may_hold
from ledgerloom.llm.components import components
from ledgerloom.llm.rolling import Runs, list_parts, slices
from ledgerloom.llm.text import Tables, blank_words, lower_az, saved, word_hashes

SHINGLE = 5
PERCENT = 80
LEVELS = 3
SAMPLE = 0.3  # share of the hash range that every set is sampled from; more than the share a linked set may lack
SAMPLE_ROUNDS = 3  # the samples are dealt by shingle in so many parts, one after the other, as they are the largest shuffle
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
LAST_ID = (1 << 63) - 1
RADIUS = 1 - PERCENT / 100
PLACES = 1024  # of a set's parities
SLACK = 1e-9  # windows are compared in floating point, links in whole numbers


def _sets(words: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct shingles of each row; a row without words has none."""
    for first, last in slices(offsets):
        base = offsets[first]
        runs = Runs(np.ascontiguousarray(words[base: offsets[last]]))
        for row in range(first, last):
            start, stop = offsets[row] - base, offsets[row + 1] - base
            if stop == start:
                yield row, np.zeros(0, np.uint64)
            else:
                at = np.arange(start, max(stop - shingle, start) + 1)
                yield row, np.unique(runs.hashes(at, np.minimum(at + shingle, stop)))


def _ordered(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set as sorted numbers in the common order: rank of the bucket, then the rest of the hash; 63 bits, so that signed order is the same."""
    bucket = (found & np.uint64(BUCKETS - 1)).astype(np.int64)
    return np.sort((ranks[bucket] << np.uint64(63 - BUCKET_BITS)) | (found >> np.uint64(BUCKET_BITS + 1)))


def _digest(found: np.ndarray) -> int:
    """Of the set, not of its order; 64 bits."""
    if not len(found):
        return 0
    folded = found * (found >> np.uint64(7) | np.uint64(1))
    return int((found.sum() ^ (folded.sum() << np.uint64(1)) ^ np.bitwise_xor.reduce(folded >> np.uint64(3))).astype(np.int64))


def _lists(columns: dict[str, pa.Array], name: str, lists: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    values = pa.array(np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64))
    columns[name] = pa.ListArray.from_arrays(pa.array(lengths.astype(np.int32)), values)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _parities(found: np.ndarray) -> np.ndarray:
    """Of each place, whether an odd number of shingles falls into it; 64 places a number. The samples and buckets use other bits of the hash."""
    places = (found >> np.uint64(24)) & np.uint64(PLACES - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=PLACES) & 1).view(np.uint64)


def _samples(batches: Iterator[pa.RecordBatch], shingle: int, below: int) -> Iterator[pa.RecordBatch]:
    """Size, digest and the shingles with small hashes of each row's set."""
    for batch in batches:
        n, digests, samples = [], [], []
        for _, found in _sets(*list_parts(batch.column(2)), shingle):
            n.append(len(found))
            digests.append(_digest(found))
            samples.append(found[: np.searchsorted(found, np.uint64(below))])
        yield _lists({"id": batch.column(0), "copy": batch.column(1), "n": pa.array(n, pa.int64()), "point": pa.array(digests, pa.int64())}, "sample", samples)


def _whole_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points, parities, sets = [], [], []
        for _, found in _sets(*list_parts(batch.column(0)), shingle):
            points.append(_digest(found))
            parities.append(_parities(found).view(np.int64))
            sets.append(found)
        yield _lists({"point": pa.array(points, pa.int64()), "odd": pa.array(parities, pa.list_(pa.int64()))}, "set", sets)


def _prefixes(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = list_parts(batch.column(1))
        prefixes = []
        for start, stop in zip(offsets, offsets[1:]):
            ordered = _ordered(values[start:stop].view(np.uint64), ranks)
            prefixes.append(ordered[: _may_miss(len(ordered), percent) + 1])
        yield _lists({"point": batch.column(0)}, "prefix", prefixes)


def _may_miss(n: int, percent: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add shared shingles and distance to pairs (point, other)."""
    other = sets.select(F.col("point").alias("other"), F.col("set").alias("other_set"))
    both = pairs.join(sets, "point").join(other, "other")
    shared = F.size(F.array_intersect("set", "other_set"))
    union = F.size("set") + F.size("other_set") - shared
    return (both.select(*pairs.columns, shared.alias("shared"), union.alias("union"))
            .withColumn("distance", 1 - F.col("shared") / F.col("union")))


def _linked(percent: int) -> Column:
    return F.col("shared") * 100 >= F.col("union") * percent


def _pivot_links(tables: Tables, sets_of: DataFrame, shared: DataFrame, percent: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to pivots, and what the levels leave: points of a region, with their distances from its pivots.

    ``shared`` has the shingles (key) that two or more points hold in their prefix.
    """
    central = shared.groupBy("point").agg(F.sum("holders").alias("central"))
    drawn = shared.select("key", "point").join(central, "point")
    pivots = drawn.groupBy("key").agg(F.max(F.struct("central", "point"))["point"].alias("pivot"))
    # ``taker`` is the pivot that a point was first linked to; a point without one seeks.
    state = tables.saved(drawn.join(pivots, "key").filter("point <> pivot").select(
        F.col("pivot").alias("region"), "pivot", "point", "central", F.lit(None).cast("long").alias("taker"),
        F.lit(None).cast("array<double>").alias("distances")).distinct(), "regions")
    found, left = [], []
    seeks = F.col("taker").isNull()
    for level in range(levels):
        pairs = state.filter("point <> pivot").select("region", F.col("pivot").alias("other"), "point", "central", "taker", "distances")
        measured = tables.saved(_measured(pairs, sets_of), "distances")
        found.append(measured.filter(_linked(percent)).select(F.col("point").alias("a"), F.col("other").alias("b")))
        judged = measured.withColumns({
            "taker": F.coalesce("taker", F.when(_linked(percent), F.col("other"))),
            "distances": F.concat(F.coalesce("distances", F.expr("cast(array() as array<double>)")), F.array("distance"))})
        # A region has at most one class for each level and one of seekers.
        classes = judged.groupBy("region", "taker").agg(
            F.min("distance").alias("low"), F.max("distance").alias("high"),
            F.max(F.when(seeks, F.struct("central", "point"))).alias("next"))
        reach = classes.groupBy("region").agg(
            F.collect_list(F.struct("taker", "low", "high")).alias("classes"), F.max("next")["point"].alias("pivot"))
        within = F.exists("classes", lambda c: (seeks | c["taker"].isNull() | (c["taker"] != F.col("taker")))
                          & F.col("distance").between(c["low"] - RADIUS - SLACK, c["high"] + RADIUS + SLACK))
        state = tables.saved(judged.join(reach, "region").filter(within).select(
            "region", "pivot", "point", "central", "taker", "distances"), "regions")
        left.append(state.filter("pivot is null") if level < levels - 1 else state)
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, left)


def _rest_links(tables: Tables, state: DataFrame, points: DataFrame, labels: DataFrame, sets_of: DataFrame,
                prefixes: DataFrame, percent: int) -> DataFrame:
    """Links between the points that the levels leave in a region, where they join different components.

    Before whole sets are compared, the shingles that two prefixes share must allow the similarity: beyond
    the prefixes, the sets have at most the rest of the larger one in common.
    """
    size = points.select("point", "n").join(sets_of.select("point", "odd"), "point")
    labelled = tables.saved(state.select("region", "point", "distances").join(size, "point")
                     .join(labels.withColumnRenamed("node", "point"), "point", "left")
                     .withColumn("component", F.coalesce("component", "point")), "rest-points")
    several = (labelled.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y"))
               .filter("x <> y").select("region"))
    labelled = labelled.join(several, "region")
    others = labelled.select("region", F.col("point").alias("other"), F.col("distances").alias("other_distances"),
                             F.col("component").alias("other_component"), F.col("n").alias("m"), F.col("odd").alias("other_odd"))
    apart = (F.col("component") != F.col("other_component")) & (F.col("point") < F.col("other"))
    near = F.forall(F.zip_with("distances", "other_distances", lambda x, y: F.abs(x - y)), lambda d: d <= RADIUS + SLACK)
    alike = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    enough = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    places = reduce(Column.__add__, (F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("other_odd", F.lit(i)))) for i in range(PLACES // 64)))
    few = places <= F.col("n") + F.col("m") - 2 * enough
    pairs = labelled.join(others, "region").filter(apart & alike & near & few).select("point", "other", "n", "m").distinct()
    both = pairs.join(prefixes, "point").join(
        prefixes.select(F.col("point").alias("other"), F.col("prefix").alias("other_prefix")), "other")
    # Common shingles beyond the end of the prefix that ends first are all in the rest of that set.
    ends_first = F.element_at("prefix", -1) <= F.element_at("other_prefix", -1)
    beyond = F.when(ends_first, F.col("n") - F.size("prefix")).otherwise(F.col("m") - F.size("other_prefix"))
    likely = both.filter(F.size(F.array_intersect("prefix", "other_prefix")) + beyond >= enough).select("point", "other")
    return _measured(likely, sets_of).filter(_linked(percent)).select(F.col("point").alias("a"), F.col("other").alias("b"))


def group(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          percent: int = PERCENT, levels: int = LEVELS) -> DataFrame:
    """For each document: the size of its set, its group's smallest id, the links to other sets that were found on the way,
    the hash of its text (``copy``), and the group itself (``root``, null for an empty set): groups may show the same id."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    words = word_hashes(blank_words(lower_az(F.col("text")))).alias("words")
    tables = Tables(spark)
    below = int(SAMPLE * 2**64)
    samples = tables.saved(texts.select("id", F.xxhash64("text").alias("copy"), words).mapInArrow(
        lambda it: _samples(it, shingle, below), "id long, copy long, n long, point long, sample array<long>"), "set-samples")
    filled = samples.filter("n > 0")
    points = saved(filled.groupBy("point").agg(F.min("id").alias("id"), F.max("n").alias("n")), spark, "points")

    # A linked set holds all but a few of a point's shingles, so a point with more lonely ones in its sample has no link.
    held = filled.select("point", F.explode("sample").alias("key"))
    rounds = [saved(held.filter(F.pmod("key", F.lit(SAMPLE_ROUNDS)) == part).groupBy("key")
                    .agg(F.min("point").alias("point"), F.max("point").alias("other")).filter("point = other")
                    .groupBy("point").agg(F.count(F.lit(1)).alias("lonely")), spark, "lonely") for part in range(SAMPLE_ROUNDS)]
    lonely = reduce(DataFrame.unionByName, rounds).groupBy("point").agg(F.sum("lonely").alias("lonely"))
    sets = saved(samples.drop("sample"), spark, "set-points")
    tables.empty(samples)
    may_miss = F.col("n") - F.ceil(F.col("n") * percent / 100)
    alive = saved(points.join(lonely, "point", "left").filter(F.coalesce("lonely", F.lit(0)) <= may_miss)
                  .select("point", "id"), spark, "alive-points")
    whole = tables.saved(texts.filter(may_hold(bitmap(spark, alive, "id"), F.col("id"))).select(words)
                  .mapInArrow(lambda it: _whole_sets(it, shingle), "point long, odd array<long>, set array<long>")
                  .join(alive.select("point"), "point", "left_semi").dropDuplicates(["point"]), "whole-sets")

    counts = (whole.select(F.explode("set").alias("shingle")).groupBy(F.col("shingle").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
              .toArrow().sort_by([("n", "ascending"), ("bucket", "ascending")]))
    ranks = np.zeros(BUCKETS, np.uint64)
    ranks[counts["bucket"].to_numpy()] = np.arange(len(counts), dtype=np.uint64)
    # One exchange by shingle serves the count and the join.
    prefixes = tables.saved(whole.select("point", "set").mapInArrow(lambda it: _prefixes(it, ranks, percent), "point long, prefix array<long>"), "prefixes")
    entries = (prefixes.select("point", F.explode("prefix").alias("key")).repartition("key"))
    holders = entries.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    shared = tables.saved(entries.join(holders, "key"), "shared-shingles")
    links, left = _pivot_links(tables, whole, shared, percent, levels)
    links = saved(links, spark, "pivot-links")
    labels = saved(components(spark, links), spark, "components")
    rest = saved(_rest_links(tables, left, points, labels, whole, prefixes, percent), spark, "rest-links")
    tables.empty_all()
    if not rest.isEmpty():
        joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)
        labels = saved(components(spark, joined), spark, "components")
    links = links.unionByName(rest)

    degree = (links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
              .groupBy("a").agg(F.count(F.lit(1)).alias("n_links")))
    least = labels.join(points, labels["node"] == points["point"]).groupBy("component").agg(F.min("id").alias("least"))
    grouped = (points.select("point", F.col("id").alias("own")).join(
        labels.join(least, "component").select(F.col("node").alias("point"), "least", F.col("component").alias("root")), "point", "left")
        .join(degree.withColumnRenamed("a", "point"), "point", "left")
        .select("point", F.coalesce("root", "point").alias("root"), F.coalesce("least", "own").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    named = sets.select("id", "copy", "n", "point").join(grouped, "point", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least"))

    def shown(value: Column) -> Column:
        return F.when(value != LAST_ID, value)

    return named.select(shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                        shown(component).alias("component_id"),
                        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_links")).alias("links_found"), "copy",
                        F.when(F.col("n") > 0, F.col("root")).alias("root"))
