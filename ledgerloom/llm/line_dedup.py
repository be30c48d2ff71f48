"""Remove lines that repeat an earlier line, exactly or nearly: an exact set-similarity join over line words.

A line is the set of its distinct words, longest first and then by hash. (Any order is right. Long words are seldom
the common ones, and the length needs no count over the corpus.) Equal sets are one class. Two sets with
Jaccard similarity of at least ``percent`` differ so little that they share one of the first runs of neighbouring words
in this order. A run is two words where both are long, three where all are of middle length at least, and four elsewhere (ends that no
word equals follow the last word), so that unrelated lines seldom share one, however many there are. To break all runs that begin before
a place, a linked set must lack a word for every two pairs, three runs of three or four runs of four, and (100 - percent)% of n words is
all it may lack; a word that it has more breaks fewer runs and uses up ``percent`` hundredths of one that it lacks. The runs up to one more
are a prefix in which linked sets always meet. Below 80 percent all runs are pairs. Sets of a prefix run first meet the earliest of them
only; sets that this does not decide meet the other earlier ones.

Runs are the largest data by far. They are kept as hashes of 40 bits (a collision makes one more pair to verify) and dealt in rounds, each with
the runs of one part of the hashes, so that a shuffle holds a part of them.

Most sets that meet are not linked. Every set therefore has parities: its words are dealt to 128 places by hash (those of very long lines
to 256 more), and each place says whether its number of words is odd. Two sets differ in at least as many words as their parities do in
places, so a pair whose parities differ in more places than linked sets of these sizes have different words is no link. This holds for every
pair and is tested in the join, with the length and positional filters, before the words of the pairs left are fetched and their similarity is counted.

A line goes if any earlier line of the input matches it; lines are ordered by document id, then by their place.
Equality of words and sets is that of 64-bit hashes (words within one set: 57 bits and the length).

Defined results: null text stays null; lines without words always stay and match nothing; lines of fewer than four
different words match only equal sets; a null id counts as larger than any other; rows with the same id and text are
copies of one document and get the same result; an empty table gives no rows. Other columns are passed through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bitmap import bitmap, may_hold
from ledgerloom.llm.text import BLANKS, NO_WORDS, Tables

PERCENT = 80
LONGEST = 63  # bytes; longer words count as of this length
RARE_FROM = 8  # bytes of a word that is taken as rare
MIDDLE_FROM = 6  # bytes of a word that needs two neighbours, not three
LONG_RUNS_FROM = 80  # percent; below, the longer runs would need more of them than a line has
RUN_BITS = 40  # of a run's hash
ROUNDS = 4  # the runs are dealt in so many parts, one after the other
HELD_WORDS = 1 << 18  # of the bitmap of a round's shared runs
FINE_FROM = 180  # words of a line whose parities need more places
PARITIES = ("odd", "odd2", "fine", "fine2", "fine3", "fine4")
LAST_ID = (1 << 63) - 1
LAST_KEY = (1 << 63) - 1
COORDINATE = ("id", "copy", "at")


def _trimmed(line: Column) -> Column:
    """Blanks of all kinds as spaces, none at the ends."""
    odd = F.lit(False)
    for blank in BLANKS.replace(" ", "").replace("\n", ""):
        odd = odd | F.contains(line, F.lit(blank))
    return F.trim(F.when(odd, F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line))


def _words(trimmed: Column) -> Column:
    return (F.when(F.length(trimmed) == 0, F.expr(NO_WORDS))
            .when(F.contains(trimmed, F.lit("  ")), F.split(trimmed, " +")).otherwise(F.split(trimmed, " ")))


def _lines(texts: DataFrame) -> DataFrame:
    return (texts.select("id", "copy", F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .select("id", "copy", "at", _trimmed(F.col("line")).alias("line")).filter("line <> ''"))


def _with_keys(lines: DataFrame) -> DataFrame:
    """Add ``keys``, the line's distinct words as numbers in the common order."""
    def key(word: Column) -> Column:
        length = F.least(F.octet_length(word), F.lit(LONGEST)).cast("long")
        return F.shiftrightunsigned(F.xxhash64(word), 7) - F.shiftleft(length, 57)

    return lines.withColumn("keys", F.sort_array(F.array_distinct(F.transform(_words(F.col("line")), key)))).drop("line")


def _parity(keys: Column, counts: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """A number whose bits say of each of 64 places whether an odd number of the keys that count fall into it."""
    def bit(k: Column) -> Column:
        return F.call_function("shiftleft", counts(k), place(k).bitwiseAND(63).cast("int"))

    return F.aggregate(keys, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(bit(k)))


def _parities(keys: Column) -> list[Column]:
    """A key's lowest seven bits are its place of 128, the next ones its place of 256 more."""
    one, long = F.lit(1).cast("long"), F.size(keys) >= FINE_FROM

    def upper(k: Column) -> Column:
        return F.shiftright(k, 6).bitwiseAND(1)

    def of_group(group: int) -> Callable[[Column], Column]:
        return lambda k: F.when(F.shiftright(k, 14).bitwiseAND(3) == group, one).otherwise(F.lit(0).cast("long"))

    coarse = [_parity(keys, upper, lambda k: k), _parity(keys, lambda k: upper(k).bitwiseXOR(one), lambda k: k)]
    fine = [F.when(long, _parity(keys, of_group(group), lambda k: F.shiftright(k, 8))) for group in range(4)]
    return [bits.alias(name) for bits, name in zip(coarse + fine, PARITIES, strict=True)]


def _with_prefix(keyed: DataFrame, percent: int) -> DataFrame:
    """Replace ``keys`` by their number ``n``, the hash ``set``, the parities and ``prefix``, the hashes of the first runs."""
    lack = 100 - percent
    kept = [c for c in keyed.columns if c != "keys"]
    sized = keyed.select(*kept, "keys", F.size("keys").alias("n"), F.xxhash64("keys").alias("set"), *_parities(F.col("keys")))

    def runs(length: int, words: int, at_most: str) -> Column:
        """How many runs begin before the last ``words - 1`` words of that length; long words come first, more than a prefix may have do not matter."""
        first = F.slice("keys", F.lit(1), F.expr(f"cast({at_most} as int)"))
        return F.greatest(F.size(F.filter(first, lambda k: k < ((1 - length) << 57))) - (words - 1), F.lit(0))

    if percent < LONG_RUNS_FROM:
        short = middle = F.col("n")
    else:
        short = runs(RARE_FROM, 2, f"(2 * {lack} * n) div 100 + 2")
        middle = F.greatest(runs(MIDDLE_FROM, 3, f"(4 * {lack} * n) div 100 + 4") - F.col("short"), F.lit(0))
    counted = sized.withColumn("short", short).withColumn("middle", middle)
    starts = F.expr(f"""cast(greatest((2 * {lack} * n) div 100, (6 * {lack} * n - 100 * short) div 200,
                                      (12 * {lack} * n - 300 * short - 100 * middle) div 300) + 1 as int)""")
    # A set without a possible partner of its size or the next needs no prefix.
    meets = (F.col("n") * 100 >= percent * (F.col("n") + 1)) & (starts <= F.col("n"))
    placed = counted.withColumn("starts", F.when(meets, starts).otherwise(0)).withColumn("short", F.least("short", "starts"))
    placed = placed.withColumn("middle", F.least("middle", F.col("starts") - F.col("short")))
    ended = placed.withColumn("keys", F.concat("keys", F.array(*[F.lit(LAST_KEY)] * 3)))

    def run(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b).bitwiseAND((1 << RUN_BITS) - 1)

    def longer(shorter: str, skipped: Column, words: int, before: Column) -> Column:
        """Runs of one more word than in ``shorter``, whose first ``skipped`` stay as they are; ``before`` runs begin before these."""
        n = F.col("starts") - before
        return F.zip_with(F.slice(shorter, skipped + 1, n), F.slice("keys", before + words, n), run)

    paired = ended.withColumn("pairs", F.zip_with(F.slice("keys", F.lit(1), F.col("starts")), F.slice("keys", F.lit(2), F.col("starts")), run))
    threes = paired.withColumn("threes", longer("pairs", F.col("short"), 3, F.col("short")))
    fours = longer("threes", F.col("middle"), 4, F.col("short") + F.col("middle"))
    prefix = F.concat(F.slice("pairs", F.lit(1), F.col("short")), F.slice("threes", F.lit(1), F.col("middle")), fours)
    return threes.select(*kept, "n", "set", *PARITIES, prefix.alias("prefix"))


def _possible(percent: int) -> Column:
    """Length, parity and positional filter for sets (n, pos) and (m, mpos) that share the run at those places."""
    enough = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    before = F.least("pos", "mpos")
    after = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("mpos"))
    differ = [F.bit_count(F.col(c).bitwiseXOR(F.col(f"e{c}"))) for c in PARITIES]
    may = F.col("n") + F.col("m") - 2 * enough
    return ((F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent) & (before + after >= enough)
            & (reduce(Column.__add__, differ[:2]) <= may) & (F.coalesce(reduce(Column.__add__, differ[2:]), F.lit(0)) <= may))


def _verified(tables: Tables, texts: DataFrame, firsts: DataFrame, pairs: DataFrame, percent: int, purpose: str) -> DataFrame:
    """Of the pairs (set, earlier) that have the similarity, the sets whose first line is the later one; words are read from the first lines."""
    spark = tables.spark
    wanted = tables.saved(pairs.select("set").unionByName(pairs.select(F.col("earlier").alias("set"))).distinct()
                          .join(firsts, "set").select("set", "first.*"), "candidate-lines")
    holding = texts.filter(may_hold(bitmap(spark, wanted, "id", "copy"), F.col("id"), F.col("copy")))
    read = _lines(holding).filter(may_hold(bitmap(spark, wanted, *COORDINATE), *(F.col(c) for c in COORDINATE)))
    keyed = _with_keys(read).select(F.xxhash64("keys").alias("set"), "keys")
    placed = wanted.select("set", F.struct(*COORDINATE).alias("first"))
    words = tables.saved(keyed.join(placed, "set").dropDuplicates(["set"]), "candidate-words")
    other = words.select(F.col("set").alias("earlier"), F.col("keys").alias("other"), F.col("first").alias("efirst"))
    shared = F.size(F.array_intersect("keys", "other"))
    union = F.size("keys") + F.size("other") - shared
    later = F.when(F.col("first") > F.col("efirst"), F.col("set")).otherwise(F.col("earlier")).alias("set")
    near = tables.saved(pairs.join(words, "set").join(other, "earlier").filter(shared * 100 >= union * percent).select(later).distinct(), purpose)
    tables.empty(wanted, words)
    return near


def _shared_runs(tables: Tables, lines: DataFrame, part: int) -> DataFrame:
    """The runs of one round that two sets or more hold, with each of these sets."""
    entries = lines.select("id", "set", "n", *PARITIES, F.posexplode("prefix").alias("pos", "key")).filter(F.pmod("key", F.lit(ROUNDS)) == part)
    # First which runs they are, from the narrowest rows; then the places of those runs only.
    held = tables.saved(entries.select("key", "set").repartition("key").groupBy("key").agg(
        F.min("set").alias("a"), F.max("set").alias("b")).filter("a <> b").select("key"), "held-runs")
    likely = entries.filter(may_hold(bitmap(tables.spark, held, "key", words=HELD_WORDS), F.col("key"), words=HELD_WORDS))
    shared = tables.saved(likely.join(held.hint("shuffle_hash"), "key").groupBy("key", "set", "pos").agg(
        F.min("id").alias("id"), *(F.any_value(c).alias(c) for c in ("n", *PARITIES))), "shared-runs")
    tables.empty(held)
    return shared


def _with_leader(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of shared runs by key, and the earliest set of each key with the number of its ``holders``; one exchange serves both."""
    placed = shared.repartition("key")
    leaders = placed.groupBy("key").agg(F.min(F.struct("id", "set", "n", "pos", *PARITIES)).alias("l"), F.count(F.lit(1)).alias("holders"))
    return placed, leaders.select("key", "l.*", "holders")


def _earlier(columns: DataFrame) -> DataFrame:
    return columns.select("key", F.col("set").alias("earlier"), F.col("n").alias("m"), F.col("pos").alias("mpos"), F.col("id").alias("eid"),
                          *(F.col(c).alias(f"e{c}") for c in PARITIES))


def _leader_pairs(shared: DataFrame, percent: int) -> DataFrame:
    placed, leaders = _with_leader(shared)
    return placed.join(_earlier(leaders), "key").filter((F.col("set") != F.col("earlier")) & _possible(percent)).select("set", "earlier").distinct()


def _other_pairs(shared: DataFrame, decided: DataFrame, percent: int) -> DataFrame:
    """All but the earliest of a run, which they have met; runs of two sets have no others. Sets that begin in documents of one id meet both ways."""
    placed, leaders = _with_leader(shared)
    met = leaders.filter("holders > 2").select("key", F.col("set").alias("met"))
    open_sets = placed.join(decided, "set", "left_anti").join(met, "key").filter("set <> met")
    return (open_sets.join(_earlier(placed), "key")
            .filter((F.col("met") != F.col("earlier")) & (F.col("set") != F.col("earlier")) & (F.col("eid") <= F.col("id")) & _possible(percent))
            .select("set", "earlier").distinct())


def repeated_lines(spark: SparkSession, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, copy, removed): the numbers of the lines of a document that repeat an earlier line."""
    tables = Tables(spark)
    lines = tables.saved(_with_prefix(_with_keys(_lines(texts)), percent), "lines", narrow=True)
    firsts = tables.saved(lines.groupBy("set").agg(F.min(F.struct(*COORDINATE)).alias("first")), "line-classes")
    rounds = [_shared_runs(tables, lines, part) for part in range(ROUNDS)]
    # The prefixes are the largest working table, and the rest needs room.
    numbered = tables.saved(lines.select(*COORDINATE, "set"), "line-sets")
    tables.empty(lines)

    def gathered(found: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, found).distinct()

    pairs = tables.saved(gathered([tables.saved(_leader_pairs(shared, percent), "leader-pairs") for shared in rounds]), "leaders-met")
    decided = _verified(tables, texts, firsts, pairs, percent, "decided")
    others = []
    for shared in rounds:
        others.append(tables.saved(_other_pairs(shared, decided, percent), "other-pairs"))
        tables.empty(shared)
    left = tables.saved(gathered(others).join(pairs, ["set", "earlier"], "left_anti"), "others-met")
    near = decided.unionByName(_verified(tables, texts, firsts, left, percent, "decided")).distinct().withColumn("near", F.lit(True))

    judged = numbered.join(firsts, "set").join(near, "set", "left")
    later = (F.struct(*COORDINATE) > F.col("first")) | F.coalesce("near", F.lit(False))
    removed = tables.saved(judged.filter(later).groupBy("id", "copy").agg(F.collect_set("at").alias("removed")), "removed-lines")
    tables.empty(numbered, firsts)
    return removed


def dedup_lines(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                percent: int = PERCENT) -> DataFrame:
    """The documents without their repeated lines, as columns ``doc`` (the row), ``text`` (what is left), ``n_lines`` and ``n_removed``."""
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"),
                        F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)).alias("id"),
                        F.xxhash64(docs[text_col]).alias("copy"), docs[text_col].alias("text"))
    removed = repeated_lines(spark, keyed.select("id", "copy", "text"), percent)
    touched = may_hold(bitmap(spark, removed, "id", "copy"), F.col("id"), F.col("copy"))
    none = F.expr("cast(null as array<int>)")
    found = keyed.filter(~touched).withColumn("removed", none).unionByName(
        keyed.filter(touched).join(removed, ["id", "copy"], "left").select("doc", "id", "copy", "text", "removed"))
    with_lines = found.withColumn("lines", F.split("text", "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    with_words = F.filter("lines", lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    return with_lines.select(
        "doc", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.coalesce(F.size(with_words), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
