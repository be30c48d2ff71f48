"""Word, line and window expressions that the text operators share.

Everything here is a Spark expression; nothing leaves the JVM. Words are hashed
to 64 bits where only their identity matters.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import fresh_dir

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORDS = "cast(array() as array<string>)"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes that are started inside remove their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, spark: SparkSession, purpose: str, path: str | None = None, narrow: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, the planner knows the size, and the shuffles before it are gone.

    ``narrow`` packs numbers of few bits (Parquet's second version does).
    """
    path = path or fresh_dir(spark, purpose)
    with _shuffles_removed(spark):
        df.write.options(**({"parquet.writer.version": "v2"} if narrow else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(table: DataFrame, path: str) -> None:
    """Give back the disk of a saved table once nothing reads it any more."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


class Tables:
    """The working tables of one run, so that each can be emptied after its last reader."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def saved(self, df: DataFrame, purpose: str, narrow: bool = False) -> DataFrame:
        path = fresh_dir(self.spark, purpose)
        table = saved(df, self.spark, purpose, path, narrow)
        self._paths.append((table, path))
        return table

    def empty(self, *tables: DataFrame) -> None:
        for table, path in self._paths:
            if any(table is t for t in tables):
                emptied(table, path)
        self._paths = [(table, path) for table, path in self._paths if not any(table is t for t in tables)]

    def empty_all(self) -> None:
        self.empty(*(table for table, _ in self._paths))


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ASCII texts take the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def blank_words(text: Column) -> Column:
    """Runs of characters other than blank, tab and line ends; null has none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_RUN)).otherwise(F.expr(NO_WORDS))


def count_blank_words(text: Column) -> Column:
    return F.coalesce(F.size(blank_words(text)), F.lit(0)).cast("long")


def letter_words(text: Column) -> Column:
    """Runs of a-z, digits and non-ASCII characters of a text that is lower-cased already."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NON_WORD_RUN), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(left: str, right: str, shift: int) -> Column:
    """Hash of ``left[i]`` and ``right[i + shift]`` for every i that has both."""
    n = F.size(right) - shift
    return F.zip_with(F.slice(left, F.lit(1), F.greatest(n, F.lit(0))),
                      F.slice(right, F.lit(shift + 1), F.greatest(n, F.lit(0))),
                      lambda a, b: F.xxhash64(a, b))


def with_windows(df: DataFrame, hashes: str, length: int, name: str) -> DataFrame:
    """Add the hash of every window of ``length`` words, by doubling: 1, 2, 4 ... words and then the rest.

    Each step is a column of its own, so that no step is computed twice. Texts
    with fewer words get an empty array.
    """
    kept, have, column = df.columns, 1, hashes
    steps: dict[int, str] = {1: hashes}
    while have * 2 <= length:
        step = f"__w{have * 2}"
        df = df.withColumn(step, F.when(F.size(column) > have, _pairs(column, column, have)).otherwise(
            F.expr("cast(array() as array<bigint>)")))
        have, column = have * 2, step
        steps[have] = step
    if have < length:
        # The last `have` words of the window end where the window ends: the two parts may overlap.
        step = f"__w{length}"
        df = df.withColumn(step, F.when(F.size(column) > length - have, _pairs(column, column, length - have))
                           .otherwise(F.expr("cast(array() as array<bigint>)")))
        column = step
    return df.select(*kept, F.col(column).alias(name))
