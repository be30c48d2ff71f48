"""Working tables give back their disk: shuffles end with the write they served, large tables with their last reader."""

import glob
import tempfile
import time

from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, ngram_join
from ledgerloom.llm.text import Tables, saved
from ledgerloom.session import shared_dir


def _shuffle_files():
    return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))


def test_a_saved_table_keeps_no_shuffle_files(spark):
    before = _shuffle_files()
    counts = spark.range(1000).withColumn("key", F.col("id") % 7).repartition(3, "key").groupBy("key").count()
    table = saved(counts, spark, "counted")
    for _ in range(20):
        if not (left := _shuffle_files() - before):
            break
        time.sleep(0.5)
    assert not left
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6


def test_line_dedup_empties_its_table_of_prefixes(spark):
    known = set(glob.glob(f"{shared_dir(spark)}/lines-*"))
    texts = spark.createDataFrame([(1, 1, "a b c d\nx y"), (2, 2, "a b c d\nz")], "id long, copy long, text string")
    removed = line_dedup.repeated_lines(spark, texts)
    assert [(r["id"], r["removed"]) for r in removed.collect()] == [(2, [0])]
    (path,) = set(glob.glob(f"{shared_dir(spark)}/lines-*")) - known
    assert spark.read.parquet(path).count() == 0


def test_line_dedup_deals_runs_in_rounds_of_narrow_hashes(spark, monkeypatch):
    """No shuffle has all runs: each round has its part of the hashes, and its shared runs go when its pairs are known."""
    kept = []
    monkeypatch.setattr(Tables, "empty", lambda self, *tables: kept.append(len(tables)))
    known = set(glob.glob(f"{shared_dir(spark)}/*"))
    texts = [(d, d, "\n".join(f"{' '.join(f'word{line}x{i}' for i in range(30))} end{d}" for line in range(40))) for d in range(3)]
    removed = line_dedup.repeated_lines(spark, spark.createDataFrame(texts, "id long, copy long, text string"))
    assert [(r["id"], len(r["removed"])) for r in removed.orderBy("id").collect()] == [(1, 40), (2, 40)]
    made = set(glob.glob(f"{shared_dir(spark)}/*")) - known
    rounds = [spark.read.parquet(p).select("key").distinct() for p in made if "/shared-runs-" in p]
    assert len(rounds) == line_dedup.ROUNDS > 1 and all(r.count() for r in rounds) and kept
    parts = [{r["key"] % line_dedup.ROUNDS for r in keys.collect()} for keys in rounds]
    assert sorted(parts, key=min) == [{part} for part in range(line_dedup.ROUNDS)]
    assert max(r["key"] for keys in rounds for r in keys.collect()) < 1 << 40


def test_samples_of_the_join_are_dealt_in_rounds(spark):
    known = set(glob.glob(f"{shared_dir(spark)}/lonely-*"))
    texts = [" ".join(f"{a}{i}" for i in range(60)) for a in "abc"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[0] + " more"), (3, texts[1]), (4, texts[2])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.group(spark, docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    found = [spark.read.parquet(p) for p in set(glob.glob(f"{shared_dir(spark)}/lonely-*")) - known]
    assert len(found) == ngram_join.SAMPLE_ROUNDS > 1
    assert sum(t.filter("lonely > 0").count() > 0 for t in found) > 1


def test_the_join_empties_its_sets_and_leaves_few_pairs(spark):
    """Variants of one text that are not similar enough: their parities keep them apart, and the large tables go."""
    known = set(glob.glob(f"{shared_dir(spark)}/*"))
    base = [f"w{i}" for i in range(200)]
    docs = [(v, " ".join(f"new{v}" if i % 50 == 10 + 5 * v else w for i, w in enumerate(base))) for v in range(8)]
    got = ngram_join.group(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {v: v for v in range(8)}
    made = set(glob.glob(f"{shared_dir(spark)}/*")) - known
    for purpose in ("set-samples", "whole-sets", "prefixes", "regions", "distances"):
        found = [p for p in made if f"/{purpose}-" in p]
        assert found and all(spark.read.parquet(p).count() == 0 for p in found), purpose
