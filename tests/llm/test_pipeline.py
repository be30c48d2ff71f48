"""The stages of the corpus pipeline, each judged on its own input."""

import corpus_pipeline as pipeline
import llm_cases as cases
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _docs(spark):
    return cases.table(spark, cases.rows()).select(*COLUMNS)


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing to weights"]


def test_quality_keeps_what_the_rules_keep(spark):
    docs = _docs(spark)
    got = pipeline.quality(spark, docs, "")
    assert got.columns == COLUMNS
    kept = {r.doc_id for r in got.collect() if r.doc_id is not None}
    failed = {r[0] for r in cases.rows() if cases.quality_base(r[1])[-1]}
    assert not kept & failed and len(kept) > 30


def test_lines(spark):
    want = cases.line_dedup(cases.rows())
    got = cases.counted((r.doc_id, r.text) for r in pipeline.lines(spark, _docs(spark), "").collect() if r.doc_id is not None)
    left = cases.counted((r[0], want[r[0], r[1]][2]) for r in cases.rows() if r[0] is not None
                         for n, gone, _ in [want[r[0], r[1]]] if gone == 0 or gone < n)
    assert got == left


def test_one_of_each_group_stays(spark):
    rows = cases.rows()
    got = pipeline.near_copies(spark, _docs(spark), "").collect()
    groups = {}
    for (doc_id, n, component), row in zip(cases.components(rows), rows):
        if n and component is not None:
            groups.setdefault(component, set()).add(row[1])
    kept = [r.doc_id for r in got if cases.blank_words(r.text) and r.doc_id is not None]
    assert sorted(kept) == sorted(groups)
    assert sum(1 for r in got if not cases.blank_words(r.text)) == sum(1 for r in rows if not cases.blank_words(r[1]))


def test_groups_that_show_the_same_id_stay_apart(spark):
    """Null and repeated ids name rows, not groups."""
    def text(name, change=""):
        return " ".join([f"{name}{i}" for i in range(60)] + [change])

    single = [(None, text(f"n{k}x")) for k in range(4)] + [(7, text(f"r{k}x")) for k in range(3)]
    near = [(None, text("ax", "one")), (None, text("ax", "two")), (None, text("bx", "one")), (9, text("bx", "two"))]
    docs = cases.table(spark, [(i, t, "en", "s", 1) + cases.EXTRA for i, t in single + near + [single[0]]]).select(*COLUMNS)
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, "").collect()]
    of_a = [r for r in got if r in near[:2]]
    assert len(of_a) == 1
    assert cases.counted(got) == cases.counted(single + of_a + near[3:])


def test_contaminated_documents_go(spark, tmp_path):
    words = cases.letter_words(cases.texts()[7])
    items = [(1, " ".join(words[20:45]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cases.counted((r.doc_id, r.text) for r in pipeline.decontaminated(spark, _docs(spark), str(tmp_path)).collect())
    assert got == cases.counted((r[0], r[1]) for r, c in zip(cases.rows(), cases.contamination(cases.rows(), items)) if not c[-1])


def test_run(spark, sf_dir):
    mixed = pipeline.run(spark, sf_dir)
    assert mixed.filter("taken <= 0 or taken > 3 * size").count() == 0
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 3 for r in by_source)
    assert mixed.count() > 50
