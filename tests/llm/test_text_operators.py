"""Every text operator against brute force, on awkward rows and on an empty table."""

import hashlib

import llm_cases as cases
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (components, contamination, license_scan, line_dedup, mixing, ngram_join, personal_data,
                            quality_classifier, quality_rules, queries, substring_dedup, toxicity)

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    return cases.rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.table(spark, rows)


def collected(df, *names):
    return cases.counted([tuple(r[n] for n in names) for r in df.collect()])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    count, difference = oracle.compare(spark, oracle.duck(sf_dir), queries.QUERIES[name], queries.ORACLE[name], sf_dir)
    assert not difference, difference
    assert count > 0


def test_every_query_takes_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in queries.QUERIES.values():
        assert query(spark, str(tmp_path)).collect() == []


def test_mix(spark, docs, rows):
    first = mixing.mix(spark, docs).collect()
    assert cases.counted(map(tuple, first)) == cases.counted(map(tuple, mixing.mix(spark, docs).collect()))
    assert cases.counted((r.doc_id, r.size) for r in first) == cases.counted((r[0], len(cases.blank_words(r[1]))) for r in rows)
    sizes, taken, target = {}, {}, {}
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert target.setdefault(r.source, r.target) == r.target
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = dict(zip(names, (5, 2, 1, 5)))
    want, capped = {}, set()
    while True:  # the excess of stopped sources is shared again
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            want = {**share, **{s: 3.0 * sizes[s] for s in capped}}
            break
        capped |= over
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=3)


def test_highest_quotients_are_sainte_lague(spark):
    weights = [7.0, 100.0, 33.5, 0.0, 12.25, 12.25, 61.0]
    for seats in (0, 1, 5, 26, 500):
        rows = spark.createDataFrame([("g", i, w) for i, w in enumerate(weights)], "g string, i int, w double")
        got = {r.i: r.quota for r in mixing.highest_quotients(rows, ["g"], ["i"], "w", F.lit(seats), F.lit(10_000)).collect()}
        best = sorted(((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) if w for k in range(seats)))[:seats]
        assert got == {i: sum(1 for _, j, _ in best if j == i) for i in range(len(weights))}


def test_contamination(spark, docs, rows):
    words = cases.letter_words(cases.texts()[7])
    items = [(1, " ".join(words[20:45])), (2, "One"), (3, None), (4, ""), (10, "of THE"), (11, " ".join(words[-12:]).upper()),
             (1, " ".join(words[20:45])), (12, "nothing of this stands in any of all the documents")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = collected(contamination.decontaminate(spark, docs, benchmark),
                    "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == cases.counted(cases.contamination(rows, items))


def test_quality_rules(spark, docs, rows):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_rules.judge(spark, docs)
    assert collected(judged, *names) == cases.counted((r[0], *cases.quality_base(r[1])) for r in rows)
    kept = {r.doc_id: r.kept for r in judged.collect()}
    symbols = next(i for i, t in enumerate(cases.texts()) if t and t.startswith("$$$"))
    assert not kept[symbols] and kept[7]
    assert not any(r.kept for r in judged.filter("base_failed").collect())


def test_line_dedup(spark, docs, rows):
    want = cases.line_dedup(rows)
    got = line_dedup.dedup_lines(spark, docs).select("doc.doc_id", F.col("doc.text").alias("before"), "text", "n_lines", "n_removed").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id, r.before]


def test_line_dedup_of_near_lines(spark):
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(words)] + [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(0, 40, 3)]
    lines += [" ".join(words[:32]), " ".join(words[:31]), " ".join(words[9:]), "w0 w1 w2 w3", "w0 w1 w2 w3 w4", "w3 w2 w1 w0", "w0 w1 w2"]
    found = [(i, line, "en", "s", 1) + cases.EXTRA for i, line in enumerate(lines)]
    want = cases.line_dedup(found)
    for r in line_dedup.dedup_lines(spark, cases.table(spark, found)).select("doc.doc_id", "doc.text", "n_removed").collect():
        assert r.n_removed == want[r.doc_id, r.text][1], r


def test_substring_dedup(spark, docs, rows):
    got = collected(substring_dedup.remove_repeats(spark, docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == cases.counted(cases.substring_dedup(rows))


def test_components_of_the_join(spark, docs, rows):
    got = collected(ngram_join.group(spark, docs), "doc_id", "n_shingles", "component_id")
    assert got == cases.counted(cases.components(rows))


def test_join_of_rings(spark):
    """Chains of near copies: many sets lie between one and two radii of any pivot."""
    words = [f"w{i}" for i in range(120)]
    found = []
    for step in range(40):
        words[3 * step % 120] = f"new{step}"
        found.append((step, " ".join(words), "en", "s", 1) + cases.EXTRA)
    for levels in (1, 3):
        got = collected(ngram_join.group(spark, cases.table(spark, found), levels=levels), "doc_id", "n_shingles", "component_id")
        assert got == cases.counted(cases.components(found))


def test_join_of_two_hubs_with_one_bridge(spark):
    """Each end of the only bridge is taken by the pivot of its own cluster, in the only region that holds both."""
    words = [f"w{i}" for i in range(204)]

    def with_block(text, start, name):
        return text[:start] + [f"{name}{i}" for i in range(14)] + text[start + 14:]

    chain = [words]  # hub, its boundary, the other boundary, the other hub: each step replaces 18 of 200 shingles
    for start, name in ((20, "a"), (80, "b"), (140, "c")):
        chain.append(with_block(chain[-1], start, name))
    # The boundaries have two shingles of their own, so that a hub comes before them in the choice of pivots.
    chain[1], chain[2] = chain[1][:-2] + ["y0", "y1"], chain[2][:-2] + ["x0", "x1"]
    near = [chain[0][:-1] + [f"p{i}"] for i in range(20)]
    far = [chain[3][:-1] + [f"q{i}"] for i in range(20)]
    # These hold the replaced blocks more often, so that the common shingles come first in the order.
    blocks = [text[start - 4: start + 18] + [f"gap{start}"] for start in (20, 80, 140) for text in (chain[0], chain[3])]
    fillers = [sum(blocks, []) + [f"f{i}"] for i in range(60)]
    found = [(i, " ".join(t), "en", "s", 1) + cases.EXTRA for i, t in enumerate(chain + near + far + fillers)]
    want = cases.components(found)
    assert {c for _, _, c in want} == {0, 44}
    got = collected(ngram_join.group(spark, cases.table(spark, found)), "doc_id", "n_shingles", "component_id")
    assert got == cases.counted(want)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (50, 50)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}


def test_personal_data(spark, docs, rows):
    found = personal_data.find_personal_data(spark, docs)
    assert collected(found, "doc_id", "base_sha256") == cases.counted(
        (r[0], hashlib.sha256(cases.personal_base(r[1]).encode()).hexdigest()) for r in rows)
    for r, text in ((r, t) for r in found.collect() for t in [dict((x[0], x[1]) for x in rows).get(r.doc_id)] if r.doc_id is not None):
        assert set(filter(None, cases.personal_base(text).split(","))) <= set(filter(None, r.spans.split(",")))


def test_training_spans_cover_every_kind_however_often_one_repeats(spark, monkeypatch):
    seen = []

    def fitted(features, targets, *counts):
        seen.append((features, *counts))
        return np.zeros(features.shape[1] + 1)

    monkeypatch.setattr(personal_data, "_fitted", fitted)
    hot = ["mail me at one@example.com"] * 300 + ["call 555-123-4567 now"] * 200
    rare = [f"{title} {name} was here" for title in ("Dr", "Mr", "Frau") for name in ("Anna", "Xaver", "Thomas")]
    rare += ["iban DE89370400440532013000", "host 10.0.0.1", "card 4111 1111 1111 1111",
             "password=9f86d081884c7d65"]
    found = [(i, t, "en", "s", 1) + cases.EXTRA for i, t in enumerate(hot + rare)]
    personal_data.find_personal_data(spark, cases.table(spark, found), max_training_spans=30)
    features, *counts = seen[0]
    assert (features[:, :len(personal_data.KINDS)].sum(axis=0) > 0).all()
    by_kind = counts[0] @ features[:, :len(personal_data.KINDS)]
    assert by_kind[[0, 1, 2, 3, 5]] == pytest.approx([300, 1, 1, 200, 1])


def test_reliabilities_learn_which_labeler_errs():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    votes = [tuple(int(v) for v in np.where(rng.random(3) < (0.95, 0.9, 0.55), 1, -1) * (1 if t else -1)) for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    likely = personal_data.reliabilities([("email", v, n) for v, n in sorted(counts.items())])
    assert np.mean([(likely["email", v] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.9
    assert likely["email", (1, 1, -1)] > 0.5 > likely["email", (-1, -1, 1)]


def test_license_scan(spark, docs, rows):
    found = license_scan.scan_licenses(docs)
    assert collected(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == cases.counted(
        (r[0], *cases.license_base(r[1])) for r in rows)
    by_id = {r.doc_id: r for r in found.collect()}
    fuzzy = next(i for i, t in enumerate(cases.texts()) if t and t.startswith("Licensd"))
    assert by_id[fuzzy].labels == "apache-2.0" and 0.9 < by_id[fuzzy].score < 1 and by_id[fuzzy].base_labels == ""
    assert all(r.score == 1 for r in by_id.values() if r.n_base)


def test_license_search_is_complete():
    """Any edit up to the bound is found, wherever it is."""
    notice = "licensed under the apache license version 2 0"
    for place in range(len(notice)):
        line = f"before it {notice[:place]}x{notice[place + 1:]} and after"
        if " " not in (notice[place], ) and place:
            assert any(n == notice for n, *_ in license_scan.fuzzy_notices(line)), line


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = toxicity.score(spark, docs.filter("doc_id < 4000"), labels.filter(~held)).withColumnRenamed("toxic", "called")
    judged = scored.join(labels.filter(held), "doc_id").select("toxic", "called").collect()
    right = [bool(r.toxic) == r.called for r in judged]
    assert len(right) > 200 and np.mean(right) > 0.95
    assert np.mean([r.called for r in judged if not r.toxic]) < 0.01


def test_ordinal_thresholds_rise_and_rank():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    grades = np.digitize(x @ [4.0, 0.0] + rng.logistic(scale=0.2, size=2000), [1.0, 2.0, 3.0])
    weights, cuts = toxicity.fit_ordinal(x, grades, 4)
    assert np.all(np.diff(cuts) > 0) and weights[0] > 5 * abs(weights[1])


@pytest.mark.parametrize("labels", [[], [(7, 1, 0), (8, 1, 0)], [(None, None, None), (7, 0, 1), (9, 1, 0), (9, 1, 1)]])
def test_classifiers_with_few_labels(spark, docs, rows, labels):
    few = spark.createDataFrame(labels, LABELS)
    assert toxicity.score(spark, docs, few).count() == len(rows)
    assert quality_classifier.score(spark, docs, few).filter("kept").count() == len(rows)


def test_quality_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    judged = quality_classifier.score(spark, docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    assert np.mean([bool(r.quality) == r.kept for r in judged]) > 0.95
