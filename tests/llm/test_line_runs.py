"""Line dedup meets lines by runs of words that unrelated lines seldom share, and loses no pair by it."""

import glob
import random

from ledgerloom.llm import line_dedup
from ledgerloom.session import shared_dir
import llm_cases as cases


def _lines():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    lines = [" ".join(rnd.choices(words, weights, k=rnd.randint(3, 60))) for _ in range(700)]
    for line in rnd.sample(lines, 250):
        found = line.split(" ")
        for _ in range(max(1, len(found) * rnd.choice((5, 10, 15, 22)) // 100)):
            at = rnd.randrange(len(found))
            found[at: at + 1] = rnd.choice(([], ["new", found[at]], [f"n{rnd.randrange(99)}"], [rnd.choice(words), found[at]])) or []
            found = found or ["new"]
        lines.append(" ".join(found))
    return lines


def test_near_lines_of_common_and_rare_words(spark):
    found = [(i, line, "en", "s", 1) + cases.EXTRA for i, line in enumerate(_lines())]
    want = cases.line_dedup(found)
    got = line_dedup.dedup_lines(spark, cases.table(spark, found)).select("doc.doc_id", "doc.text", "n_removed").collect()
    assert sum(r.n_removed for r in got) > 150
    for r in got:
        assert r.n_removed == want[r.doc_id, r.text][1], r


def test_unrelated_lines_are_hardly_compared(spark):
    rnd = random.Random(4)
    lines = [" ".join(rnd.choices([f"w{i}" for i in range(500)], k=30)) for _ in range(1500)]
    known = set(glob.glob(f"{shared_dir(spark)}/*-pairs-*"))
    texts = spark.createDataFrame([(i, i, line) for i, line in enumerate(lines)], "id long, copy long, text string")
    assert line_dedup.repeated_lines(spark, texts).count() == 0
    pairs = sum(spark.read.parquet(p).count() for p in set(glob.glob(f"{shared_dir(spark)}/*-pairs-*")) - known if "held" not in p and "shared" not in p)
    assert pairs < 2000


def test_lines_just_below_the_similarity_are_not_paired(spark):
    """Variants of one line share most runs with each other; hardly any two are similar enough."""
    rnd = random.Random(5)
    base = [f"word{i}" for i in range(60)]
    lines = [" ".join(f"new{v}x{i}" if i in gone else w for i, w in enumerate(base))
             for v in range(250) for gone in [set(rnd.sample(range(60), 14))]]
    known = set(glob.glob(f"{shared_dir(spark)}/*-pairs-*"))
    texts = spark.createDataFrame([(i, i, line) for i, line in enumerate(lines)], "id long, copy long, text string")
    assert line_dedup.repeated_lines(spark, texts).count() == 0
    pairs = sum(spark.read.parquet(p).count() for p in set(glob.glob(f"{shared_dir(spark)}/*-pairs-*")) - known if "held" not in p and "shared" not in p)
    assert pairs < 500


def test_long_unrelated_lines_are_hardly_compared(spark):
    """Lines of hundreds of common words share runs; places for their parities must not be used up by so many words."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(1200)]
    lines = [" ".join(rnd.sample(words, 250) + ["aaaaaaaaaa", "bbbbbbbbbb"]) for _ in range(120)]
    known = set(glob.glob(f"{shared_dir(spark)}/*-pairs-*"))
    texts = spark.createDataFrame([(i, i, line) for i, line in enumerate(lines)], "id long, copy long, text string")
    assert line_dedup.repeated_lines(spark, texts).count() == 0
    pairs = sum(spark.read.parquet(p).count() for p in set(glob.glob(f"{shared_dir(spark)}/*-pairs-*")) - known if "held" not in p and "shared" not in p)
    assert pairs < 20


def test_similar_lines_of_one_document_go_by_their_place(spark):
    """Each line is similar to the next ones only, and those of one document share its id."""
    base = [f"word{i}" for i in range(40)]
    chain = [" ".join([f"new{i}" for i in range(3 * k)] + base[3 * k:]) for k in range(8)]
    found = [(key, "\n".join(part), "en", "s", 1) + cases.EXTRA for key, part in ((5, chain[::-1]), (3, chain[6:2:-2]), (None, chain))]
    want = cases.line_dedup(found)
    got = line_dedup.dedup_lines(spark, cases.table(spark, found)).select("doc.doc_id", "doc.text", "n_removed").collect()
    assert sum(r.n_removed for r in got) > 10
    for r in got:
        assert r.n_removed == want[r.doc_id, r.text][1], r
