"""Proximity matches of benchmark windows against brute force."""

import random
from collections import Counter

import llm_cases as cases
from pyspark.sql import functions as F

from ledgerloom.llm import contamination as c


def windows_of(items):
    found = {}
    for item_id, text in items:
        words = cases.letter_words(text)
        for at in range(max(len(words) - c.WINDOW + 1, 1)) if words else ():
            found.setdefault(tuple(words[at: at + c.WINDOW]), set()).add(item_id)
    return found


def near_items(texts, items):
    """For each text the number of items with an exact or near window."""
    windows, words = windows_of(items), [cases.letter_words(t) for t in texts]
    counts = Counter(w for text in words for w in text)
    result = []
    for text in words:
        met = set()
        for window, owners in windows.items():
            n = len(window)
            exact = any(tuple(text[s: s + n]) == window for s in range(len(text) - n + 1))
            by_rarity = sorted(range(n), key=lambda o: (counts[window[o]], o))
            near = n >= c.LEAST_NEAR and any(
                sum(window[o] in text[max(0, p - a + o - c.SLACK): max(0, p - a + o + c.SLACK + 1)] for o in range(n)) >= n - c.MISSING
                for a in by_rarity[:c.MISSING + 1] for p, word in enumerate(text) if word == window[a])
            if exact or near:
                met |= owners
        result.append(len(met))
    return result


def test_near_items_are_those_of_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(some(rng.choice([1, 3, 5, 6, 10, 14])))) for i in range(12)] + [(20, None), (21, ""), (22, "w1 w1 w1 w1 w1 w1")]
    texts = [None, "", "w1", "w1 w1 w1 w1 w1", "w1 w1 w1 x w1 w1"]
    for _ in range(120):
        words = rng.choice(items)[1]
        words = cases.letter_words(words)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(words) + 1)
            change = rng.randrange(4)
            if change == 0:
                words = words[:at] + ["x"] + words[at:]
            elif change == 1:
                words = words[:at] + words[at + 1:]
            elif change == 2 and at < len(words):
                words = words[:at] + ["y"] + words[at + 1:]
            elif at + 1 < len(words):
                words = words[:at] + [words[at + 1], words[at]] + words[at + 2:]
        texts.append(" ".join(some(rng.randrange(4)) + words + some(rng.randrange(4))))
    rows = [(i if i % 9 else None, t, "en", "s", 1) + cases.EXTRA for i, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("at", F.lit("clash"))
    found = c.decontaminate(spark, cases.table(spark, rows), benchmark, proximity=True)
    want = Counter(zip([r[0] for r in rows], near_items(texts, items)))
    assert Counter((r.doc_id, r.n_near_items) for r in found.collect()) == want
    assert len({n for _, n in want}) > 1


def test_no_items_and_no_documents(spark):
    rows = [(1, "one two three four five six", "en", "s", 1) + cases.EXTRA]
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = cases.table(spark, rows)
    assert [r.n_near_items for r in c.decontaminate(spark, docs, benchmark.limit(0), proximity=True).collect()] == [0]
    assert c.decontaminate(spark, docs.limit(0), benchmark, proximity=True).count() == 0
