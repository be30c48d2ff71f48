"""Remove long passages that also stand in a document with a smaller id, by de Bruijn compaction.

Token k-mers are the edges of a de Bruijn graph. Of the k-mers of every 50-word window the one with
the smallest hash is taken, so equal windows always share an edge, at the same offset. Edges that stand
in two or more documents are joined back to their places. Where an edge has one successor and that
edge one predecessor in the whole corpus, the two are links of one nonbranching path; runs of such
links compact to one span per document, which is repeated as a whole or not at all. Only windows that
cross a branch, or lead out of a path, are compared one by one, by the coordinates of their sources.

Identity of words, edges and windows is that of 64-bit hashes.

Defined results: null text is empty; texts below the window length keep all words; equal windows
within one id are kept; a null id counts as larger than any other; rows with the same id and text
get the same result; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bitmap import bitmap, may_hold
from ledgerloom.llm.rolling import Runs, list_parts, slices
from ledgerloom.llm.text import blank_words, saved, word_hashes

WINDOW = 50
EDGE = 16  # words of a k-mer
LAST_ID = (1 << 63) - 1
_NONE = np.zeros(1, np.uint64)
_WORD = re.compile("[^\x20\x09-\x0d]+")
_EDGES = "id long, copy long, at int, edge long, next long, prev long"
_CHECKS = "id long, copy long, start int, stop int, window long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, stop: int>>"


def _sampled(runs: Runs, start: int, stop: int, window: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the text at [start, stop): the chosen edge's place for every window, the distinct places, their hashes."""
    at = np.arange(start, stop - edge + 1)
    kmers = runs.hashes(at, at + edge)
    views = np.lib.stride_tricks.sliding_window_view(kmers, window - edge + 1)
    chosen = views.argmin(axis=1) + np.arange(len(views))
    places = np.unique(chosen)
    return chosen, places, kmers[places]


def _edges(batches: Iterator[pa.RecordBatch], window: int, edge: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        words, offsets = list_parts(batch.column(2))
        for first, last in slices(offsets):
            base = offsets[first]
            runs = Runs(np.ascontiguousarray(words[base: offsets[last]]))
            out: list[tuple] = []
            for row in range(first, last):
                start, stop = offsets[row] - base, offsets[row + 1] - base
                if stop - start < window:
                    continue
                _, places, kmers = _sampled(runs, start, stop, window, edge)
                links = runs.hashes(start + places[:-1], start + places[1:] + edge)
                n = len(places)
                has_next, has_prev = np.arange(n) < n - 1, np.arange(n) > 0
                out.append((np.full(n, ids[row]), np.full(n, copies[row]), places, kmers,
                            np.concatenate((links, _NONE)), np.concatenate((_NONE, links)), has_next, has_prev))
            if out:
                i, c, p, k, nx, pv, hn, hp = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(i, pa.int64()), pa.array(c, pa.int64()), pa.array(p.astype(np.int32)),
                    pa.array(k.view(np.int64)), pa.array(nx.view(np.int64), mask=~hn),
                    pa.array(pv.view(np.int64), mask=~hp)], names=["id", "copy", "at", "edge", "next", "prev"])


def _checks(batches: Iterator[pa.RecordBatch], window: int, edge: int) -> Iterator[pa.RecordBatch]:
    """Spans that go as a whole (no window hash), and the windows that have to be compared."""
    for batch in batches:
        ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        words, offsets = list_parts(batch.column(2))
        _, bounds = list_parts(batch.column(3))
        places_of = batch.column(3).flatten()
        fields = [places_of.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
        for first, last in slices(offsets):
            base = offsets[first]
            runs = Runs(np.ascontiguousarray(words[base: offsets[last]]))
            out: list[tuple] = []
            for row in range(first, last):
                start, stop = offsets[row] - base, offsets[row + 1] - base
                at, least, out_one, in_one = (f[bounds[row]: bounds[row + 1]] for f in fields)
                chosen, _, _ = _sampled(runs, start, stop, window, edge)
                linked = np.append(False, out_one[:-1].astype(bool) & in_one[1:].astype(bool))
                path = np.cumsum(~linked) - 1
                head = at[~linked]
                tail = np.append(at[np.flatnonzero(~linked)[1:] - 1], at[-1]) + edge
                # The windows whose edge is repeated, but which no path holds as a whole.
                slot = np.minimum(np.searchsorted(at, chosen), len(at) - 1)
                mine = path[slot]
                begin = np.arange(len(chosen))
                open_windows = (at[slot] == chosen) & ~((begin >= head[mine]) & (begin + window <= tail[mine]))
                begin = begin[open_windows]
                whole = (least[~linked] < ids[row]) & (tail - head >= window)
                k, m = int(whole.sum()), len(begin)
                out.append((np.full(k + m, ids[row]), np.full(k + m, copies[row]),
                            np.concatenate((head[whole], begin)), np.concatenate((tail[whole], begin + window)),
                            np.concatenate((np.zeros(k, np.uint64), runs.hashes(start + begin, start + begin + window))),
                            np.arange(k + m) < k))
            if out:
                i, c, a, b, w, direct = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([
                    pa.array(i, pa.int64()), pa.array(c, pa.int64()), pa.array(a.astype(np.int32)),
                    pa.array(b.astype(np.int32)), pa.array(w.astype(np.uint64).view(np.int64), mask=direct)],
                    names=["id", "copy", "start", "stop", "window"])


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text, removed in zip(frame["doc_id"], frame["text"], frame["removed"]):
            words = _WORD.findall(text or "")
            spans: list[dict] = []
            for start, stop in sorted((r["start"], r["stop"]) for r in removed):
                if spans and start <= spans[-1]["stop"]:
                    spans[-1]["stop"] = max(spans[-1]["stop"], stop)
                else:
                    spans.append({"start": start, "stop": stop})
            kept, done = [], 0
            for span in spans:
                kept += words[done: span["start"]]
                done = span["stop"]
            kept += words[done:]
            rows.append((doc_id, len(words), len(words) - len(kept),
                         hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest(), spans))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])
        yield out.astype({"doc_id": "Int64"})


def remove_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """For each document: words, removed words, the hash of what is kept, and the removed spans in words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("copy"), "doc_id", "text")
    hashed = keyed.select("id", "copy", word_hashes(blank_words(F.col("text"))).alias("words"))
    edges = saved(hashed.mapInArrow(lambda it: _edges(it, window, edge), _EDGES), spark, "edges")

    def one_of_a_kind(link: str) -> Column:
        return (F.count(link) == F.count(F.lit(1))) & (F.min(link) == F.max(link))

    repeated = edges.groupBy("edge").agg(
        F.min("id").alias("least"), F.max("id").alias("most"),
        F.coalesce(one_of_a_kind("next"), F.lit(False)).alias("out_one"),
        F.coalesce(one_of_a_kind("prev"), F.lit(False)).alias("in_one")).filter("least < most").drop("most")
    places = edges.select("id", "copy", "at", "edge").join(repeated, "edge").groupBy("id", "copy").agg(
        F.sort_array(F.collect_set(F.struct("at", "least", "out_one", "in_one"))).alias("places"))
    # Only texts that have such a place are shuffled to them.
    places = saved(places, spark, "repeated-places")
    placed = keyed.filter(may_hold(bitmap(spark, places, "id", "copy"), F.col("id"), F.col("copy")))
    checks = saved(placed.select("id", "copy", "text").join(places, ["id", "copy"])
                   .select("id", "copy", word_hashes(blank_words(F.col("text"))).alias("words"), "places")
                   .mapInArrow(lambda it: _checks(it, window, edge), _CHECKS), spark, "repeat-checks")

    windows = checks.filter("window is not null")
    first = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    later = windows.join(first, "window").filter("least < id").select("id", "copy", "start", "stop")
    removed = saved(checks.filter("window is null").select("id", "copy", "start", "stop").unionByName(later)
                    .groupBy("id", "copy").agg(F.collect_set(F.struct("start", "stop")).alias("removed")), spark, "removed-spans")

    cut = (keyed.filter(may_hold(bitmap(spark, removed, "id", "copy"), F.col("id"), F.col("copy"))).join(removed, ["id", "copy"])
           .select("doc_id", "text", "removed").mapInPandas(_kept, _RESULT))
    words = blank_words(F.col("text"))
    whole = (keyed.select("id", "copy", "doc_id", F.coalesce(F.size(words), F.lit(0)).cast("long").alias("n_words"),
                          F.sha2(F.coalesce(F.array_join(words, " "), F.lit("")), 256).alias("kept_sha256"))
             .join(removed.select("id", "copy"), ["id", "copy"], "left_anti")
             .select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
                     F.expr("cast(array() as array<struct<start: int, stop: int>>)").alias("removed")))
    return whole.unionByName(cut)
