"""Find licence phrases exactly, and short licence notices with a bounded number of edits.

A notice of n characters may differ by a tenth of them. Cut into one piece more than
edits are allowed, at least one piece stands unchanged (pigeonhole), so an automaton over all pieces
finds every place where a notice can be. Only a window around each of them is given to the regex library's
bounded-error matching, which verifies the edits and gives the best span. Of places that overlap, the one with the fewest edits stays
(then the longest, then the first). Texts are read once, one document at a time, without a shuffle; time grows
with the length of a text, whatever is in it.

Defined results: null text is empty; texts without phrases have null word positions and an empty label list;
rows with the same id are separate rows; an empty table gives no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.text import lower_az

# Base phrases with their labels, and notices of the fuzzy search with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution license": "cc-by",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved no part of this publication may be reproduced": "reserved",
}
EDIT_SHARE = 10  # one edit is allowed for so many characters
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@cache
def _automaton(notices: tuple[str, ...]) -> ahocorasick.Automaton:
    """All pieces of all notices; each piece knows its notices and its offsets in them."""
    pieces: dict[str, list[tuple[str, int]]] = {}
    for notice in notices:
        parts = len(notice) // EDIT_SHARE + 1
        cuts = [len(notice) * i // parts for i in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:]):
            pieces.setdefault(notice[a:b], []).append((notice, a))
    automaton = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return automaton


@cache
def _fuzzy(notice: str) -> regex.Pattern:
    return regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(notice, special_only=True)}){{e<={len(notice) // EDIT_SHARE}}}(?!\S)")


def _apart(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Places of which no two overlap: the one with the fewest edits goes first, then the longest, the first, the notice in order."""
    taken: list[tuple[int, int]] = []
    kept = []
    for place in sorted(found, key=lambda f: (f[3], f[1] - f[2], f[1], f[0])):
        span = place[1], place[2]
        at = bisect(taken, span)
        if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            taken.insert(at, span)
            kept.append(place)
    return sorted(kept, key=lambda f: f[1])


def fuzzy_notices(line: str, notices: tuple[str, ...] = tuple(NOTICES)) -> list[tuple[str, int, int, int]]:
    """(notice, start, stop, edits) of the verified places in a line of words joined by one space.

    Each seed is searched in a window of its own, as long as its notice with all edits on either side and cut to whole words, so
    a better place near by hides no other one, and the time is in proportion to the number of seeds.
    """
    found = set()
    tried: dict[str, tuple[int, set[int]]] = {notice: (len(notice) // EDIT_SHARE, set()) for notice in notices}
    for end, (length, uses) in _automaton(notices).iter(line):
        for notice, offset in uses:
            edits, starts = tried[notice]
            start = end - length + 1 - offset
            if start in starts:  # another piece of the same place
                continue
            starts.add(start)
            low, high = max(0, start - edits), min(len(line), start + len(notice) + edits)
            if low > 0 and line[low - 1] != " ":
                low = line.find(" ", low, high) + 1 or high
            if high < len(line) and line[high] != " ":
                high = max(low, line.rfind(" ", low, high))
            if high - low < len(notice) - edits:
                continue
            match = _fuzzy(notice).search(line[low:high])
            if match:
                found.add((notice, low + match.start(), low + match.end(), sum(match.fuzzy_counts)))
    return _apart(list(found))


def scan(words: list[str]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, int]], float]:
    """Base places (phrase, word), notices (label, first word, last word, edits), and the best likeness."""
    line = " ".join(words)
    padded = f" {line} "
    base = []
    for phrase in PHRASES:
        at = padded.find(f" {phrase} ")
        counted, words_before = 0, 0
        while at >= 0:
            words_before += padded.count(" ", counted, at)
            counted = at
            base.append((phrase, words_before))
            at = padded.find(f" {phrase} ", at + 1)
    notices, best = [], 1.0 if base else 0.0
    first, counted = 0, 0
    for notice, start, stop, edits in fuzzy_notices(line):
        first += line.count(" ", counted, start)
        counted = start
        notices.append((NOTICES[notice], first, first + line.count(" ", start, stop), edits))
        best = max(best, 1 - edits / len(notice))
    return base, notices, best


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            words = _WORD.findall(text or "")
            base, notices, score = scan(words)
            base_labels = {PHRASES[phrase] for phrase, _ in base}
            labels = base_labels | {n[0] for n in notices}
            at = [word for _, word in base]
            rows.append((doc_id, len(words), len(base), min(at, default=None), max(at, default=None),
                         ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                         [{"label": n[0], "first_word": n[1], "last_word": n[2], "edits": n[3]} for n in sorted(notices, key=lambda n: n[1])]))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                          "score", "notices"]).astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: base places, labels of phrases and notices, a score, and the notices' spans in words."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), lower_az(F.col(text_col)).alias("text"))
    return texts.mapInPandas(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                             "labels string, score double, notices array<struct<label: string, first_word: int, last_word: int, edits: int>>")
