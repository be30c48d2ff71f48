"""A small table with awkward rows, and the same operators by brute force."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

BLANK_WORD = re.compile("[^\x20\x09-\x0d]+")
LETTER_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, copy int, words string, "
          "`set` int, word string, term int, at int, size string, target int, label string")
EXTRA = ("x", 1, "y", 2, "z", 3, 4, "s", 5, None)


def texts() -> list[str | None]:
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdeéß", k=rnd.randint(2, 6))) for _ in range(400)]

    def prose(n: int) -> str:
        words = rnd.choices(vocabulary, k=n)
        return "".join(w + (".\n" if i % 12 == 11 else " ") for i, w in enumerate(words))

    def changed(text: str, places: int) -> str:
        words = text.split(" ")
        for _ in range(places):
            words[rnd.randrange(len(words))] = "changed" + str(rnd.randrange(99))
        return " ".join(words)

    base, passage = prose(150), " ".join(rnd.choices(vocabulary, k=64))
    found: list[str | None] = [
        None, "", " \t\n\r\x0b\x0c ", "One", "Of the.", "a b c d", "a b c d e", base, base, changed(base, 1), changed(base, 2),
        changed(base, 12), base.upper(), prose(40) + passage + prose(40), passage + " " + prose(30), prose(25) + "\n" + passage,
        prose(30) + "All  rights\treserved. See CC-BY 4.0, General Public License", "x" * 60_000, prose(12_000),
        "the same eight words stand here every time " * 9, "a\na\n\na\nb c d e f g h i\nb c d e f g h i j\n",
        "Mail me: first.last+tag@mail.example.com, or a@b..c, 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 010-9999",
        "Licensd under the Apache License version 2.0 of the day", "$$$ ### *** " * 20 + prose(30), prose(21), prose(19)]
    return found + [prose(rnd.randint(5, 90)) for _ in range(60)]


def rows(repeat: bool = True) -> list[tuple]:
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s3")[i % 4], None) for i, t in enumerate(texts())]
    if repeat:
        out += [out[7], out[1], (None, out[9][1], "en", "s1", 3), (None, "null id and some words of its own", None, None, None)]
    return [r + EXTRA for r in out]


def table(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, SCHEMA).repartition(5)


def blank_words(text: str | None) -> list[str]:
    return BLANK_WORD.findall(text or "")


def letter_words(text: str | None) -> list[str]:
    return LETTER_WORD.findall((text or "").translate(LOWER))


def last(doc_id: int | None) -> float:
    return float("inf") if doc_id is None else doc_id


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    out = []
    for doc_id, text, *_ in docs:
        words, hit, found = letter_words(text), set(), set()
        for item_id, item in items:
            want = letter_words(item)
            n = min(window, len(want))
            for a in range(len(want) - n + 1 if n else 0):
                for b in range(len(words) - n + 1):
                    if words[b: b + n] == want[a: a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def quality_base(text: str | None) -> tuple:
    text = text or ""
    words, lines = blank_words(text), [x for x in text.split("\n") if blank_words(x)]
    places = defaultdict(list)
    for a in range(len(words) - 7):
        places[tuple(words[a: a + 8])].append(a)
    repeated = {a + k for found in places.values() if len(found) > 1 for a in found for k in range(8)}
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed)


def line_dedup(docs: list[tuple]) -> dict:
    """Documents with the same id and text count as one."""
    seen, out = [], {}
    for doc_id, text in sorted({(r[0], r[1]) for r in docs}, key=lambda d: (last(d[0]), d[1] or "")):
        kept, lines, removed = [], 0, 0
        for line in (text or "").split("\n"):
            words = frozenset(blank_words(line))
            if words:
                lines += 1
                repeats = any(100 * len(words & s) >= 80 * len(words | s) for s in seen)
                seen.append(words)
                if repeats:
                    removed += 1
                    continue
            kept.append(line)
        out[doc_id, text] = (lines, removed, None if text is None else "\n".join(kept))
    return out


def substring_dedup(docs: list[tuple], window: int = 50) -> list[tuple]:
    first: dict = {}
    for doc_id, text, *_ in docs:
        words = blank_words(text)
        for a in range(len(words) - window + 1):
            key = tuple(words[a: a + window])
            first[key] = min(first.get(key, float("inf")), last(doc_id))
    out = []
    for doc_id, text, *_ in docs:
        words = blank_words(text)
        gone = {a + k for a in range(len(words) - window + 1) if first[tuple(words[a: a + window])] < last(doc_id) for k in range(window)}
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def components(docs: list[tuple], shingle: int = 5) -> list[tuple]:
    sets = []
    for _, text, *_ in docs:
        words = blank_words((text or "").translate(LOWER))
        sets.append({tuple(words[a: a + shingle]) for a in range(max(len(words) - shingle + 1, 1))} if words else set())
    group = list(range(len(docs)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                group[root(i)] = root(j)
    least: dict = {}
    for i, (doc_id, *_) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), float("inf")), last(doc_id))
    shown = {i: None if v == float("inf") else int(v) for i, v in least.items()}
    return [(d[0], len(sets[i]), shown[root(i)]) for i, d in enumerate(docs)]


def license_base(text: str | None) -> tuple:
    words, phrases = letter_words(text), {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = [(a, label) for phrase, label in phrases.items() for p in [phrase.split()]
             for a in range(len(words)) if words[a: a + len(p)] == p]
    at = [a for a, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def personal_base(text: str | None) -> str:
    text = text or ""
    spans = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(digits)) % 10 == 0:
            spans.append(("card", m.span()))
    spans += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)


def counted(found: list[tuple]) -> Counter:
    return Counter(found)
