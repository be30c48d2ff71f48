"""Places of licence notices against every span of words, and the time that long texts take."""

import random
import time

import pytest

from ledgerloom.llm import license_scan

NOTICES = ("licensed under the mit license", "gnu general public license", "gnu lesser general public license")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def valid_places(line: str) -> dict[tuple[str, int, int], int]:
    starts = [0] + [i + 1 for i, c in enumerate(line) if c == " "]
    stops = [i for i, c in enumerate(line) if c == " "] + [len(line)]
    found = {}
    for notice in NOTICES:
        allowed = len(notice) // license_scan.EDIT_SHARE
        for a in starts:
            for b in stops:
                if abs(b - a - len(notice)) <= allowed:
                    edits = edit_distance(line[a:b], notice)
                    if edits <= allowed:
                        found[notice, a, b] = edits
    return found


def damaged(rng: random.Random, text: str) -> str:
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
        at = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:at] + text[at + 1:], text[:at] + "x" + text[at:], text[:at] + "y" + text[at + 1:]])
    return text


@pytest.mark.parametrize("seed", range(40))
def test_places_are_those_of_all_spans(seed):
    rng = random.Random(seed)
    parts = [damaged(rng, rng.choice(NOTICES)) if rng.random() < 0.7 else rng.choice(["gnu", "license", "and", "under the", "general"])
             for _ in range(rng.randrange(1, 7))]
    line = " ".join(" ".join(parts).split())
    valid, found = valid_places(line), license_scan.fuzzy_notices(line, NOTICES)
    for notice, a, b, edits in found:
        assert valid[notice, a, b] == edits
    for (_, _, stop, _), (_, start, _, _) in zip(found, found[1:]):
        assert stop <= start
    for (notice, a, b), edits in valid.items():
        assert any(f[1] < b and a < f[2] and f[3] <= edits for f in found), (line, notice, a, b)


def test_a_better_place_hides_no_other():
    line = "licensd under the mit license and licensed under the mit license"
    assert license_scan.fuzzy_notices(line) == [(NOTICES[0], 0, 29, 1), (NOTICES[0], 34, 64, 0)]
    assert [n[1:] for n in license_scan.scan(line.split())[1]] == [(0, 4, 1), (6, 10, 0)]


@pytest.mark.parametrize("notice", ["licensd under the mit license", "license"])
def test_time_is_in_proportion_to_the_text(notice):
    def seconds(count: int) -> float:
        words, begun = notice.split() * count, time.process_time()
        license_scan.scan(words)
        return time.process_time() - begun

    seconds(100)
    count = 200_000 // len(notice)
    assert seconds(4 * count) < 8 * seconds(count)


def test_edges_of_a_line():
    assert license_scan.fuzzy_notices("") == []
    assert license_scan.fuzzy_notices("license") == []
    assert [f[1:] for f in license_scan.fuzzy_notices("unlicensed under the mit license")] == [(0, 32, 2)]
    assert license_scan.fuzzy_notices("nonlicensed under the mit licenses") == []
