"""Repaired conversations against a plain table of best prefixes, and short ones against all edits."""

import hashlib
import itertools
import random
import re
import zlib

import llm_cases as cases
import pytest

from ledgerloom.llm import conversation_repair as cr
from ledgerloom.llm import queries

LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    """First fault of each row (role, text)."""
    seen, found = set(), []
    for role, text in rows:
        marks = re.findall("[^\x20\x09-\x0d]", text)
        found.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def by_table(rows):
    """Cheapest (cost, audit, lines): the best prefix for each number of rows and each state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    kinds = faults(rows)

    def closed(best):
        for state in ("", "s", "u", "a", "u", "a"):
            if state in best:
                cost, audit, lines = best[state]
                new = "a" if state == "u" else "u"
                option = (cost + 2, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[new]])
                best[new] = min(best.get(new, option), option, key=lambda x: x[:2])
        return best

    best = closed({"": (0, "", [])})
    for (role, text), kind in zip(rows, kinds):
        after, extra = {}, int(kind == "truncated")

        def offer(state, option):
            after[state] = min(after.get(state, option), option, key=lambda x: x[:2])

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 3, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                if (state, role[:1]) in step:
                    offer(step[state, role[:1]], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                new = "a" if state == "u" else "u"
                offer(new, (cost + 2 + extra, audit + "R", lines + [{"u": "user:", "a": "assistant:"}[new] + text]))
        best = closed(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def by_all_edits(rows):
    """Cheapest (cost, audit) over every sequence of edits with up to three inserted turns."""
    kinds, best = faults(rows), None
    for inserted in range(3):
        for length in itertools.combinations_with_replacement(range(len(rows) + 1), inserted):
            for edits in itertools.product("DKR", repeat=len(rows)):
                cost, audit, options = 2 * inserted, "", []
                for i in range(len(rows) + 1):
                    options += [("u", "a")] * length.count(i)
                    audit += "I" * length.count(i)
                    if i == len(rows):
                        break
                    audit += edits[i]
                    if edits[i] == "D":
                        cost += 3
                        continue
                    cost += (kinds[i] == "truncated") + 2 * (edits[i] == "R") + 99 * (kinds[i] in ("blank", "duplicate"))
                    options.append((rows[i][0][:1],) if edits[i] == "K" else ("u", "a"))
                if (best is None or (cost, audit) < best) and any(LEGAL.fullmatch("".join(o)) for o in itertools.product(*options)):
                    best = (cost, audit)
    return best


def expected(conv_id, rows):
    """rows: turn, role, text of a conversation before damage."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in after if t is not None]
    plain = [(r, t) for _, r, t in after]
    kinds = faults(plain)
    cost, audit, lines = by_table(plain)
    return (conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
            kinds.count("truncated"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def sample(rnd, n):
    roles = rnd.choice([("user", "assistant"), ("user", "assistant", "system"), ("user", "assistant", "system", "tool", "", "Assistant", None)])
    texts = ("Yes.", "No!", "Why?", "cut", "off  ", "", " \t\n", None, "Same. \n", "ü…")
    return [(rnd.choice([i, i, i, i * 2, 3, None, -4]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4 else f"Text {i}.") for i in range(n)]


def test_search_finds_the_cheapest_of_all_edits():
    rnd = random.Random(4)
    for _ in range(60):
        rows = [(r or " ", t or " ") for _, r, t in sample(rnd, rnd.randrange(4))]
        conversation = cr._Conversation(1, 512)
        for i, (role, text) in enumerate(rows):
            conversation.add(i, role, text)
        found = conversation.outcome()
        assert (found["cost"], found["audit"]) == by_all_edits(rows)
        assert LEGAL.fullmatch("".join(t["role"][:1] for t in found["turns"]))


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_chunks_change_nothing(chunk):
    rnd = random.Random(chunk)
    for _ in range(150):
        rows = [(r or " ", t or " ") for _, r, t in sample(rnd, rnd.randrange(40))]
        conversation = cr._Conversation(1, chunk)
        for i, (role, text) in enumerate(rows):
            conversation.add(i, role, text)
        found = conversation.outcome()
        cost, audit, lines = by_table(rows)
        assert (found["cost"], found["audit"], [f"{t['role']}:{t['text']}" for t in found["turns"]]) == (cost, audit, lines)


def test_bounds_are_never_too_high():
    rnd = random.Random(9)
    for _ in range(200):
        rows = [(rnd.choice("suax"), rnd.random() < 0.2, int(rnd.random() < 0.3)) for _ in range(rnd.randrange(9))]
        for state in range(4):
            for ends in [(0, 3), (1,), (2,)]:
                found = cr.search(rows, [(state, 0, "")], ends)
                assert found is None or cr.lower_bounds(rows, ends)[0][state] <= found[1]


def test_a_long_conversation_is_searched_in_proportion_to_its_rows():
    rnd = random.Random(2)
    conversation, rows = cr._Conversation(1, 512), []
    for i in range(20_000):
        rows.append((rnd.choice(["user", "assistant", "system"]), f"text {i}" + rnd.choice(".,")))
        conversation.add(i, *rows[-1])
    found = conversation.outcome()
    assert len(found["audit"].replace("I", "")) == len(rows)
    assert LEGAL.fullmatch("".join(t["role"][:1] for t in found["turns"]))


def test_repair_of_awkward_conversations(spark):
    rnd = random.Random(6)
    known = {conv: sample(rnd, rnd.choice([1, 2, 5, 9, 30])) for conv in [None, *range(300)]}
    rows = [(text, role, turn, conv, "x", True, 3) for conv, found in known.items() for turn, role, text in found]
    table = spark.createDataFrame(rows, "text string, role string, turn long, conv_id long, conv string, present boolean, audit int").repartition(6)
    damaged = cr.damage(table)
    got = cr.repair(damaged, present=damaged["present"], chunk=4)
    digests = got.select("conv_id", *cr.COUNTS, "audit", cr.F.sha2(cr.as_text("turns"), 256))
    assert cases.counted(map(tuple, digests.collect())) == cases.counted(expected(c, r) for c, r in known.items())


def test_query_gives_every_conversation(spark, sf_dir, tmp_path):
    known = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        known.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = queries.op12_conversation_repair(spark, sf_dir)
    assert cases.counted(map(tuple, got.collect())) == cases.counted(expected(c, r) for c, r in known.items())
    spark.read.parquet(f"{sf_dir}/conversations.parquet").limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_repair(spark, str(tmp_path)).collect() == []
