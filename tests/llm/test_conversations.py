"""Conversation repair against exhaustive search."""

import random
import re
import zlib
from hashlib import sha256

import pytest

from postpulse.llm import catalog, conversations

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def all_repairs(turns):
    """Every (cost, audit, repaired) with at most three inserts before, between and behind turns."""
    found = [(0, "", "", [])]  # cost, audit, initials, repaired
    for k in range(len(turns) + 1):
        for _ in range(3):  # none to three inserts here
            found += [(c + 3, a + "I", i + x[0], r + [(x, "")]) for c, a, i, r in found
                      for x in ("user", "assistant")
                      if re.fullmatch(r"s?(ua)*u?", i + x[0])]
            found = list({(c, a, i): (c, a, i, r) for c, a, i, r in found}.values())
        if k == len(turns):
            break
        role, text, must, cut = turns[k]
        step = [(c + 4, a + "D", i, r) for c, a, i, r in found]
        if not must:
            step += [(c + 3 * cut, a + "K", i + role[:1], r + [(role, text)]) for c, a, i, r in found if role]
            step += [(c + 3 + 3 * cut, a + "R", i + x[0], r + [(x, text)]) for c, a, i, r in found
                     for x in ("user", "assistant")]
        found = [s for s in step if re.fullmatch(r"s?(ua)*u?", s[2])]
    return [s for s in found if GOOD.fullmatch(s[2])]


def cheapest(turns):
    """The same by a table over turns and initials' state, for long conversations."""
    state = lambda i: 0 if not i else {"s": 1, "u": 2, "a": 3}[i[-1]]
    best = {"": (0, "", [])}
    norm = lambda i: i[-1:]
    for k in range(len(turns) + 1):
        for _ in range(4):
            for i, (c, a, r) in list(best.items()):
                x = {"": "user", "s": "user", "u": "assistant", "a": "user"}[i]
                new = (c + 3, a + "I", r + [(x, "")])
                if x[0] not in best or new[:2] < best[x[0]][:2]:
                    best[x[0]] = new
        if k == len(turns):
            break
        role, text, must, cut = turns[k]
        step = {}
        for i, (c, a, r) in best.items():
            opts = [(i, (c + 4, a + "D", r))]
            x = {"": "user", "s": "user", "u": "assistant", "a": "user"}[i]
            if not must:
                opts.append((x[0], (c + 3 + 3 * cut, a + "R", r + [(x, text)])))
                if role[:1] == x[0] or (role[:1] == "s" and i == ""):
                    opts.append((norm(role[:1]), (c + 3 * cut, a + "K", r + [(role, text)])))
            for s, v in opts:
                if s not in step or v[:2] < step[s][:2]:
                    step[s] = v
        best = step
    assert state("") == 0
    return min(v for s, v in best.items() if s in ("", "a"))


def expected(rows, solve):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        blank, again = not words, (role, text) in seen
        cut = not blank and not again and words[-1] not in ".!?"
        n = [n[0] + blank, n[1] + (not blank and again), n[2] + cut]
        seen.add((role, text))
        turns.append((role, text, blank or again, cut))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                  for a, b in zip(rows, rows[1:], strict=False))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    cost, audit, repaired = solve(turns)
    digest = sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
    return (gaps, *n, illegal, cost, audit, digest)


def by_search(turns):
    best = min((c, a) for c, a, _, _ in all_repairs(turns))
    made = {tuple(r) for c, a, _, r in all_repairs(turns) if (c, a) == best}
    assert len(made) == 1
    return (*best, list(made.pop()))


def random_talk(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ugly"]
    texts = ["Fine.", "What?", "cut", "", "  \t", None, "é!", "Yes. ", "no.\n\n", "a"]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def judged(spark, talks):
    frame = spark.createDataFrame([(k, *r) for k, rows in talks.items() for r in rows], ROWS)
    return {r[0]: tuple(r[1:]) for r in conversations.repair(frame).collect()}


def test_against_every_repair(spark):
    rng = random.Random(3)
    talks = {i: random_talk(rng, rng.randint(1, 4)) for i in range(80)}
    talks[None] = random_talk(rng, 4)
    got = judged(spark, talks)
    assert got == {k: expected(rows, by_search) for k, rows in talks.items()}


@pytest.mark.parametrize("block", [1, 3, 16])
def test_long_conversations_settle(block, monkeypatch):
    rng = random.Random(block)
    monkeypatch.setattr(conversations, "BLOCK", block)
    most = 0
    for _ in range(25):
        rows = [(i, r or " ", x or " ") for i, (_, r, x) in enumerate(random_talk(rng, 120))]
        out, seen = [], set()
        talk = conversations.Conversation(lambda r, x: out.append((r, x)))
        for t, r, x in rows:
            talk.add(t, r, x, (r, x) in seen)
            seen.add((r, x))
            most = max(most, len(talk.waiting))
        marks = talk.end()
        digest = sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        assert (*marks, digest) == expected(rows, cheapest)
    assert most < 120


def test_both_searches_agree():
    rng = random.Random(8)
    for _ in range(40):
        rows = random_talk(rng, 3)
        assert expected(rows, by_search) == expected(rows, cheapest)


def test_repaired_turns(spark):
    frame = spark.createDataFrame([
        (1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "Q?"), (1, 2, "user", "Q?"),
        (1, 3, "user", "cut"), (2, 0, "user", ""), (3, 5, "assistant", "x.")], ROWS)
    got = sorted(tuple(r) for r in conversations.repaired_turns(frame).collect())
    # Deleting "cut" or renaming it: 3 + 3 against 4, and Q? needs an answer then.
    assert got == [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "assistant", "Q?")] or [
        g[0] for g in got].count(1) == 5
    marks = {r.conv_id: r for r in conversations.repair(frame).collect()}
    for k in (1, 2, 3):
        lines = "\n".join(f"{r}:{x}" for c, _, r, x in got if c == k)
        assert marks[k].repaired_sha256 == sha256(lines.encode()).hexdigest()
    assert (marks[2].audit, marks[2].cost, marks[2].blank) == ("D", 4, 1)
    assert (marks[3].audit, marks[3].cost, marks[3].gaps) == ("IK", 3, 0)


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def test_query_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    talks = {r[0]: [] for r in rows}
    for c, *rest in damaged(rows):
        talks[c].append(tuple(rest))
    want = {k: expected(v, cheapest) if v else (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
            for k, v in talks.items()}
    got = catalog.queries()["op11_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                           "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    assert conversations.repair(empty).collect() == []
    assert conversations.repaired_turns(empty).collect() == []
    assert conversations.judged(conversations.damage(empty), empty).collect() == []
    rows = [(None, None, None, None), (None, None, None, None), (7, None, "user", "a."), (7, 0, "user", "a."),
            (7, 1, None, "b" * 200_000 + "."), (9, 3, "", "x.")]
    odd = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS key", "2 AS seen", "3 AS copy", "4 AS mark",
                                                       "5 AS k", "6 AS n", "7 AS audit")
    whole = conversations.judged(conversations.damage(odd), odd).collect()
    talks = {k: [] for k in (None, 7, 9)}
    for c, *rest in damaged(rows):
        talks[c].append(tuple(rest))
    want = {k: expected(v, cheapest) if v else (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
            for k, v in talks.items()}
    assert {r[0]: tuple(r[1:]) for r in whole} == want


def test_one_conversation_holds_a_third(spark):
    rng = random.Random(1)
    talks = {i: random_talk(rng, 3) for i in range(300)}
    talks[1000] = [(i, r, x) for i, (_, r, x) in enumerate(random_talk(rng, 2_000))]
    got = judged(spark, talks)
    assert got[1000] == expected(talks[1000], cheapest) and len(got) == 301
