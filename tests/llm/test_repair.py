"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from calibrel.llm import queries, repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit in every state; inserts are never more than two in a row."""
    found = faults(rows)

    @lru_cache(None)
    def best(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            cost, rest = best(i, STEPS[state, WANTED[state]], inserted + 1)
            options.append((cost + 3, "I" + rest))
        if i < len(rows):
            cost, rest = best(i + 1, state, 0)
            options.append((cost + 4, "D" + rest))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] else 0
                initial = rows[i][0][:1]
                if (state, initial) in STEPS:
                    cost, rest = best(i + 1, STEPS[state, initial], 0)
                    options.append((cost + more, "K" + rest))
                cost, rest = best(i + 1, STEPS[state, WANTED[state]], 0)
                options.append((cost + 3 + more, "R" + rest))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def after(rows, audit):
    out, left, state = [], iter(rows), ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else WANTED[state]
        out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[initial], text))
        state = STEPS[state, initial]
    return out


def expected(turns):
    """turns: (turn, role, text) in the order that counts."""
    rows = [(r, t) for _, r, t in turns]
    counts, numbers = Counter(faults(rows)), [n for n, *_ in turns if n is not None]
    cost, audit = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in after(rows, audit))
    initials = [r[:1] for r, _ in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": counts["blank"], "duplicate": counts["duplicate"], "truncated": counts["truncated"],
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def in_order(turns):
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))


@pytest.mark.parametrize("seed", range(60))
def test_pieces_of_any_size_give_the_cheapest_edits(seed):
    chance = random.Random(seed)
    roles = chance.choice((["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["user"]))
    texts = ["Yes.", "No", "", " \t", "So! ", "Well?"]
    rows = [(chance.choice(roles), chance.choice(texts)) for _ in range(chance.randrange(12))]
    letters = {"blank": "g", "duplicate": "g", "truncated": "t", "": "o"}
    symbols = "".join(
        (r[:1] if r[:1] in ("s", "u", "a") and r else "x") + letters[f] for (r, _), f in zip(rows, faults(rows))
    )
    cuts = sorted(chance.randrange(len(rows) + 1) for _ in range(3))
    parts = [symbols[2 * a : 2 * b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    behind = [repair.ENDED]
    for part in reversed(parts):
        behind.append(repair.apply(repair.product(part), behind[-1]))
    behind.reverse()
    state, audit = 0, ""
    for part, then in zip(parts, behind[1:]):
        edits, state = repair.unroll(part, then, state)
        audit += edits
    assert (behind[0][0], audit + "I" * len(repair.ending(state))) == cheapest(rows)


def test_a_run_is_advanced_by_powers():
    for symbol in ("uo", "at", "xg", "xo"):
        for n in (0, 1, 2, 7, 64, 1000):
            one = repair.UNIT
            for _ in range(n):
                one = repair.times(one, repair.matrix(symbol))
            assert repair.power(symbol, n) == one


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, part int, piece int, rows int")
    report, repaired = repair.repair(df, **options)
    found = report.join(repair.digests(repaired).withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
    got = {r.conv: r.asDict() for r in found.collect()}
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, role or " " if role is None else role, " " if text is None else text))
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        want = expected(in_order(turns))
        assert {k: got[conv][k] for k in want} == want, (conv, turns)


EXTRA = ("x", 1, 2, 3)


def test_nasty_conversations(spark):
    chance = random.Random(5)
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi there"), (1, 4, "user", "Bye!"),
        (2, None, "system", "Be kind."), (2, None, None, None), (2, 0, "tool", "x."),
        (3, 0, "user", ""), (None, 0, "user", "No conversation."), (None, 1, "assistant", "None."),
        (4, 0, "assistant", "a" * 50_000 + "."), (5, 0, "", "Nobody."),
    ]
    rows += [(6, 3, "user", "Again.")] * 40
    rows += [(7, k, chance.choice(["user", "assistant"]), chance.choice(["Yes.", "No", "", f"{k}."])) for k in range(30)]
    compare(spark, [(*r, *EXTRA) for r in rows])


def test_one_conversation_over_many_pieces_and_parts(spark, monkeypatch):
    chance = random.Random(6)
    rows = [
        (9, k // 2, chance.choice(["user", "assistant", "system"]), f"{chance.randrange(40)}{chance.choice('.!x')}")
        for k in range(160)
    ]
    monkeypatch.setattr(repair, "PIECE_ROWS", 7)
    rows = [(c, t, r, x) for n, (c, t, r, x) in enumerate(rows) if (c, t, r) not in {q[:3] for q in rows[:n]}]
    compare(spark, [(*r, *EXTRA) for r in rows], part_bytes=2000)


def test_none(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repair.repair(none)
    assert report.collect() == [] and repaired.collect() == []


def test_query_on_the_small_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.conv_id: r.asDict() for r in queries.QUERIES["op12_conversation_repair"](spark, sf_dir).collect()}
    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns = groups.setdefault(r.conv_id, [])
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else r.text.translate({ord(c): None for c in ".!?"}) if k == 2 else r.text
        turns += [(r.turn, "user" if k == 4 else r.role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got.keys() == groups.keys()
    for conv, turns in groups.items():
        want = expected(in_order(turns))
        assert {k: got[conv][k] for k in want} == want
