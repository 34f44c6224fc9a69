"""Ranked search against scores worked out item by item."""

import math
import random
import re
from collections import Counter

import pytest

from calibrel.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, most):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n, total = sum(k > 0 for k in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for (doc, c), length in zip(counts, lengths):
            if not length:
                continue
            m = 50 + 50 * length * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in own & c.keys()
            )
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:most])]
    return Counter(out)


ITEMS = [
    (1, "Word4 word9 word81 tail"), (2, "word4 word9 word81"), (3, "WORD4, word9! lead"), (4, "nothing known here"),
    (5, ""), (6, None), (7, "ä" * 300), (8, "two words x 日本語のテキスト 11 12 13"), (8, "the same line"), (None, "word4 id"),
]


@pytest.mark.parametrize("most, entries", [(50, 400_000), (3, 400_000), (50, 6)])
def test_scores_of_every_item(spark, docs, most, entries):
    items = spark.createDataFrame([(*i, 1, 2) for i in ITEMS], "item_id long, text string, item int, score int")
    found = ranking.rank_documents(docs, items, most, block_entries=entries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    got = Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found.collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()], ITEMS, most)


def test_no_documents_and_no_items(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank_documents(none, items).collect() == []
    assert ranking.rank_documents(docs, items.limit(0)).collect() == []


def test_many_ties_are_pruned_by_id(spark, monkeypatch):
    rows = [(k, "same words here") for k in range(3000)] + [(k, "other") for k in range(3000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([("a", "same words"), ("b", "other")], "item_id string, text string")
    got = ranking.rank_documents(docs, items, 7).collect()
    assert Counter((r.item_id, r.rank, r.doc_id) for r in got) == Counter(
        [("a", k + 1, k) for k in range(7)] + [("b", k + 1, 3000 + k) for k in range(7)]
    )


@pytest.mark.parametrize("seed", range(20))
def test_shared_sums_are_the_items(seed):
    chance = random.Random(seed)
    words = [f"t{k}".encode() for k in range(30)]
    items = [chance.sample(words, chance.randrange(1, 20)) for _ in range(chance.randrange(1, 25))]
    sums = ranking.share(items)
    held = [Counter([t]) for t in sums.terms]
    for a, b in zip(sums.left, sums.right):
        assert max(a, b) < len(held)
        held.append(held[a] + held[b])
    assert sorted(k for level in sums.levels for k in level) == list(range(len(sums.left)))
    bounds = [*sums.firsts, len(sums.nodes)]
    for own, a, b in zip(items, bounds, bounds[1:]):
        assert sum((held[n] for n in sums.nodes[a:b]), Counter()) == Counter(own)


def test_equal_items_are_one_sum():
    sums = ranking.share([[b"a", b"b", b"c", b"d"]] * 5)
    assert len(sums.left) == 3 and len(sums.nodes) == 5
