"""Every operator on nasty rows and on an empty table, against plain forms of its contract."""

import base64
import hashlib
import random
import re
from collections import Counter

import brute
import pyarrow as pa
import pytest
import tiktoken
from conftest import PASSAGE, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrel.llm import bpe, decontaminate, exact, license, pii, quality, secrets, simhash, suffix, urls
from calibrel.llm.batches import released
from calibrel.llm.graph import components
from calibrel.llm.queries import multi_tokenizer

ROWS = [(r[0], r[1]) for r in rows()]


def spans(found):
    return [(s["start"], s["kind"], s["end"]) for s in found]


# --- 1: near duplicates ---------------------------------------------------------------------------


def test_fingerprints_and_components(docs):
    found = simhash.near_duplicates(docs).collect()
    marks = {t: brute.fingerprint(t) for _, t in ROWS}
    by_print = {}
    for i, t in ROWS:
        if i is not None:
            by_print.setdefault(marks[t], []).append(i)
    groups = brute.components({min(ids): p for p, ids in by_print.items()})
    want = Counter(
        (i, f"{marks[t]:016x}", groups[min(by_print[marks[t]])] if marks[t] in by_print else None) for i, t in ROWS
    )
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want


def test_near_duplicates_of_nothing(none):
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("held,heavy", [(1 << 22, 1 << 14), (500, 3)])
def test_all_links_within_the_radius(spark, monkeypatch, held, heavy):
    monkeypatch.setattr(simhash, "VARIANTS_HELD", held)
    monkeypatch.setattr(simhash, "HELD", heavy)
    random.seed(5)
    values = set()
    for _ in range(40):
        value = random.getrandbits(64)
        values.add(value)
        for _ in range(random.randint(0, 5)):
            for _ in range(random.randint(1, 3)):
                value ^= 1 << random.randrange(64)
            values.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    group = {v: v for v in signed}
    for r in links:
        old, new = group[r.u], group[r.v]
        group = {v: new if g == old else g for v, g in group.items()}
    want = brute.components({v: v & (2**64 - 1) for v in signed})
    assert Counter(Counter(group.values()).values()) == Counter(Counter(want.values()).values())
    assert all(group[a] == group[b] for a in signed for b in signed if want[a] == want[b])


@pytest.mark.parametrize("held", [4, 40, 1 << 14])
def test_a_cloud_under_one_head_is_split_until_it_is_bounded(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(held)
    center, values = rng.getrandbits(64), set()
    while len(values) < 250:
        value = center
        for _ in range(rng.randint(0, 6)):
            value ^= 1 << rng.randrange(24)
        values.add(value - (1 << 64) if value >> 63 else value)
    links = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"))
    found = {r.node: r.root for r in components(links).collect()}
    want = brute.components({v: v & (2**64 - 1) for v in values})
    groups = lambda of: {frozenset(v for v in values if of(v) == r) for r in map(of, values)}
    assert groups(lambda v: found.get(v, v)) == groups(want.get)


def test_components_of_long_paths(spark):
    path = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150)]
    random.Random(1).shuffle(path)
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 150: 100, 200: 100}


# --- 2: exact duplicates --------------------------------------------------------------------------


def check_exact(docs, given, **bounds):
    def normal(t):
        return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")

    groups = {}
    for i, t in given:
        groups.setdefault(normal(t), []).append((i, t or ""))
    want = Counter()
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for i, t in members:
            kept = i is not None and i == keep[0] and len(t) == len(keep[1])
            want[i, keep[0], len(members), kept, brute.digest(text)] += 1
    found = exact.exact_duplicates(docs, **bounds).drop("text_key").collect()
    assert Counter(map(tuple, found)) == want


def test_exact_duplicates(docs):
    check_exact(docs, ROWS)


def test_exact_duplicates_with_subtrees_given_up(docs):
    check_exact(docs, ROWS, trie_bytes=300)


def test_exact_duplicates_of_nothing(none):
    assert exact.exact_duplicates(none).collect() == []


@given(st.lists(st.binary(max_size=6), max_size=40))
def test_tries_hold_what_was_put_in(keys):
    trie = exact.PatriciaTrie()
    for key in keys:
        node = trie.node(key)
        node.terminal = (node.terminal or 0) + 1
    assert dict(trie.terminals()) == Counter(keys)


# --- 3: byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    path, pattern = multi_tokenizer()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(docs, reference):
    path, pattern = multi_tokenizer()
    coded = bpe.decode(bpe.encode(docs, path, pattern), path).collect()
    assert len(coded) == len(ROWS)
    for r in coded:
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "") and r.length == 6


def test_coding_nothing(none):
    path, pattern = multi_tokenizer()
    assert bpe.decode(bpe.encode(none, path, pattern), path).collect() == []


def test_null_ids_and_unknown_ids(spark):
    path, _ = multi_tokenizer()
    rows_in = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows_in, path).orderBy("k").collect()][:2] == [None, b""]
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>"), path).collect()


@pytest.fixture(scope="module")
def coder():
    path, pattern = multi_tokenizer()
    return bpe.Coder(bpe.read_ranks(path), pattern)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text("abtheing ", max_size=400), max_size=4))
def test_any_text_encodes_as_the_public_library_does(coder, reference, content):
    assert coder.encode(content).to_pylist() == [reference.encode_ordinary(t) for t in content]


def test_new_words_are_contracted_a_few_at_a_time(coder, reference, monkeypatch):
    given_out = []

    class Watched:
        def __init__(self, db):
            self.db = db

        def register(self, name, rows):
            given_out.append(len(set(rows["w"].to_pylist())))
            self.db.register(name, rows)

        def __getattr__(self, name):
            return getattr(self.db, name)

    monkeypatch.setattr(bpe, "CONTRACTED", 3)
    monkeypatch.setattr(coder, "db", Watched(coder.db))
    content = ["qzxj wvkq zzyx qzxj jqwv kkxz vvqj", "x" * 300 + " wvkq", ""]
    assert coder.encode(content).to_pylist() == [reference.encode_ordinary(t) for t in content]
    assert len(given_out) >= 3 and max(given_out) <= 3


def test_words_of_one_query_are_about_as_long(coder, reference, monkeypatch):
    given_out = []

    class Watched:
        def __init__(self, db):
            self.db = db

        def register(self, name, rows):
            given_out.append([len(ids) for ids in rows["ids"].to_pylist()])
            self.db.register(name, rows)

        def __getattr__(self, name):
            return getattr(self.db, name)

    monkeypatch.setattr(bpe, "CONTRACTED_BYTES", 64)
    monkeypatch.setattr(coder, "db", Watched(coder.db))
    words = [k * c for c in ("qj", "kz", "vw", "xq") for k in (2, 3, 15)]
    content = [" ".join(words)]
    assert coder.encode(content).to_pylist() == [reference.encode_ordinary(t) for t in content]
    assert all(sum(lengths) <= 64 for lengths in given_out)
    lengths = [n for some in given_out for n in some]
    assert len(lengths) >= 11 and lengths == sorted(lengths)


def test_workers_give_back_what_they_freed(spark):
    def filled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"x" * (1 << 20)] * 8)], names=["b"]).slice(0, 1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pa.total_allocated_bytes()])], names=["n"])

    rows_in = spark.range(1).coalesce(1)
    assert rows_in.mapInArrow(released(filled), "b binary").select(F.length("b")).first()[0] == 1 << 20
    assert rows_in.mapInArrow(released(held), "n long").first().n < 1 << 20


# --- 4: quality -----------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    held = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").select(
        (F.col("kept") == (labels["quality"] == 1)).alias("right")
    )
    total, right = held.agg(F.count(F.lit(1)), F.count_if("right")).first()
    assert total > 100 and right >= 0.95 * total


def test_quality_of_nasty_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (9, None), (None, 1), (3, 7)], "doc_id long, quality int")
    judged = quality.classify(docs, labels).collect()
    assert len(judged) == len(ROWS)
    assert all(r.quality is not None and 0 <= r.quality <= 1 for r in judged)
    unlabelled = quality.classify(docs, labels.where("quality = 0")).collect()
    assert all(r.kept and r.evidence == 0 and r.quality == 0.5 for r in unlabelled)
    assert quality.classify(none, labels).collect() == []


def test_sparse_sites_shrink_to_the_level_above(spark):
    good, bad = "A good text of several plain words here.", "BUY!! NOW!! CHEAP!!"
    rows_in = [(k, good if k % 10 else bad, "big", "a") for k in range(400)]
    rows_in += [(1000 + k, bad if k % 10 else good, "poor", "a") for k in range(400)]
    rows_in += [(2000, good, "poor", "rare"), (2001, good, "new", "b")]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, source string, lang string")
    labels = docs.select("doc_id", (F.col("text") == good).cast("int").alias("quality")).where("doc_id % 3 = 0")
    prior = {r.doc_id: r.prior for r in quality.classify(docs, labels).collect()}
    assert prior[0] > prior[2001] > prior[2000] and abs(prior[2000] - prior[1001]) < abs(prior[2000] - prior[0])


# --- 5: licences ----------------------------------------------------------------------------------


def test_licences_in_any_spelling(spark, none):
    mit = dict(license.KNOWN_LICENSES[::-1])["ISC"]
    texts = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ;")),
        (2, "before\nRELEASED under the MIT licence!\r\nafter"),
        (3, "Released under the MIT License, but not only"),
        (4, "Licensed under the Apache Licence, v2.0"),
        (5, None), (6, ""), (7, "Copyright 1999"), (8, "***"),
        (2, "Released under the MIT License."), (None, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("license", F.lit("x"))
    found = {(r.doc_id, r.license): (r.whole_text, r.n_paragraphs, r.n_lines) for r in license.scan_licenses(docs).collect()}
    assert found == {
        (1, "ISC"): (True, 2, 2), (2, "MIT"): (True, 1, 2), (4, "Apache-2.0"): (True, 1, 1),
        (None, "MIT"): (True, 1, 1),
    }
    assert license.scan_licenses(none).collect() == []
    assert license.scan_licenses(docs, docs.limit(0).select("license", "text")).collect() == []


def wrapped(text, width, before=""):
    import textwrap

    blocks = [textwrap.fill(b, width) for b in text.split("\n\n")]
    return "\n".join((before + line).rstrip() for line in "\n\n".join(blocks).split("\n"))


def test_licence_files_as_they_are_shipped(spark):
    of = {}
    for name, text in license.KNOWN_LICENSES:
        of[name] = max(of.get(name, ""), text, key=len)
    mit, bsd2, bsd3 = of["MIT"], of["BSD-2-Clause"], of["BSD-3-Clause"]
    texts = [
        (1, "MIT License\n\nCopyright (c) 2021 Some One\n\n" + wrapped(mit, 78)),
        (2, "The MIT License (MIT)\r\n\r\nCopyright © Some One <a@b.org>\r\n\r\n" + wrapped(mit, 70).replace("\n", "\r\n")),
        (3, "ISC License\n\nCopyright 2019 Some One\n\n" + wrapped(of["ISC"], 72)),
        (4, "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrapped(bsd3, 80)),
        (5, "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + wrapped(bsd2, 66)),
        (6, "#!/bin/sh\n#\n# Copyright 2015 Some One\n#\n" + wrapped(of["Apache-2.0"], 70, "# ") + "\n\necho code\n"),
        (7, "/*\n * Some program.\n *\n" + wrapped(of["GPL-3.0-or-later"], 66, " * ") + "\n *\n * More.\n */\nint main() {}"),
        (8, "Only this: the above copyright notice and this permission notice must stay."),
        (9, wrapped(bsd2.split("\n\n")[-1], 60)),  # a paragraph of two licences
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.license): (r.whole_text, r.n_paragraphs) for r in license.scan_licenses(docs).collect()}
    assert found == {
        (1, "MIT"): (True, 3), (2, "MIT"): (True, 3), (3, "ISC"): (True, 2), (4, "BSD-3-Clause"): (True, 1),
        (5, "BSD-2-Clause"): (True, 0), (6, "Apache-2.0"): (False, 2), (7, "GPL-3.0-or-later"): (False, 1),
    }


# --- 6: personal data -----------------------------------------------------------------------------


def test_base_spans_of_personal_data(docs, none):
    found = pii.find_personal_data(docs).collect()
    assert Counter((r.doc_id, tuple(spans(r.base))) for r in found) == Counter(
        (i, tuple(brute.personal(t))) for i, t in ROWS
    )
    assert pii.find_personal_data(none).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text("a@.-+1 2()%Z", max_size=60) | st.text("0123456789 -.+@a", max_size=120))
def test_any_text_has_the_base_spans(text):
    assert pii.base_spans(text) == brute.personal(text)


def test_patterns_find_unseen_identifiers(spark):
    texts = [(k, f"please write to user{k}@mail.org today") for k in range(40)]
    texts += [(k, f"some other user{k}x@thing here and there") for k in range(40, 50)]
    texts += [(100, "please write to agent@intranet today"), (100, "please write to agent@intranet today")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = pii.find_personal_data(docs)
    new = found.where("size(discovered) > 0").collect()
    assert [(r.doc_id, spans(r.discovered)) for r in new] == [(100, [(16, 0, 30)])] * 2
    assert all(spans(r.spans) == spans(r.discovered) for r in new)


def test_finds_become_seeds(spark):
    texts = [(k, f"please write to user{k}@mail.org today") for k in range(-900, -200)]
    # sixty that only the first pattern knows, also in a second one, and so on to a third
    texts += [(100 + k, f"please write to agent{k}@intranet today. Then ask for agent{k}@intranet there") for k in range(60)]
    texts += [(200 + k, f"Then ask for clerk{k}@office there, or see our clerk{k}@office instead") for k in range(3)]
    texts += [(300, "or see our other@place instead"), (301, "quite another thing@else altogether")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: [t[s.start : s.end] for s in r.discovered] for r, t in (
        (r, dict(texts)[r.doc_id]) for r in pii.find_personal_data(docs).collect()
    )}
    assert all(found[100 + k] == [f"agent{k}@intranet"] * 2 for k in range(60))
    assert all(f"clerk{k}@office" in found[200 + k] for k in range(3))
    # three of them are too few for a pattern of their own, so the finds end there
    assert found[300] == found[301] == [] and not any(found[k] for k in range(-900, -200))


@given(st.text("ab 0\n", max_size=40), st.integers(0, 40), st.integers(0, 5))
def test_contexts_are_whole_words(text, start, length):
    start = min(start, len(text))
    end = min(start + length, len(text))
    left, right = pii.Words(text).around(start, end)
    zero = lambda words: [re.sub("[0-9]+", "0", w) for w in words]
    assert left == zero(text[:start].split()[-2:]) and right == zero(text[end:].split()[:1])


# --- 7: URLs --------------------------------------------------------------------------------------

RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
)


def test_verdicts(spark):
    pages = [
        (1, "https://a.example.net/en/1?x=/y#z", "a.example.net", "/en/1", "example.net/en/", "allow"),
        (2, "http://EXAMPLE.NET/EN/1", "example.net", "/EN/1", "net/", "block"),
        (3, "http://net", "net", "", None, "allow"), (4, "http://net/", "net", "/", "net/", "block"),
        (5, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (6, "ftp://x.example.com/de/?q", "x.example.com", "/de/", "example.com/de/", "block"),
        (7, None, "", "", None, "allow"), (8, "", "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"),
        (10, "http://e.com/x.net/", "e.com", "/x.net/", None, "allow"),
        (11, "http://free-bets.org/p", "free-bets.org", "/p", None, "block"),
        (12, "http://x.org/bets", "x.org", "/bets", None, "allow"),
        (13, "http://x.org/" + "é" * 9000, "x.org", "/" + "é" * 9000, None, "allow"),
        (13, "http://x.net/?a://b", "x.net", "/", "net/", "block"), (None, "a://", "", "", None, "allow"),
    ]
    rows_in = spark.createDataFrame([(p[0], p[1], "html", "h") for p in pages], "page_id long, url string, html string, host string")
    found = urls.judge_urls(rows_in, RULES).collect()
    assert Counter(map(tuple, found)) == Counter((p[0], *p[2:]) for p in pages)
    assert urls.judge_urls(rows_in.limit(0), RULES).collect() == []


@given(st.lists(st.text("ab/*", max_size=30), min_size=1, max_size=12), st.lists(st.text("ab/", max_size=80), min_size=1, max_size=5))
def test_automaton_takes_what_the_globs_mean(globs, texts):
    import re

    def regex(glob):
        parts = re.findall(r"\*+|[^*]", glob)
        return "".join("[^/]*" if p == "*" else ".*" if p[0] == "*" else re.escape(p) for p in parts)

    got = urls.GlobAutomaton(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[bool(re.fullmatch(regex(g), t)) for g in globs] for t in texts]


# --- 8: benchmark ---------------------------------------------------------------------------------

ITEM = (
    "A train leaves Paris at 9 and travels 120 km before it meets Anna who has walked 120 km from "
    "the other town and asks how long the journey of the train has taken so far"
)


def test_leaks_with_other_values(spark, none):
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "too short here"), (7, ITEM)], "item_id long, text string")
    changed = ITEM.replace("Paris", "Rome").replace("120", "75").replace("Anna", "Peter")
    torn = ITEM.replace("120", "75", 1).replace("Paris", "Oslo")
    texts = [
        (1, f"Some words before it. {ITEM} And more."), (2, changed), (3, torn), (4, None), (5, ""),
        (6, ITEM[: len(ITEM) // 3]), (7, "Nothing of it in this text of quite a few words at all"),
        (1, f"Some words before it. {ITEM} And more."), (None, ITEM.upper().lower()),
        (8, f"{changed} " + "word " * 20000 + ITEM),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("window", F.lit(1))
    items = items.dropDuplicates(["item_id", "text"])
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items, agreement=1.0).collect()}
    assert set(found) == {(1, 7), (2, 7), (8, 7), (None, 7)}
    assert found[1, 7].n_changed == 0 and found[2, 7].n_changed > 0
    assert decontaminate.find_leaks(none, items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []


def test_leaks_in_another_letter_case_and_with_edits(spark):
    short = "plain words of a short question that ask for the way to the station now"
    items = spark.createDataFrame([(7, ITEM), (8, short)], "item_id long, text string")
    words = short.split()
    texts = [
        (1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.title()), (4, "heading\n" + ITEM.upper() + "\nend"),
        (5, " ".join([*words[:7], "changed", *words[8:]])), (6, short.title()),
        (7, "Nothing of it, though It Has Capital Letters And Many Words Like A Title Would Have Them"),
        (8, " ".join(words[::2])),
    ]
    found = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (2, 7), (3, 7), (4, 7), (5, 8), (6, 8)}


def plain_leaks(texts, items, window=8, least=4, coverage=0.5, agreement=0.8, passage=13):
    """find_leaks word by word: (doc, item, windows found, windows of the item)."""

    def forms(text):
        out, begins = [], True
        for line in (text or "").split("\n"):
            begins = True
            for word in line.split():
                plain = word.strip(decontaminate._EDGES)
                kind = ""
                if decontaminate._NUMBER.fullmatch(plain):
                    kind = "<number>"
                elif plain.lower() in decontaminate.UNITS:
                    kind = "<unit>" if out and out[-1][1] == "<number>" and not begins else ""
                elif plain[:1].isupper() and not begins:
                    kind = "<name>"
                out.append((plain.lower(), kind))
                begins = word.endswith(decontaminate._ENDS)
        return [out, [(w, "" if k == "<name>" else k) for w, k in out]]

    def windows(text, length):
        for form in forms(text):
            for at in range(len(form) - length + 1):
                yield at, tuple(k or w for w, k in form[at : at + length]), [(k, w) for w, k in form[at : at + length] if k]

    def longest(places):
        return max(next(n for n in range(1, len(places) + 1) if p + n not in places) for p in places)

    found = set()
    for item, item_text in items:
        n = len((item_text or "").split())
        length = n if n <= window else max(5, min(window, n // 3))
        own = [w for w in windows(item_text, length) if sum(not t.startswith("<") for t in w[1]) >= least]
        if length < least or not own:
            continue
        total = len({at for at, _, _ in own})
        for doc, text in texts:
            diagonals = {}
            for at, key, slots in windows(text, length):
                for place, other, item_slots in own:
                    if key == other:
                        places, pairs = diagonals.setdefault(at - place, (set(), set()))
                        places.add(place)
                        pairs.update(zip(item_slots, slots))
            agreed = [p for p, pairs in diagonals.values() if len({i for i, _ in pairs}) >= agreement * len(pairs)]
            covered = set().union(*agreed) if agreed else set()
            run = max(map(longest, agreed), default=0)
            if len(covered) >= coverage * total and covered or run and run + length - 1 >= passage:
                found.add((doc, item, len(covered), total))
    return found


def test_leaks_against_a_plain_form(spark):
    rng = random.Random(21)
    words = ["the", "river", "Anna", "Paris", "12", "km", "7", "was", "long.", "Peter", "asked", "how", "far", "it"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, make(rng.choice((5, 8, 12, 15, 24, 40)))) for k in range(25)]
    texts = []
    for k in range(120):
        own = rng.choice(items)[1].split()
        at = rng.randrange(len(own))
        cut = own[rng.randrange(3) :] if rng.random() < 0.5 else own
        cut = [rng.choice(words) if rng.random() < 0.07 else w for w in cut]
        text = " ".join([make(5), *cut[:at], *(["\n"] if rng.random() < 0.2 else []), *cut[at:], make(6)])
        texts.append((k, rng.choice((str.upper, str.lower, str.title, str, str))(text)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(texts, items)
    assert len(want) > 60
    assert {(r.doc_id, r.item_id, r.n_windows, r.n_item_windows) for r in got} == want


def test_passages_of_long_items_are_leaks(spark):
    words = [f"plain{k}" for k in range(59)]
    texts = [(k, f"before it {' '.join(words[10 : 10 + n])} and after it") for k, n in enumerate((32, 13, 12, 59))]
    texts.append((9, " and then ".join(" ".join(words[k : k + 9]) for k in (0, 20, 40))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: (r.n_windows, r.n_item_windows) for r in decontaminate.find_leaks(docs, items).collect()}
    assert found == {0: (25, 52), 1: (6, 52), 3: (42, 52)}


def test_leaks_are_all_verbatim_passages(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    held = items.collect()
    assert found == {(d.doc_id, i.item_id) for d in docs.collect() for i in held if i.text in d.text}


# --- 9: secrets -----------------------------------------------------------------------------------


def test_base_spans_of_secrets(docs, none):
    found = secrets.find_secrets(docs).collect()
    assert Counter((r.doc_id, tuple(spans(r.base))) for r in found) == Counter(
        (i, tuple(brute.secrets(t))) for i, t in ROWS
    )
    assert secrets.find_secrets(none).collect() == []


def test_secret_spans_of_odd_texts(spark):
    random.seed(11)
    pieces = ["password", "PassWD", "ſecret", "token=", ": ", '"', "'", "=", "AKIA", "ABCDEF0123456789", "deadbeef01", " ", "é😀", "\n"]
    texts = [(k, "".join(random.choice(pieces) for _ in range(random.randint(0, 40)))) for k in range(400)]
    found = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: spans(r.base) for r in found} == {i: brute.secrets(t) for i, t in texts}


def test_random_tokens_are_told_from_long_words(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["ing", "tion", "er", "an", "the", "ed", "on", "re"]

    def word(n):
        return "".join(rng.choice(syllables) for _ in range(n))[:n]

    texts = [(k, f"so {word(40)} then {word(44)}") for k in range(400)]
    texts += [(1000 + k, "key " + "".join(rng.choice(letters) for _ in range(40)) + " end") for k in range(40)]
    texts += [(2000 + k, f"see {word(30)}{k % 10}{word(9)} end") for k in range(40)]
    found = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"))
    caught = {r.doc_id for r in found.where("size(discovered) > 0").collect()}
    assert len([d for d in caught if 1000 <= d < 2000]) >= 34
    assert len([d for d in caught if d >= 2000 or d < 1000]) <= 3


def test_long_secrets_in_prose_without_long_words(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    short = "the river was low in that summer and people walked over stones to reach an island where nobody lived".split()

    def token(n):
        return "".join(rng.choice(letters) for _ in range(n - 1)) + "7"

    def prose():
        return " ".join(rng.choice(short) for _ in range(60))

    texts = [(k, prose()) for k in range(600)]
    texts += [(1000 + k, f"{prose()} {token((32, 40, 64, 90)[k % 4])} {prose()}") for k in range(80)]
    texts += [(2000 + k, f"{prose()} {'-'.join(rng.choice(short) for _ in range(9))}-{k} {prose()}") for k in range(40)]
    found = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"))
    caught = {r.doc_id for r in found.where("size(discovered) > 0").collect()}
    for kind in range(4):
        assert len([d for d in caught if 1000 <= d < 2000 and d % 4 == kind]) >= 16
    assert len([d for d in caught if d < 1000 or d >= 2000]) <= 4
    alone = spark.createDataFrame([(1, f"use {token(40)} here"), (2, "use " + "abcabcabc1" * 4)], "doc_id long, text string")
    assert [r.doc_id for r in secrets.find_secrets(alone).where("size(discovered) > 0").collect()] == [1]


def test_texts_of_very_many_spans_take_time_in_proportion(spark):
    import time

    texts = [(k, "token=abcdef " + "x" * 22 + "7 deadbeef0123456789abcdef01 ") for k in range(3)]
    texts = [(k, t * n) for (k, t), n in zip(texts, (20, 2_000, 16_000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    start = time.time()
    found = secrets.find_secrets(docs).collect()
    assert {r.doc_id: spans(r.base) for r in found} == {i: brute.secrets(t) for i, t in texts}
    assert time.time() - start < 60


def test_spans_apart_from_others(spark):
    from calibrel.llm.native import apart_from

    rng, rows = random.Random(4), []
    for k in range(200):
        ones, others = ([], [])
        for out in (ones, others):
            at = rng.randrange(5)
            for _ in range(rng.randrange(9)):
                end = at + rng.randrange(1, 6)
                out.append((at, end))
                at = end + rng.randrange(6)
        rows.append((k, ones, others))
    kind = "array<struct<start:bigint,end:bigint>>"
    df = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}")
    got = {r.k: [tuple(s) for s in r.c] for r in df.select("k", apart_from(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {k: [s for s in a if not any(s[0] < o[1] and o[0] < s[1] for o in b)] for k, a, b in rows}


# --- 10: repeated strings -------------------------------------------------------------------------


def check_repeats(docs, given, least=200, gram=32):
    cover = brute.repeated_bytes([t for _, t in given], least)
    want = Counter()
    for (i, t), marks in zip(given, cover):
        data = (t or "").encode()
        kept = bytes(b for b, gone in zip(data, marks) if not gone)
        edges = [k for k, gone in enumerate(marks) if gone and not (k and marks[k - 1])]
        want[i, len(data), sum(marks), len(edges), hashlib.sha256(kept).hexdigest()] += 1
    found = suffix.remove_repeats(docs, least=least, gram=gram).collect()
    got = Counter(
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
        for r in found
    )
    assert got == want


def test_repeats(docs, none):
    assert len(PASSAGE.encode()) > 200
    check_repeats(docs, ROWS)
    assert suffix.remove_repeats(none).collect() == []


@pytest.mark.parametrize("most_forms", [2048, 2])
def test_repeats_in_crowded_anchors(spark, monkeypatch, most_forms):
    monkeypatch.setattr(suffix, "MOST_FORMS", most_forms)
    monkeypatch.setattr(suffix, "BLOCK", 300)
    rng = random.Random(9)
    common = "".join(rng.choice("abcd ") for _ in range(120))
    texts = []
    for k in range(60):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 80))) for _ in range(2))
        cut = rng.randint(0, 40)
        texts.append((k, a + common[cut : rng.randint(60, 120)] + b))
    texts += [(100, "a" * 900), (101, "ab" * 300), (102, common * 3), (102, common * 3)]
    check_repeats(spark.createDataFrame(texts, "doc_id long, text string"), texts, least=40, gram=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=60).map(lambda b: bytes(c % 3 for c in b)), min_size=1, max_size=8))
def test_interval_expansion_marks_repeated_windows(forms):
    seen = Counter(f[i : i + 5] for f in forms for i in range(len(f) - 4))
    got = [m.tolist() for m in suffix.repeated_windows(forms, 5)]
    assert got == [[seen[f[i : i + 5]] > 1 for i in range(len(f) - 4)] for f in forms]
