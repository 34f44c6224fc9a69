"""The pipeline stage by stage, each against a plain form on what the one before it kept."""

import base64
from collections import Counter

import brute
import corpus_pipeline as pipeline
import tiktoken
from conftest import rows

from calibrel.llm import quality
from calibrel.llm.queries import multi_tokenizer

SF_DIR = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)
    assert [name for name, _ in pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"
    ]

    good = stages["quality classifier"](spark, docs, SF_DIR)
    judged = quality.classify(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).collect()
    before, now = texts(docs), texts(good)
    assert good.columns == columns and now.keys() == {r.doc_id for r in judged if r.kept}
    assert len(now) < len(before)

    exact = stages["exact dedup"](spark, good, SF_DIR)
    groups = {}
    for i, t in now.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append(i)
    want = {min(ids, key=lambda i: (-len(now[i]), i)) for ids in groups.values()}
    now = texts(exact)
    assert exact.columns == columns and now.keys() == want

    near = stages["SimHash near-dedup"](spark, exact, SF_DIR)
    groups = brute.components({i: brute.fingerprint(t) for i, t in now.items()})
    now = texts(near)
    assert near.columns == columns and now.keys() == set(groups.values())

    clean = stages["benchmark decontamination"](spark, near, SF_DIR)
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    want = {i for i, t in now.items() if not any(item in t for item in items)}
    now = texts(clean)
    assert clean.columns == columns and now.keys() == want

    path, pattern = multi_tokenizer()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = {r.doc_id: r for r in stages["byte-level BPE"](spark, clean, SF_DIR).collect()}
    assert coded.keys() == now.keys()
    assert all(r.decoded == now[i] and r.ids == coder.encode_ordinary(now[i]) for i, r in coded.items())
    assert {r.doc_id for r in pipeline.run(spark, SF_DIR).select("doc_id").collect()} == coded.keys()


def test_stages_on_nasty_rows_and_on_none(spark, docs, none):
    kept = {name: stage(spark, docs, SF_DIR) for name, stage in pipeline.STAGES}
    assert all(df.columns == docs.columns for name, df in list(kept.items())[:-1])
    held = kept["exact dedup"].collect()
    assert len(held) == len({(r.doc_id, r.text) for r in held})
    # one row of each text, and of each that has only null ids
    normal = Counter("".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r") for r in held)
    assert set(normal.values()) == {1} and len(normal) == len(
        {"".join(c for c in r[1] or "" if c not in " \t\n\x0b\x0c\r") for r in rows()}
    )
    assert kept["byte-level BPE"].count() == len(rows())
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, SF_DIR).collect() == []
