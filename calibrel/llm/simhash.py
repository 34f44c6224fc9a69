"""SimHash near-duplicates by meeting in the middle of the Hamming ball.

Two fingerprints that differ in at most ``radius`` bits have a value between them that is within
half the radius of both (rounded down for fingerprints with an even number of ones, up for an odd
number: an odd distance always joins one of each). So every fingerprint stands for all variants
within its half, and equal variants are collisions.

Variants are dealt out by their leading bits. A fingerprint is sent once to each head that one of
its variants has, and the variants of the remaining bits are made and sorted where they meet:
the same variants, in a few dozen rows instead of thousands. Heads that are dealt more fingerprints
than a task should hold are told apart by more of the variants' bits, again and again; a whole
variant has no more than its ball. Fingerprints are deduplicated first, so copies cost nothing here.

Within a variant's bucket every fingerprint is linked to one that is within the smaller half, and
the links of a head leave as a spanning forest, so a dense cloud of near copies gives as many
links as it has fingerprints, and no two of them are lost to each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import if_small, released, text_key, texts, written
from calibrel.llm.graph import components

BITS = 64
SEED = 42
RADIUS = 3
BLOCK = 1 << 20
MORE_BITS = 12
#: Fingerprints dealt to one head beyond which it is split by ``MORE_BITS``.
HELD = 1 << 14
VARIANTS_HELD = 1 << 22

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = np.arange(8, dtype=np.uint16) * 256


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of ASCII-lower-cased words, a block of the text at a time."""
    text, at, held, seen = text.translate(_LOWER), 0, [], False
    while at < len(text):
        gap = _SPACE.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        block = held + text[at:end].split()
        at = end
        if len(block) < words:
            held = block
            continue
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(block) - words + 1].tolist()
        joined = b" ".join(block)
        shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1 :].tolist())]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        held, seen = block[len(block) - words + 1 :], True
    if held and not seen:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, words: int) -> int:
    """64 bits, each set if set in over half the shingle hashes; zero without words."""
    ones, n = np.zeros((8, 256), np.int64), 0
    for hashes in shingle_hashes(text, words):
        split = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS
        ones += np.bincount(split.ravel(), minlength=2048).reshape(8, 256)
        n += len(hashes)
    bits = (ones @ _BYTE_BITS).ravel() * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, keys = [], []
            for text in batch["text"]:
                content = text.as_py()
                marks.append(fingerprint(content.encode(), words))
                keys.append(text_key(content))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(keys, pa.int64()), pa.array(marks, pa.int64())],
                names=["doc_id", "text_key", "fingerprint"],
            )

    return run


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of the low ``bits`` bits, by their number of ones."""
    masks = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array(masks, np.uint64)


def reach(fingerprints: np.ndarray, radius: int) -> np.ndarray:
    """Half the radius: rounded down for an even number of ones, up for an odd one."""
    odd = np.bitwise_count(fingerprints) & 1
    return (radius + odd * (radius & 1)).astype(np.int64) // 2


def _dealt(radius: int, done: int, bits: int, width: int):
    """Rows of head and fingerprint, dealt out once more by the next ``bits`` bits of the variants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch["fingerprint"].to_numpy().view(np.uint64)
            before = batch["head"].to_numpy().view(np.uint64)
            for start in range(0, len(every), 4096):
                values, heads = every[start : start + 4096], before[start : start + 4096]
                left = _left(values, heads, done, radius, width)
                own = (values >> np.uint64(width - done - bits)) & np.uint64((1 << bits) - 1)
                for most in np.unique(left):
                    chosen, masks = np.flatnonzero(left == most), flips(bits, int(most))
                    key = heads[chosen][:, None] << np.uint64(bits) | own[chosen][:, None] ^ masks
                    yield _pairs(key.ravel(), np.repeat(values[chosen], len(masks)), ("head", "fingerprint"))

    return run


def _left(values: np.ndarray, heads: np.ndarray, bits: int, radius: int, width: int) -> np.ndarray:
    """How many bits the variants may still change behind their first ``bits``, which ``heads`` have."""
    if not bits:
        return reach(values, radius)
    return reach(values, radius) - np.bitwise_count((values >> np.uint64(width - bits)) ^ heads).astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (left, right)], names=list(names)
    )


def bucket_links(values: np.ndarray, used: np.ndarray, rest: np.ndarray, bits: int, radius: int):
    """Links between fingerprints whose variants of the low ``bits`` bits are equal.

    ``used`` is how far a variant is already, ``rest`` how far it may still go. Where too many
    variants would be held at once, the next bits are fixed first, one value after the other.
    """
    sizes = {k: len(flips(bits, k)) for k in map(int, np.unique(rest))}
    if bits > 8 and len(values) > 1 and sum(sizes[int(k)] for k in rest) > VARIANTS_HELD:
        bits -= 4
        own = (values >> np.uint64(bits)) & np.uint64(15)
        for nibble in range(16):
            step = np.bitwise_count(own ^ np.uint64(nibble)).astype(np.int64)
            near = step <= rest
            yield from bucket_links(values[near], used[near] + step[near], rest[near] - step[near], bits, radius)
        return
    variants, owners, ranks = [], [], []
    for most in sizes:
        chosen, masks = np.flatnonzero(rest == most), flips(bits, most)
        low = values[chosen] & np.uint64((1 << bits) - 1)
        variants.append((low[:, None] ^ masks).ravel())
        owners.append(np.repeat(chosen, len(masks)))
        ranks.append((used[chosen][:, None] + np.bitwise_count(masks).astype(np.int64)).ravel())
    if not variants:
        return
    variant, owner, rank = map(np.concatenate, (variants, owners, ranks))
    order = np.argsort(variant)
    variant, owner, rank = variant[order], owner[order], rank[order]
    new = np.r_[True, variant[1:] != variant[:-1]]
    bucket = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    shared = np.diff(np.r_[starts, len(variant)])[bucket] > 1
    if not shared.any():
        return
    bucket, owner, rank = bucket[shared], owner[shared], rank[shared]
    hub = np.full(bucket.max() + 1, len(values), np.int64)
    close = rank <= radius // 2
    np.minimum.at(hub, bucket[close], owner[close])
    middle = hub[bucket]
    linked = (middle < len(values)) & (middle != owner)
    pairs = np.unique(middle[linked] * len(values) + owner[linked])
    left, right = values[pairs // len(values)], values[pairs % len(values)]
    right_ones = np.bitwise_count(left ^ right) <= radius
    yield from zip(left[right_ones].tolist(), right[right_ones].tolist())


def spanning_forest(links) -> list[tuple[int, int]]:
    """(node, smallest node of its component) for the nodes of the links."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(node, root(node)) for node in list(parent) if root(node) != node]


def _links(radius: int, width: int):
    def of_head(bits: int, head: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values = np.unique(np.concatenate(parts))
        heads = np.full(len(values), head, np.int64).view(np.uint64)
        rest = _left(values, heads, bits, radius, width)
        used = reach(values, radius) - rest
        forest = spanning_forest(bucket_links(values, used, rest, width - bits, radius))
        pairs = np.array(forest, np.uint64).reshape(-1, 2)
        return _pairs(pairs[:, 0], pairs[:, 1], ("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            bits, heads = batch["bits"].to_numpy(), batch["head"].to_numpy()
            values = batch["fingerprint"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(heads) != 0) | (np.diff(bits) != 0)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(heads)]):
                if start == end:
                    continue
                own = int(bits[start]), int(heads[start])
                if own != now and held:
                    yield of_head(*now, held)
                    held = []
                now = own
                held.append(values[start:end].copy())
        if held:
            yield of_head(*now, held)

    return run


def ball_links(fingerprints: DataFrame, radius: int = RADIUS, width: int = BITS) -> DataFrame:
    """``u, v``: links that join all of the distinct ``fingerprint`` of ``width`` bits within ``radius``."""
    n, bits, kind = fingerprints.count(), 0, "head long, fingerprint long"
    rows, dealt = fingerprints.select(F.lit(0).cast("long").alias("head"), "fingerprint"), None
    more = max(8, min(24, n.bit_length() - 8))
    while True:
        rows, bits = rows.mapInArrow(released(_dealt(radius, bits, more, width)), kind), bits + more
        # What is dealt out, not what has the head itself: neighbours of a full head are as full.
        heavy = written(rows.groupBy("head").count().where(F.col("count") > HELD).select("head"), "heavy-heads")
        many = heavy.count() if bits < width else 0
        light = rows.join(if_small(heavy, many * 16), "head", "left_anti") if many else rows
        light = light.select(F.lit(bits).alias("bits"), "head", "fingerprint")
        dealt = light if dealt is None else dealt.union(light)
        if not many:
            break
        rows = written(rows.join(if_small(heavy, many * 16), "head", "left_semi"), "full-heads")
        more = min(MORE_BITS, width - bits)
    return (
        dealt.repartition("bits", "head")
        .sortWithinPartitions("bits", "head")
        .mapInArrow(released(_links(radius, width)), "u long, v long")
    )


def near_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = 3,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, fingerprint, component_id``.

    The fingerprint is written as 16 hexadecimal digits; rows whose fingerprints differ in at most
    ``radius`` bits are linked, and ``component_id`` is the smallest id reachable over links. Texts
    of fewer than ``words`` words have the whole sequence as one shingle. Null and empty ones have
    fingerprint zero and are linked like any other. Null ids never name a component unless all its
    ids are null; repeated rows are kept. ``text_key`` is a hash of the text; other columns are left.
    """
    docs = texts(df, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = "doc_id long, text_key long, fingerprint long"
    marked = written(docs.mapInArrow(released(_fingerprints(words)), fields), "fingerprints")
    firsts = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(ball_links(firsts, radius))
    grouped = firsts.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("group")
    )
    named = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    classes = grouped.join(named, "group").select("fingerprint", "component_id")
    return marked.join(classes, "fingerprint").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
