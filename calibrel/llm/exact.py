"""Exact deduplication by owners in Patricia tries.

Texts are equal when equal without the bytes of ``[\\x20\\x09-\\x0D]``. Each scan partition first
inserts its whole normalised texts into a trie of its own; a terminal node holds how many texts
end there and the owner, so copies within the partition leave it as one entry. What is left is
dealt out by length and content hash, so that one partition holds all entries of a text, and the
tries there give the owner of the whole table. A hot text thus reaches its last task at most once
per trie, however many rows have it.

Memory is bounded by bytes held: a trie over its bound gives up its largest subtree. The entries
below it go on to the next step as they are and later texts with the same beginning start anew,
so nothing is written outside Spark's shuffle. The last tries get their entries in order of length
and hash and are emptied whenever that key changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import released, text_key, texts, written

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
TRIE_BYTES = 16 << 20
#: What a node, its terminal and its place in a parent take besides the label, as measured.
NODE_BYTES = 600

_ENTRIES = (
    "doc_id long, entry string, text_sha256 string, text_key long, length long, hash long, n_points long, "
    "owner_id long, owner_points long, copies long, body binary"
)


class Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes, terminal=None):
        self.label, self.terminal, self.children = label, terminal, {}


class PatriciaTrie:
    """Whole byte strings in edges that hold as many bytes as have no branch."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def node(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if it is new."""
        at, done = self.root, 0
        while done < len(key):
            child = at.children.get(key[done])
            if child is None:
                child = at.children[key[done]] = Node(key[done:])
                self.held += len(child.label) + NODE_BYTES
                return child
            if key.startswith(child.label, done):
                at, done = child, done + len(child.label)
                continue
            same = self._shared(child.label, key, done)
            middle = Node(child.label[:same])
            self.held += NODE_BYTES
            child.label = child.label[same:]
            middle.children[child.label[0]] = child
            at.children[middle.label[0]] = middle
            at, done = middle, done + same
        return at

    @staticmethod
    def _shared(label: bytes, key: bytes, start: int) -> int:
        low, high = 0, min(len(label), len(key) - start)
        while low < high:
            middle = (low + high + 1) // 2
            if label[:middle] == key[start : start + middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        return self._below([(self.root, b"")])

    @staticmethod
    def _below(stack) -> Iterator[tuple[bytes, object]]:
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.terminal is not None:
                yield key, node.terminal
            stack.extend((child, key) for child in node.children.values())

    def give_up_largest(self) -> list[tuple[bytes, object]]:
        """Take out the subtree below the root that holds most bytes; its terminals."""
        sizes = {}
        for first, child in self.root.children.items():
            stack, total = [child], 0
            while stack:
                node = stack.pop()
                total += len(node.label) + NODE_BYTES
                stack.extend(node.children.values())
            sizes[first] = total
        first = max(sizes, key=sizes.get)
        self.held -= sizes[first]
        return list(self._below([(self.root.children.pop(first), b"")]))


def better(points: int, doc_id: int | None, than_points: int, than_id: int | None) -> bool:
    """More code points first, then the smaller id; a null id comes last."""
    if points != than_points:
        return points > than_points
    return doc_id is not None and (than_id is None or doc_id < than_id)


def _first_tries(trie_bytes: int):
    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, n = PatriciaTrie(), 0
        prefix = None

        def rows_of(terminals):
            rows = []
            for body, (entry, digest, owner, points, copies) in terminals:
                rows.append((None, entry, digest, None, len(body), _hash(body), None, owner, points, copies, body))
                if sum(map(len, (r[-1] for r in rows[-64:]))) > 4 << 20 or len(rows) >= 2048:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

        for batch in batches:
            members = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                body = text.encode().translate(None, WHITESPACE)
                node = trie.node(body)
                if node.terminal is None:
                    digest = hashlib.sha256(body).hexdigest()
                    if prefix is None:
                        prefix = _task_prefix()
                    node.terminal = [f"{prefix}-{n}", digest, doc_id, len(text), 0]
                    n += 1
                held = node.terminal
                held[4] += 1
                if better(len(text), doc_id, held[3], held[2]):
                    held[2], held[3] = doc_id, len(text)
                members.append((doc_id, held[0], held[1], text_key(text), None, None, len(text), None, None, None, None))
                while trie.held > trie_bytes:
                    yield from rows_of(trie.give_up_largest())
            yield _batch(members)
        yield from rows_of(trie.terminals())

    return insert


def _task_prefix() -> str:
    from pyspark import TaskContext

    return str(TaskContext.get().partitionId())


def _hash(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


_ENTRY_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("entry", pa.string()), ("text_sha256", pa.string()),
        ("text_key", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("n_points", pa.int64()),
        ("owner_id", pa.int64()), ("owner_points", pa.int64()), ("copies", pa.int64()),
        ("body", pa.binary()),
    ]
)
_OWNER_SCHEMA = pa.schema(
    [("entry", pa.string()), ("keep_id", pa.int64()), ("keep_points", pa.int64()), ("group_size", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema = _ENTRY_SCHEMA) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, field.type) for c, field in zip(columns, schema)], schema=schema
    )


def _last_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, key, out = PatriciaTrie(), None, []

    def owners():
        for _, (owner, points, copies, entries) in trie.terminals():
            out.extend((entry, owner, points, copies) for entry in entries)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("length", "hash", "body", "entry", "owner_id", "owner_points", "copies")]
        for length, digest, body, entry, owner, points, copies in zip(*columns):
            if (length, digest) != key:
                owners()
                trie, key = PatriciaTrie(), (length, digest)
            node = trie.node(body)
            if node.terminal is None:
                node.terminal = [owner, points, 0, []]
            held = node.terminal
            held[2] += copies
            held[3].append(entry)
            if better(points, owner, held[1], held[0]):
                held[0], held[1] = owner, points
        if len(out) >= 4096:
            yield _batch(out, _OWNER_SCHEMA)
            out = []
    owners()
    yield _batch(out, _OWNER_SCHEMA)


def exact_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, text_key``.

    Of equal texts the one with most code points before normalising stays, then the smallest id;
    ``keep_id`` is its id. Null texts count as empty and all empty ones are equal. A null id never
    wins over another; where all ids of a text are null, ``keep_id`` is null and no row is kept by
    id. Of repeated rows (equal id and text) each counts in ``group_size`` and each is marked kept
    if its id is. ``text_key`` is a hash of the whole text. Other columns are left behind. ``trie_bytes`` bounds a trie.
    """
    found = written(
        texts(df, id_column, text_column)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
        .mapInArrow(released(_first_tries(trie_bytes)), _ENTRIES),
        "trie-entries",
    )
    owners = (
        found.where(F.col("body").isNotNull())
        .select("length", "hash", "body", "entry", "owner_id", "owner_points", "copies")
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash")
        .mapInArrow(released(_last_tries), "entry string, keep_id long, keep_points long, group_size long")
    )
    members = found.where(F.col("body").isNull()).select("doc_id", "entry", "text_sha256", "text_key", "n_points")
    kept = (F.col("doc_id") == F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return members.join(owners, "entry").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(kept, F.lit(False)).alias("kept"),
        "text_sha256",
        "text_key",
    )
