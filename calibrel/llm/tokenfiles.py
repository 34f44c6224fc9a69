"""Token ids in binary files: encoded by a tokenizers file, coded by ``mixing``, read back.

A folder of files in ascending order of ids of documents. A file is a sequence of blocks, each
followed by a newline; all numbers are little-endian:

======================  =====================================================================
``CMX1``, version 1     magic, 4 bytes
u32 x 7                 part, block, ids, ids of the vocabulary, documents, lanes, 16-bit words
u32 per lane            16-bit words of the lane
u16 ...                 the words, lane by lane (``mixing``)
i64 per document        its id
u8 per document         1: the id is null, 2: it began in an earlier block, 4: it goes on
u32 per document        its ids in this block
u32                     CRC-32 of the block's ids as unsigned 32-bit numbers
u32                     CRC-32 of all bytes of the block before it
======================  =====================================================================

Blocks have at most ``BLOCK_IDS`` ids and are coded each by itself, so that a long document spans
several and a damaged block is told by its checksums. Spark deals the documents out in ranges of
their ids, writes one file per range and commits them; a lost task is done again.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrel.llm import mixing
from calibrel.llm.batches import bounded_batches, slices, written
from calibrel.session import scratch_path

MAGIC = b"CMX1"
HEAD = struct.Struct("<4s7I")
BLOCK_IDS = 1 << 16
#: Blocks that are coded side by side, and so held at once.
SIDE_BY_SIDE = 64
#: Bytes of text that become one file.
PART_BYTES = 32 << 20
MOST_TOKENIZER_BYTES = 64 << 20
WORDS_KEPT = 400_000
CODED_ROWS = 1024
_NULL, _LATER, _OPEN = 1, 2, 4

_TWO_SPACES = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) ")


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library; strings of special tokens are text.

    A byte-level tokenizer that splits before every blank never joins bytes over a blank that
    follows something else, so pieces between such blanks are encoded once and remembered.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        described = json.loads(content)
        splits = described.get("pre_tokenizer") or {}
        self.by_pieces = (
            splits.get("type") == "ByteLevel"
            and splits.get("use_regex", True)
            and not splits.get("add_prefix_space", True)
            and described.get("normalizer") is None
            and described["model"].get("dropout") is None
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ids = max(vocabulary.values(), default=0) + 1
        self.widths = np.zeros(self.ids, np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token)  # one character per byte
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> None:
        """Pieces to be encoded after a blank, the plain ones in one text."""
        odd = [p for p in pieces if not p or p[0].isspace() or p[-1].isspace()]
        plain = sorted(pieces.difference(odd))
        self.known.update(zip(odd, self.whole([" " + p for p in odd])))
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            raw = self.whole([" " + " ".join(some)])[0]
            ends = np.cumsum(self.widths[np.frombuffer(raw, "<u4")])
            lasts = np.cumsum([len(p.encode()) + 1 for p in some])
            cuts = np.searchsorted(ends, lasts)
            if (ends[cuts] != lasts).any():
                raise ValueError("the tokenizer joins bytes over blanks")
            places = [0, *((cuts + 1) * 4).tolist()]
            self.known.update(zip(some, (raw[a:b] for a, b in zip(places, places[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers."""
        if not self.by_pieces:
            return self.whole(texts)
        cut = [_CUT.split(t) if _TWO_SPACES.search(t) else t.split(" ") for t in texts]
        firsts = self.whole([pieces[0] for pieces in cut])
        later = set().union(*(pieces[1:] for pieces in cut))
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        self._learn(later.difference(self.known))
        known = self.known.__getitem__
        return [first + b"".join(map(known, pieces[1:])) for first, pieces in zip(firsts, cut)]


def _block(part: int, number: int, ids: np.ndarray, vocabulary: int, lanes: list[np.ndarray], docs: list) -> bytes:
    keys, flags, counts = zip(*docs)
    words = np.concatenate(lanes)
    body = b"".join(
        (
            HEAD.pack(MAGIC, part, number, len(ids), vocabulary, len(docs), len(lanes), len(words)),
            np.array([len(w) for w in lanes], "<u4").tobytes(),
            words.astype("<u2").tobytes(),
            np.array(keys, "<i8").tobytes(),
            np.array(flags, np.uint8).tobytes(),
            np.array(counts, "<u4").tobytes(),
            struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes())),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Writer:
    """Blocks of one file out of the documents of a range."""

    def __init__(self, part: int, vocabulary: int):
        self.part, self.vocabulary, self.number = part, vocabulary, 0
        self.full: list[tuple[np.ndarray, list]] = []
        self.held: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n = 0

    def add(self, key: int | None, ids: np.ndarray) -> Iterator[bytes]:
        at, null = 0, _NULL if key is None else 0
        while at < len(ids):
            some = ids[at : at + BLOCK_IDS - self.n]
            flags = null | (_LATER if at else 0) | (_OPEN if at + len(some) < len(ids) else 0)
            self.docs.append((key or 0, flags, len(some)))
            self.held.append(some)
            self.n += len(some)
            at += len(some)
            if self.n == BLOCK_IDS:
                self._close()
                if len(self.full) == SIDE_BY_SIDE:
                    yield from self.flush()

    def _close(self) -> None:
        self.full.append((np.concatenate(self.held), self.docs))
        self.held, self.docs, self.n = [], [], 0

    def flush(self) -> Iterator[bytes]:
        if self.full:
            coded = mixing.compress(np.stack([ids for ids, _ in self.full]), self.vocabulary)
            for (ids, docs), lanes in zip(self.full, coded):
                yield _block(self.part, self.number, ids, self.vocabulary, lanes, docs)
                self.number += 1
        self.full = []

    def finish(self) -> Iterator[bytes]:
        yield from self.flush()
        if self.n:
            self._close()
            yield from self.flush()


def read_blocks(content: bytes) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int, int]]]]:
    """Part, number, ids and documents of every block, checked; blocks of one shape are read together."""
    at, waiting, shape = 0, [], None
    while at < len(content):
        if len(content) - at < HEAD.size or content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        _, part, number, n, vocabulary, n_docs, lanes, n_words = HEAD.unpack_from(content, at)
        size = HEAD.size + 4 * lanes + 2 * n_words + 13 * n_docs + 8
        body = content[at : at + size]
        if len(body) < size or zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {number} of part {part} is damaged")
        if waiting and (shape != (n, vocabulary, lanes) or len(waiting) == SIDE_BY_SIDE):
            yield from _expanded(waiting, *shape[:2])
            waiting = []
        shape = n, vocabulary, lanes
        waiting.append((part, number, body, n_docs, lanes, n_words))
        at += size + 1
    if waiting:
        yield from _expanded(waiting, *shape[:2])


def _expanded(blocks: list, n: int, vocabulary: int) -> Iterator[tuple[int, int, np.ndarray, list]]:
    lengths, words = [], []
    for _, _, body, _, lanes, n_words in blocks:
        lengths.append(np.frombuffer(body, "<u4", lanes, HEAD.size))
        words.append(np.frombuffer(body, "<u2", n_words, HEAD.size + 4 * lanes))
    rows = mixing.expand(np.concatenate(words), np.concatenate(lengths).astype(np.int64), n, vocabulary)
    for ids, (part, number, body, n_docs, lanes, n_words) in zip(rows, blocks):
        if zlib.crc32(ids.astype("<u4").tobytes()) != struct.unpack("<I", body[-8:-4])[0]:
            raise ValueError(f"block {number} of part {part} has other ids than were written")
        docs = HEAD.size + 4 * lanes + 2 * n_words
        keys = np.frombuffer(body, "<i8", n_docs, docs).tolist()
        flags = np.frombuffer(body, np.uint8, n_docs, docs + 8 * n_docs).tolist()
        counts = np.frombuffer(body, "<u4", n_docs, docs + 9 * n_docs).tolist()
        yield part, number, ids, list(zip(keys, flags, counts))


def read_tokenizer(path: str) -> str:
    with open(path, "rb") as file:
        content = file.read(MOST_TOKENIZER_BYTES + 1)
    if len(content) > MOST_TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {MOST_TOKENIZER_BYTES} bytes")
    return content.decode()


def write_ids(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_bytes: int = PART_BYTES,
) -> None:
    """Write the ids of every text, ``end_id`` behind each, to a new folder ``path``.

    Documents stand in ascending order of their ids, null ids first, rows of one id by a hash of
    their text; null texts are empty and have the end id alone. Rows that repeat are all written.
    About ``part_bytes`` of text, and no less than one document, go to a file; however many rows
    have one id, they are dealt out to several. An empty table gives a folder without blocks.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    content = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    docs = df.select(
        df[id_column].cast("long").alias("doc_id"), F.coalesce(df[text_column], F.lit("")).alias("text")
    )
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    ordered = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = Encoder(content.value), None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for some in slices([batch], CODED_ROWS):
                if writer is None:
                    writer = Writer(some["part"][0].as_py(), max(encoder.ids, end_id + 1))
                coded = encoder.encode(some["text"].to_pylist())
                for key, raw in zip(some["doc_id"].to_pylist(), coded):
                    for block in writer.add(key, np.concatenate((np.frombuffer(raw, "<u4"), end))):
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])
        if writer is not None:
            for block in writer.finish():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    # Spark's text writer puts down the bytes it is given, and what it commits is whole.
    blocks = ordered.mapInArrow(run, "block binary")
    blocks.select(F.col("block").cast("string")).write.option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents in the files of ``path``: ``part, place, doc_id, n_tokens, ids_crc32`` and ``ids``.

    ``place`` is how many ids stand before the document in its file. Damaged blocks end the job.
    A document's ids are gathered in the task that reads its file; without ``with_ids`` they are not.
    """
    bounded_batches(spark)
    schema = "part long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                yield from _documents(content.as_py(), with_ids)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.where(F.length("content") > 0).mapInArrow(run, schema)


def _documents(content: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    place, expected, opened = 0, 0, None
    for part, number, ids, docs in read_blocks(content):
        if number != expected:
            raise ValueError(f"block {expected} of part {part} is missing")
        expected, at, rows = number + 1, 0, []
        raw = ids.astype("<u4")
        for key, flags, count in docs:
            some, at = raw[at : at + count], at + count
            if not flags & _LATER:
                opened = [None if flags & _NULL else key, 0, 0, []]
            opened[1] += count
            opened[2] = zlib.crc32(some.tobytes(), opened[2])
            if with_ids:
                opened[3].append(some.astype(np.int32))
            if not flags & _OPEN:
                rows.append((part, place, *opened))
                place += opened[1]
        if rows:
            *columns, found = zip(*rows)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                arrays.append(pa.array([np.concatenate(f) for f in found], pa.list_(pa.int32())))
            names = ["part", "place", "doc_id", "n_tokens", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])


def with_starts(documents: DataFrame) -> DataFrame:
    """``start``: how many ids stand before the document in all files, in their order."""
    docs = written(documents, "read-ids")
    # One row per file.
    sizes = docs.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "part").withColumn("start", F.col("base") + F.col("place")).drop("base")


def stored_ids(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Write the ids to ``path``, by default a new folder in the shared one, and read them back.

    Gives ``doc_id, start, n_tokens, ids_crc32`` of every document as the files have it.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "id-files")
    write_ids(df, path, tokenizer, end_id, **options)
    return with_starts(read_ids(spark, path, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")
