"""Byte-level BPE encoding and decoding with recursive queries of an embedded DuckDB.

Each worker cuts its texts into words by the tokenizer's pattern. Words not met before become rows
of (word, tokens, ranks of their pairs), a token per byte; a recursive query contracts each word's pair
of least rank and joins the new token and its neighbours with the merge table until no pair merges.
Decoding joins ids with the vocabulary and aggregates their bytes in order. Spark partitions the
texts, and nothing is shuffled; the vocabulary is one bounded broadcast.

Short words contract their leftmost pair of least rank in each step. In words of more than ``SHORT``
bytes all other places of that pair that do not overlap are contracted in the same step, unless a
pair with the new token ranks lower still: only then could what follows at the left change what is
merged at the right.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.llm.batches import bounded_batches, released, slices

WORDS_KEPT = 150_000
ONCE_KEPT = 150_000
SHORT = 64
#: New words, and bytes of them, that one recursive query contracts; it holds all its steps.
CONTRACTED = 16_384
CONTRACTED_BYTES = 196_608
ENCODED_ROWS = 1024
DECODED_ROWS = 256
MOST_VOCABULARY_BYTES = 64 << 20

#: One contraction per word and step, for words of up to ``SHORT`` bytes: the merged token meets its two
#: neighbours in the merges, the ranks of all other pairs are kept.
ENCODE_SHORT = """
WITH RECURSIVE step AS (
  SELECT w, ids, ranks, list_min(ranks) AS least FROM start
  UNION ALL
  SELECT w, ids, ranks, list_min(ranks) FROM (
    SELECT w, ids[1:p - 1] || [least] || ids[p + 2:] AS ids,
           ranks[1:greatest(p - 2, 0)] || CASE WHEN p > 1 THEN [a.m] ELSE [] END || [b.m] || ranks[p + 2:] AS ranks
    FROM (SELECT w, ids, ranks, least, p, ids[p - 1] AS before, ids[p + 2] AS beyond
          FROM (SELECT *, list_position(ranks, least) AS p FROM step WHERE least IS NOT NULL))
    LEFT JOIN merges AS a ON a.l = before AND a.r = least
    LEFT JOIN merges AS b ON b.l = least AND b.r = beyond))
SELECT w, ids FROM step WHERE least IS NULL ORDER BY w"""

#: All places of the pair of least rank in one step, where none of the new pairs ranks lower.
ENCODE_LONG = """
WITH RECURSIVE step AS (
  SELECT w, p, t, FALSE AS done FROM start
  UNION ALL
  SELECT w, p, CASE WHEN take THEN least ELSE t END, least IS NULL
  FROM (
    SELECT w, p, t, least, take, lag(take, 1, FALSE) OVER word AS gone
    FROM (
      SELECT w, p, t, least, every AND (NOT lower_left OR leftmost) AS take
      FROM (
        SELECT w, p, t, least, coalesce(odd, FALSE) AS every,
               sum(CASE WHEN odd THEN 1 ELSE 0 END) OVER word = 1 AS leftmost,
               bool_or(coalesce(odd AND (a.l IS NOT NULL OR b.l IS NOT NULL OR c.l IS NOT NULL), FALSE))
                 OVER (PARTITION BY w) AS lower_left
        FROM (
          SELECT *, rank = least AND
                 (k - max(CASE WHEN rank = least THEN 0 ELSE k END) OVER word) % 2 = 1 AS odd
          FROM (
            SELECT w, p, t, k, before, beyond, m AS rank, min(m) OVER (PARTITION BY w) AS least
            FROM (SELECT w, p, t, lead(t) OVER word AS after, lead(t, 2) OVER word AS beyond,
                         lag(t) OVER word AS before, row_number() OVER word AS k
                  FROM step WHERE NOT done WINDOW word AS (PARTITION BY w ORDER BY p)) AS open
            LEFT JOIN merges ON l = t AND r = after) AS ranked
          WINDOW word AS (PARTITION BY w ORDER BY p)) AS chosen
        LEFT JOIN early AS a ON a.l = before AND a.r = least
        LEFT JOIN early AS b ON b.l = least AND b.r = beyond
        LEFT JOIN early AS c ON c.l = least AND c.r = least
        WINDOW word AS (PARTITION BY w ORDER BY p)) AS checked) AS taken
    WINDOW word AS (PARTITION BY w ORDER BY p)) AS contracted
  WHERE NOT gone)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE done GROUP BY w ORDER BY w"""

DECODE = """
SELECT row, list(bytes ORDER BY place) AS parts
FROM ids LEFT JOIN vocabulary USING (id) GROUP BY row ORDER BY row"""


def read_ranks(path: str) -> bytes:
    """The vocabulary file (a token in base64 and its rank on each line), its size checked."""
    with open(path, "rb") as file:
        content = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MOST_VOCABULARY_BYTES} bytes")
    return content


class Vocabulary:
    """Tokens by rank in an embedded database, which decodes with them."""

    def __init__(self, ranks: bytes):
        rows = [line.split() for line in ranks.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        if len(self.ranks) != len(set(self.ranks.values())):
            raise ValueError("two tokens have one rank")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self._load(
            "vocabulary",
            pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks, pa.binary())}),
        )

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each row; a null row stays null, an id without a token is an error."""
        rows = pa.array(np.arange(len(ids)))
        lengths = ids.value_lengths().fill_null(0).to_numpy()
        flat = ids.flatten()
        places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register(
            "ids",
            pa.table({"row": np.repeat(np.arange(len(ids)), lengths), "place": places.astype(np.int32), "id": flat}),
        )
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [None if null else b"" for null in ids.is_null().to_pylist()]
        parts = found["parts"].combine_chunks()
        tokens = parts.values
        if tokens.null_count:
            raise ValueError("an id has no token in this vocabulary")
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        data = tokens.buffers()[2]
        for row, first, end in zip(found["row"].to_pylist(), parts.offsets.to_pylist(), parts.offsets.to_pylist()[1:]):
            out[row] = data.slice(int(ends[first]), int(ends[end] - ends[first])).to_pybytes()
        del rows
        return pa.array(out, pa.binary())


class Numbers(dict):
    """Words numbered in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def portions(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words by length, so that those of one query take about as many steps; each portion bounded."""
    some, size = [], 0
    for word in sorted(words, key=len):
        if some and (len(some) == CONTRACTED or size + len(word) > CONTRACTED_BYTES):
            yield some
            some, size = [], 0
        some.append(word)
        size += len(word)
    if some:
        yield some


class Coder(Vocabulary):
    """The merges beside the vocabulary, and the words met so far."""

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__(ranks)
        # \\s is Unicode's White_Space here; Python's also takes the separators \x1c to \x1f.
        spaced = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaced.replace(r"\s", r"\p{White_Space}"))
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # Words met in several batches, and those met in one so far; a full table starts anew.
        self.words: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        rank_of = self.ranks.get
        merges = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (left := rank_of(token[:k])) is not None and (right := rank_of(token[k:])) is not None
        ]
        # the rank of what two bytes merge to, -1 where they do not
        self.of_pair = np.full((256, 256), -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.of_pair[token[0], token[1]] = rank
        left, right, merged = (pa.array(c, pa.int32()) for c in (list(zip(*merges)) or [(), (), ()]))
        self._load("merges", pa.table({"l": left, "r": right, "m": merged}))
        self.db.execute("CREATE TABLE early AS SELECT l, r FROM merges WHERE m < greatest(l, r)")

    def contract(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word, which must not be empty, with its ids as 32-bit numbers."""
        short, long = [], []
        for word in words:
            (short if len(word) <= SHORT else long).append(word)
        for query, words_of in ((ENCODE_SHORT, short), (ENCODE_LONG, long)):
            for chosen in portions(words_of):
                lengths = np.fromiter(map(len, chosen), np.int64, len(chosen))
                firsts = np.cumsum(lengths) - lengths
                raw = np.frombuffer(b"".join(chosen), np.uint8)
                tokens = self.of_byte[raw]
                if query is ENCODE_SHORT:
                    ranks = np.append(self.of_pair[raw[:-1], raw[1:]], np.int32(-1))
                    ranks[firsts + lengths - 1] = -1
                    offsets = np.append(firsts, len(raw)).astype(np.int32)
                    start = {
                        "w": pa.array(np.arange(len(chosen)), pa.int32()),
                        "ids": pa.ListArray.from_arrays(offsets, tokens),
                        "ranks": pa.ListArray.from_arrays(offsets, pa.array(ranks, mask=ranks < 0)),
                    }
                else:
                    start = {
                        "w": pa.array(np.repeat(np.arange(len(chosen)), lengths), pa.int32()),
                        "p": pa.array(np.arange(lengths.sum()) - np.repeat(firsts, lengths), pa.int32()),
                        "t": pa.array(tokens),
                    }
                self.db.register("start", pa.table(start))
                found = self.db.sql(query).to_arrow_table()["ids"].combine_chunks()
                self.db.unregister("start")
                ids = found.values.to_numpy().astype(np.int32).tobytes()
                ends = (found.offsets.to_numpy() * 4).tolist()
                yield from ((word, ids[a:b]) for word, a, b in zip(chosen, ends, ends[1:]))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words as 32-bit numbers."""
        coded = list(map(self.words.get, words))
        new = []
        for number in [n for n, ids in enumerate(coded) if ids is None]:
            word = words[number]
            if (ids := self.once.pop(word, None)) is None:
                new.append(number)
            else:
                coded[number] = self.words[word] = ids
        if len(self.words) > WORDS_KEPT:
            self.words = {}
        if new:
            if len(self.once) + len(new) > ONCE_KEPT:
                self.once = {}
            number_of = {words[number].encode(): number for number in new}
            for word, ids in self.contract(list(number_of)):
                number = number_of[word]
                coded[number] = ids
                if len(word) <= SHORT:
                    self.once[words[number]] = ids
        return coded

    def encode(self, content: list[str]) -> pa.Array:
        # a word of the batch is held once; texts are numbers of words
        numbers = Numbers()
        number, find = numbers.__getitem__, self.pattern.findall
        cut = [array("i", map(number, find(text))) for text in content]
        coded = self.ids_of(list(numbers))
        del numbers, number
        offsets = np.cumsum([0, *map(len, coded)]) // 4
        of_words = pa.ListArray.from_arrays(offsets.astype(np.int32), np.frombuffer(b"".join(coded), np.int32))
        del coded
        ends = np.cumsum([0, *map(len, cut)])
        joined = of_words.take(pa.array(np.frombuffer(b"".join(cut), np.int32)))
        pa.default_memory_pool().release_unused()
        return pa.ListArray.from_arrays(joined.offsets.take(pa.array(ends)), joined.values)


def _shared(spark: SparkSession, path: str) -> Broadcast:
    bounded_batches(spark)
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(
    df: DataFrame, path: str, pattern: str, text_column: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """The rows with ``ids_column``, an array<int>, as their last column in place of any of that name.

    Each match of ``pattern`` is encoded by itself with the ranks in the file ``path``; text between
    matches is left out, and there are no special tokens. Null and empty texts have no ids. All
    other columns and repeated rows stay as they are.
    """
    ranks = _shared(df.sparkSession, path)
    kept = df.drop(ids_column) if ids_column != text_column else df
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != ids_column)
    names = [n for n in kept.columns if n != ids_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # made anew by each task: an idle worker keeps no tables
        coder = Coder(ranks.value, pattern)
        with coder.db:
            for batch in slices(batches, ENCODED_ROWS):
                ids = coder.encode([t or "" for t in batch[text_column].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), ids], names=[*names, ids_column])

    return kept.mapInArrow(released(run), f"{fields}{', ' if fields else ''}`{ids_column}` array<int>")


def decode(df: DataFrame, path: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """The rows with ``bytes_column``, the bytes of the ids, as their last column.

    A null array gives null, an empty one no bytes, and an id that the vocabulary lacks ends the
    job. All other columns and repeated rows stay as they are.
    """
    ranks = _shared(df.sparkSession, path)
    kept = df.drop(bytes_column) if bytes_column != ids_column else df
    names = [n for n in kept.columns if n != bytes_column]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != bytes_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(ranks.value)
        with vocabulary.db:
            for batch in slices(batches, DECODED_ROWS):
                decoded = vocabulary.decode(batch[ids_column])
                columns = [*(batch[n] for n in names), decoded]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, bytes_column])

    return kept.mapInArrow(released(run), f"{fields}{', ' if fields else ''}`{bytes_column}` binary")
