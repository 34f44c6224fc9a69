"""Ranked lexical search of many items at once by shared subexpressions.

An item's score in a document is the sum of what its terms add, so terms that several items share
are a common subexpression. On the driver, sets of terms shared by items are mined from a block of
items of bounded size: pairs of terms or of sets found before that most items have become a set of
their own, again and again. That gives a graph of sums in which every set stands once and each item
is the sum of a few sets and terms.

Every task holds the partial accumulators of some documents as rows, one per term and set: terms are
filled in from the documents' postings, sets are added up level by level from the two they consist
of, each once for all items that share it, and items are added up last. Only each task's best
documents of an item leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrel.llm.batches import bounded_batches, slices, written

MOST = 50
#: Entries (item, term) of a block of items, whose terms and sums are broadcast.
BLOCK_ENTRIES = 400_000
#: Bytes of the accumulators of a task.
HELD_BYTES = 48 << 20
#: How far apart in an item two of its terms may stand, commonest first, to be mined as a pair.
NEARBY = 24
SALTS = 64
_TERM_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters; only A-Z are lower-cased."""
    return text.encode().translate(_TERM_BYTES).split()


@dataclass
class Sums:
    """Items as sums over a graph: nodes below ``len(terms)`` are terms, the others add two nodes."""

    terms: list[bytes]
    left: np.ndarray
    right: np.ndarray
    levels: list[np.ndarray]
    nodes: np.ndarray
    firsts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.terms) + len(self.left)


def share(items: list[list[bytes]]) -> Sums:
    """Mine the sets of terms that items share; every item has at least one term, each once.

    In each round the pairs of nodes that most items have become nodes, as long as two items still
    have both; pairs are counted among nodes that stand near each other in the order of how many
    items have them. Which pairs are found changes how much is shared, never a sum.
    """
    often = Counter(t for terms in items for t in terms)
    terms = sorted(often, key=lambda t: (-often[t], t))
    number = {t: k for k, t in enumerate(terms)}
    held = [sorted(number[t] for t in found) for found in items]
    having = {k: often[t] for k, t in enumerate(terms)}
    pairs: list[tuple[int, int]] = []
    depth = dict.fromkeys(range(len(terms)), 0)
    while True:
        counts: Counter = Counter()
        for nodes in held:
            common = [n for n in nodes if having[n] > 1]
            for k, a in enumerate(common):
                counts.update((a, b) for b in common[k + 1 : k + 1 + NEARBY])
        chosen = [p for p, n in counts.most_common() if n > 1]
        if not chosen:
            break
        where: dict[int, set[int]] = {}
        for k, nodes in enumerate(held):
            for n in nodes:
                if having[n] > 1:
                    where.setdefault(n, set()).add(k)
        now = [set(nodes) for nodes in held]
        made = 0
        for a, b in chosen:
            both = where[a] & where[b]
            if len(both) < 2:
                continue
            node = len(terms) + len(pairs)
            pairs.append((a, b))
            depth[node] = max(depth[a], depth[b]) + 1
            having[node] = len(both)
            for k in both:
                now[k] -= {a, b}
                now[k].add(node)
            # what is left of the two is paired in the next round at the earliest
            for n in (a, b):
                where[n] = where[n] - both
                having[n] -= len(both)
            made += 1
        if not made:
            break
        held = [sorted(nodes, key=lambda n: (-having[n], n)) for nodes in now]
    left = np.array([a for a, _ in pairs], np.int64)
    right = np.array([b for _, b in pairs], np.int64)
    of_level: dict[int, list[int]] = {}
    for k in range(len(pairs)):
        of_level.setdefault(depth[len(terms) + k], []).append(k)
    sizes = [len(nodes) for nodes in held]
    return Sums(
        terms,
        left,
        right,
        [np.array(of_level[d], np.int64) for d in sorted(of_level)],
        np.array([n for nodes in held for n in nodes], np.int64),
        np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64),
    )


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs``: how many terms a document has, and which of the given ones how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for batch in batches:
            lengths, found = [], []
            for text in batch["text"]:
                own = terms_of(text.as_py())
                lengths.append(len(own))
                ids = np.fromiter(map(number.get, own, repeat(-1)), np.int32, len(own))
                found.append(np.unique(ids[ids >= 0], return_counts=True))
            offsets = np.concatenate(([0], np.cumsum([len(ids) for ids, _ in found]))).astype(np.int32)
            ids, tfs = (np.concatenate([np.zeros(0, np.int32), *c]).astype(np.int32) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs)),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def frequencies(found: DataFrame, terms: int) -> dict[int, int]:
    """In how many documents each of the terms is; every task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            counts += np.bincount(batch["terms"].flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    of_tasks = found.select("terms").mapInArrow(run, "term long, df long")
    # As many rows as the block has terms.
    return {r.term: r.df for r in of_tasks.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def lengths_scaled(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + (50 n N) div L, in whole numbers of any size where 64 bits would not do."""
    most = int(n.max(initial=0)) * documents * 50
    if most < 1 << 62:
        return 50 + (50 * n * documents) // max(total, 1)
    return 50 + np.array([50 * k * documents // total for k in n.tolist()], np.int64)


class Best:
    """The best documents of every item so far, at most a few times ``most`` of them held."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.least = np.ones(items, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.bound = 0, items * most * 4 + 100_000

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores`` of items by documents; lower ones than the least that counts are left out."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.rows.append((item, scores[item, doc], ids[doc], nulls[doc]))
        self.held += len(item)
        if self.held > self.bound:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.rows)] if self.rows else [np.zeros(0, np.int64)] * 4
        item, score, doc, null = columns
        order = np.lexsort((doc, ~null.astype(bool), -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(item)])
        rank = np.arange(len(item)) - np.repeat(starts, sizes)
        kept = rank < self.most
        last = rank == self.most - 1
        self.least[item[last]] = score[last]
        self.rows = [(item[kept], score[kept], doc[kept], null[kept])]
        self.held = int(kept.sum())
        return self.rows[0]


def best_of_tasks(found: DataFrame, sums: Sums, weight: np.ndarray, documents: int, total: int, most: int) -> DataFrame:
    """``item, doc_id, score, salt``: the ``most`` best documents of each item in every task."""
    shared = found.sparkSession.sparkContext.broadcast((sums, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight = shared.value
        n_terms, n_items = len(sums.terms), len(sums.firsts)
        at_once = max(1, min(4096, HELD_BYTES // (8 * (sums.size + n_items + len(sums.nodes)))))
        best, salt = Best(n_items, most), None
        for batch in slices(batches, at_once):
            lists = batch["terms"]
            sizes = lists.value_lengths().to_numpy()
            term, tf = lists.flatten().to_numpy(), batch["tfs"].flatten().to_numpy().astype(np.int64)
            column = np.repeat(np.arange(len(sizes)), sizes)
            m = lengths_scaled(batch["n"].to_numpy(), documents, total)
            partial = np.zeros((sums.size, len(sizes)), np.int64)
            partial[term, column] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[column]))
            for level in sums.levels:
                partial[n_terms + level] = partial[sums.left[level]] + partial[sums.right[level]]
            scores = np.add.reduceat(partial[sums.nodes], sums.firsts, axis=0)
            nulls = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = batch["doc_id"].fill_null(0).to_numpy()
            if salt is None and len(ids):
                salt = int(ids[0]) % SALTS
            best.add(scores, ids, nulls)
        item, score, doc, null = best.prune()
        for k in range(0, len(item), 10_000):
            some = slice(k, k + 10_000)
            n = len(item[some])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item[some], pa.int64()),
                    pa.array(doc[some], pa.int64(), mask=null[some].astype(bool)),
                    pa.array(score[some], pa.int64()),
                    pa.array(np.full(n, salt or 0), pa.int64()),
                ],
                names=["item", "doc_id", "score", "salt"],
            )

    return found.mapInArrow(run, "item long, doc_id long, score long, salt long")


def _best(rows: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` best of each key; Spark drops the others before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``item_id, terms``: the different terms of all texts of an item; items without any are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t or ""))) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["item_id"], pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"]
            )

    rows = items.select(items[id_column].alias("item_id"), items[text_column].alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    each = rows.mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return (
        each.select("item_id", F.explode("terms").alias("term"))
        .groupBy("item_id")
        .agg(F.collect_set("term").alias("terms"))
    )


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    most: int = MOST,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of every item, best first.

    A term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and adds its weight times
    (1e9 tf) div (1000 tf + 20 m) to a document's score, with m = 50 + (50 n N) div L. Documents with
    equal scores stand in ascending order of their ids, null first; scores of 0 do not count. Null
    texts have no terms, repeated rows are ranked each, rows of one item are one item with the terms of
    all, and items without terms have no rows. Items are taken in blocks of about ``block_entries``
    terms, so what is broadcast does not grow with their number; the documents are read once per block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(
        docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text")
    )
    wanted = written(_item_terms(items, item_column, item_text_column), "item-terms")
    entries = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-2 * entries // block_entries)) if entries > block_entries else 1
    kind = wanted.schema["item_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        own = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        rows = sorted(wanted.where(own).collect(), key=lambda r: (r.item_id is not None, r.item_id))
        if not rows:
            continue
        sums = share([[bytes(t) for t in r.terms] for r in rows])
        found = written(postings(texts, sums.terms), "postings")
        # Documents with at least one term, and the terms of all.
        documents, total = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = frequencies(found, len(sums.terms))
        weight = weights(documents, np.array([counts.get(k, 0) for k in range(len(sums.terms))], np.int64))
        some = best_of_tasks(found.where(F.size("terms") > 0), sums, weight, documents, total, most)
        some = _best(_best(some, ("item", "salt"), most), ("item",), most)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], f"item long, item_id {kind}")
        some = some.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = some if out is None else out.unionByName(some)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
