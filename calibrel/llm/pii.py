"""Personal data by bootstrapped contextual extraction.

Addresses and numbers that the base rules find are the seeds. The words around each seed are its
lexical patterns, and other words shaped like identifiers are candidates that stand in patterns of
their own. Patterns and instances form a graph that Spark scores in rounds: a pattern is as good
as the instances it surrounds, an instance as good as the patterns around it. Instances of high
confidence become seeds themselves, worth a little less with every round, until a round adds none.
What stands in patterns of high confidence is personal data of their kind, though no base rule knows
its form.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import text_key, texts, written

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 5
CONFIDENCE = 0.9
#: What a seed found in round r counts, to the power of r: bounds how far finds drift from the base rules.
DRIFT = 0.995

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with a domain, from as far left as the characters before it allow.

    The plain expression would try every start in a long run of letters; this looks back once.
    """
    done = 0
    for m in _DOMAIN.finditer(text):
        before = text[done : m.start()]
        start = done + len(before.rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def passes_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            yield m.span()


_BASE = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), ordered."""
    return sorted((s, k, e) for k, find in enumerate(_BASE) for s, e in find(text))


def shaped_like(word: str) -> list[int]:
    """The kinds that a candidate may be an unseen form of."""
    digits = sum(map(len, _DIGITS.findall(word)))
    kinds = [0] if "@" in word.strip("@") else []
    if digits >= 4 and word.count(".") + word.count(":") >= 3:
        kinds.append(1)
    if digits >= 12:
        kinds.append(2)
    if 7 <= digits <= 15:
        kinds.append(3)
    return kinds


class Words:
    """Where the words of a text stand, found once it is asked for a first context."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Up to two words before ``start`` and one behind ``end``, whole, digits read as 0."""
        if self.starts is None:
            found = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.ends = [s for s, _ in found], [e for _, e in found]
        first, last = bisect_left(self.starts, start), bisect_right(self.ends, end)
        left = [self.text[self.starts[k] : min(self.ends[k], start)] for k in range(max(0, first - 2), first)]
        right = [self.text[max(self.starts[k], end) : self.ends[k]] for k in range(last, min(last + 1, len(self.ends)))]
        return [_DIGITS.sub("0", w.lower()) for w in left], [_DIGITS.sub("0", w.lower()) for w in right]


def lexical_patterns(words: Words, start: int, end: int) -> list[int]:
    """Hashes of the two words before, and of the word on either side."""
    left, right = words.around(start, end)
    forms = []
    if len(left) == 2:
        forms.append("\x00".join(left))
    if left and right:
        forms.append(f"{left[-1]}\x00\x00{right[0]}")
    return [xxhash.xxh64_intdigest(f) - (1 << 63) for f in forms]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_MENTIONS = pa.list_(
    pa.struct(
        [
            ("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.list_(pa.int32())),
            ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64())),
        ]
    )
)
_FOUND = (
    "doc_id long, text_key long, spans array<struct<start:long,kind:int,end:long>>, "
    "mentions array<struct<start:long,end:long,kinds:array<int>,seed:boolean,instance:long,patterns:array<long>>>"
)


def _mention(words: Words, start: int, end: int, kinds: list[int], seed: bool) -> dict:
    word = words.text[start:end]
    return {
        "start": start, "end": end, "kinds": kinds, "seed": seed,
        "instance": xxhash.xxh64_intdigest(word) - (1 << 63),
        "patterns": lexical_patterns(words, start, end),
    }


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, spans, mentions = [], [], []
        for text in batch["text"].to_pylist():
            base, words = base_spans(text), Words(text)
            found = [_mention(words, s, e, [k], True) for s, k, e in base]
            nearest, taken = 0, sorted((s, e) for s, _, e in base)
            for m in _CANDIDATE.finditer(text):
                while nearest < len(taken) and taken[nearest][1] <= m.start():
                    nearest += 1
                if nearest < len(taken) and taken[nearest][0] < m.end():
                    continue
                word = m[0].rstrip(".,;:!?)\"'")
                if kinds := shaped_like(word):
                    found.append(_mention(words, m.start(), m.start() + len(word), kinds, False))
            keys.append(text_key(text))
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            mentions.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(keys, pa.int64()), pa.array(spans, _SPANS), pa.array(mentions, _MENTIONS)],
            names=["doc_id", "text_key", "spans", "mentions"],
        )


def score_patterns(
    edges: DataFrame, least_seeds: int = LEAST_SEEDS, confidence: float = CONFIDENCE
) -> DataFrame:
    """``pattern, kind, confidence`` of a graph ``pattern, kind, instance, seed``.

    Seeds count 1, other instances 0. A pattern's confidence is the mean of its distinct instances,
    one instance of doubt added; patterns with fewer distinct seeds than ``least_seeds`` have none.
    An instance is then as likely as one of its patterns being right. Those of at least ``confidence``
    are seeds of the next round, where they count ``DRIFT`` to the power of the round; seeds are only
    ever added, so the rounds end, and each is written before the next.
    """
    promoted = None
    for number in count(1):
        scored = edges.withColumn("score", F.col("seed").cast("double"))
        if promoted is not None:
            worth = F.pow(F.lit(DRIFT), F.col("since"))
            scored = edges.join(promoted, ["kind", "instance"], "left").withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(worth, F.lit(0.0)))
            )
        patterns = (
            scored.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("seeds"))
            .where(F.col("seeds") >= least_seeds)
            .select("pattern", "kind", (F.col("good") / (F.col("n") + 1)).alias("confidence"))
        )
        patterns = written(patterns, "patterns")
        likely = (
            edges.where(~F.col("seed"))
            .join(patterns, ["pattern", "kind"])
            .groupBy("kind", "instance")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("likely"))
            .where(F.col("likely") >= confidence)
        )
        new = likely.select("kind", "instance", F.lit(number).alias("since"))
        if promoted is not None:
            new = new.join(promoted, ["kind", "instance"], "left_anti")
        new = written(new, "promoted")
        if new.isEmpty():
            return patterns
        promoted = new if promoted is None else promoted.unionByName(new)


def find_personal_data(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_seeds: int = LEAST_SEEDS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """One row per input row: ``doc_id, spans, discovered``, arrays of (start, kind, end).

    ``spans`` has the base rules' finds and the discovered ones, ordered by start and kind, in code
    points with an exclusive end; ``discovered`` those of the patterns alone, which never overlap a
    base span. Null and empty texts have none. Repeated rows and null ids are kept and all get
    their spans. Other columns are left.
    """
    found = written(texts(df, id_column, text_column).mapInArrow(_find, _FOUND), "personal")
    mentions = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select(
        "doc_id", "text_key", "m.*"
    )
    pairs = mentions.select("instance", "seed", F.explode("kinds").alias("kind"), "patterns").select(
        "kind", "instance", "seed", F.explode("patterns").alias("pattern")
    )
    # Only patterns around a candidate can discover anything; the others need no score.
    open_patterns = pairs.where(~F.col("seed")).select("pattern", "kind").distinct()
    edges = written(
        pairs.groupBy("pattern", "kind", "instance")
        .agg(F.max("seed").alias("seed"))
        .join(open_patterns, ["pattern", "kind"], "left_semi"),
        "pattern-graph",
    )
    good = score_patterns(edges, least_seeds, confidence).where(F.col("confidence") >= confidence)
    best = (
        edges.where(~F.col("seed"))
        .join(good, ["pattern", "kind"])
        .groupBy("instance")
        .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("best"))
        .select("instance", (-F.col("best.order")).alias("kind"))
    )
    new = (
        mentions.where(~F.col("seed"))
        .join(best, "instance")
        .where(F.array_contains("kinds", F.col("kind")))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("discovered"))
        .select(F.col("doc_id").alias("new_id"), F.col("text_key").alias("new_key"), "discovered")
    )
    joined = found.select("doc_id", "text_key", "spans").join(
        new, F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_key") == F.col("new_key")), "left"
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    discovered = F.array_sort(F.coalesce("discovered", none))
    return joined.select(
        "doc_id",
        F.array_sort(F.concat("spans", discovered)).alias("spans"),
        discovered.alias("discovered"),
        F.col("spans").alias("base"),
    )
