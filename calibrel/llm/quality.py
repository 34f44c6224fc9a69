"""Quality classifier by hierarchical empirical Bayes.

Shares of a text (capitals, symbols, repeated words and the like) fall into fixed bins. How often
each bin occurs among labelled good and bad texts gives its log likelihood ratio, and a logistic
regression weighs the features, which partly say the same. What is known of its place is a prior: the share of good documents in the whole table,
then of its host, then of its path there, each the mean over *all* documents of what the evidence
says, shrunk towards the level above. How strongly is itself estimated, from how much the groups
differ beyond chance, so a path with few documents says little and a host like all others nothing.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.llm.batches import bounded_batches, if_small, released, written

THRESHOLD = 0.5
SMOOTHING = 0.5
STRONGEST = 1e6
LEAST_WORDS = 16
PENALTY = 1e-3
UNKNOWN = -1
SHARES = np.array([1e-9, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6, 0.9])
FEATURES = ("words", "capitals", "symbols", "marks", "same_as_last", "commonest", "length", "ends")

_UPPER = string.ascii_uppercase.encode()
_LETTERS = string.ascii_letters.encode()
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"


def features(text: bytes) -> list[int]:
    """One bin per name in ``FEATURES``; ``UNKNOWN`` where a text has too few words to tell."""
    words = text.split()
    n, size = len(words), len(text)
    bins = [UNKNOWN] * len(FEATURES)
    bins[0] = n if n <= 8 else 6 + n.bit_length()
    if not words:
        return bins
    letters = size - len(text.translate(None, _LETTERS))
    shares = [
        (size - len(text.translate(None, _UPPER))) / max(1, letters),
        (size - len(text.translate(None, _SYMBOLS))) / size,
        text.count(b"!") / size,
    ]
    bins[1:4] = np.searchsorted(SHARES, shares, "right").tolist()
    if n >= LEAST_WORDS:
        shares = [
            sum(map(bytes.__eq__, words, words[1:])) / n,
            max(Counter(words).values()) / n,
            sum(w.endswith((b".", b"!", b"?")) for w in words) / n,
        ]
        bins[4], bins[5], bins[7] = np.searchsorted(SHARES, shares, "right").tolist()
        bins[6] = min(40, int(2 * sum(map(len, words)) / n))
    return bins


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features((t or "").encode()) for t in batch["text"].to_pylist()]
        columns = [batch[c] for c in ("doc_id", "text_key", "host", "path")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(found, pa.list_(pa.int32()))],
            names=["doc_id", "text_key", "host", "path", "bins"],
        )


def bin_ratios(labelled: DataFrame) -> tuple[float, dict[tuple[int, int], float]]:
    """Prior log odds and log likelihood ratios of ``bins`` by ``quality`` (1 good, 0 bad).

    Counted over all labelled rows; there are as many results as features have bins. Without rows
    of both classes nothing is evidence and the odds are even.
    """
    rows = (
        labelled.select("quality", F.posexplode("bins").alias("feature", "bin"))
        .groupBy("feature", "bin")
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
        .collect()
    )
    good, bad = (sum(r[c] for r in rows if r.feature == 0) for c in ("good", "bad"))
    if not good or not bad:
        return 0.0, {}
    ratios = {}
    for feature in range(len(FEATURES)):
        own = [r for r in rows if r.feature == feature and r.bin != UNKNOWN]
        room = SMOOTHING * len(own)
        seen_good, seen_bad = (sum(r[c] for r in own) for c in ("good", "bad"))
        for r in own:
            ratios[feature, r.bin] = math.log((r.good + SMOOTHING) / (seen_good + room)) - math.log(
                (r.bad + SMOOTHING) / (seen_bad + room)
            )
    return math.log(good / bad), ratios


def feature_ratios(bins: Column, ratios: dict[tuple[int, int], float]) -> list[Column]:
    """Per feature the ratio of its bin; 0 for unknown bins and those no labelled text has."""
    out = []
    for feature in range(len(FEATURES)):
        pairs = [F.lit(x) for (f, b), v in sorted(ratios.items()) if f == feature for x in (b, v)]
        found = F.try_element_at(F.create_map(*pairs), F.get(bins, feature)) if pairs else F.lit(None)
        out.append(F.coalesce(found.cast("double"), F.lit(0.0)))
    return out


def fit_weights(labelled: DataFrame, base: float, ratios: dict[tuple[int, int], float]) -> tuple[list[float], float]:
    """A weight per feature and what is added to their sum, by logistic regression on all labelled rows."""
    if not ratios:
        return [0.0] * len(FEATURES), 0.0
    rows = labelled.select(
        F.col("quality").cast("double").alias("label"),
        array_to_vector(F.array(*feature_ratios(F.col("bins"), ratios))).alias("features"),
    )
    model = LogisticRegression(maxIter=30, regParam=PENALTY, standardization=False).fit(rows)
    return list(model.coefficients.toArray()), float(model.intercept) - base


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _log_odds(chance: Column) -> Column:
    return F.log(chance / (1 - chance))


def shrinkage(groups: DataFrame, above: str) -> float:
    """How many documents the level above counts for: method of moments over ``n, good``.

    The spread of the groups' means beyond what draws from the level above give is their own.
    Groups that differ no more than that give the strongest shrinkage.
    """
    mean = F.col("good") / F.col("n")
    own = F.col(above) * (1 - F.col(above))
    row = groups.agg(
        F.sum(F.col("n") * (mean - F.col(above)) * (mean - F.col(above))).alias("seen"),
        F.sum(own).alias("chance"),
        F.sum(F.col("n") * own).alias("room"),
    ).first()
    if not row.room or row.seen <= row.chance:
        return STRONGEST
    share = (row.seen - row.chance) / row.room
    return min(STRONGEST, max(1.0, 1 / share - 1))


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    path_column: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: ``doc_id, text_key, evidence, prior, quality, kept``.

    ``labels`` has ``doc_id`` and ``quality``; other values than 0 and 1, nulls and repeated equal
    rows change nothing, and all labelled rows are counted. ``evidence`` and ``prior`` are in log
    odds, ``quality`` is the posterior and ``kept`` whether it reaches ``threshold``. Null and empty
    texts have their number of words for evidence and nothing else. A null host or path is a group
    like any other. Without labels of both classes every posterior is even and everything is kept.
    ``text_key`` tells rows with one id apart; other columns are left behind.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(
        df[id_column].cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(df[text_column], F.lit(""))).alias("text_key"),
        F.coalesce(df[host_column].cast("string"), F.lit("")).alias("host"),
        F.coalesce(df[path_column].cast("string"), F.lit("")).alias("path"),
        df[text_column].alias("text"),
    )
    marked = written(
        docs.mapInArrow(released(_features), "doc_id long, text_key long, host string, path string, bins array<int>"),
        "features",
    )
    known = labels.select(F.col("doc_id"), F.col("quality")).where("quality IN (0, 1)").distinct()
    labelled = written(marked.select("doc_id", "bins").join(known, "doc_id"), "labelled")
    base, ratios = bin_ratios(labelled)
    weights, added = fit_weights(labelled, base, ratios)
    evidence = F.lit(added)
    for weight, ratio in zip(weights, feature_ratios(F.col("bins"), ratios)):
        evidence = evidence + F.lit(float(weight)) * ratio
    scored = written(
        marked.select("doc_id", "text_key", "host", "path", evidence.alias("evidence")), "evidence"
    )
    good = F.sum(_chance(F.col("evidence") + base))
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), good.alias("good")), "sites")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("rows")).first()
    n, total = whole.n or 0, whole.good or 0.0
    overall = (total + SMOOTHING) / (n + 2 * SMOOTHING)
    hosts = (
        paths.groupBy("host")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        .withColumn("overall", F.lit(overall))
    )
    weight = shrinkage(hosts, "overall")
    hosts = hosts.select(
        "host", ((F.col("good") + weight * F.col("overall")) / (F.col("n") + weight)).alias("host_prior")
    )
    paths = written(paths.join(hosts, "host"), "site-priors")
    weight = shrinkage(paths, "host_prior")
    prior = _log_odds((F.col("good") + weight * F.col("host_prior")) / (F.col("n") + weight))
    priors = paths.select("host", "path", prior.alias("prior"))
    if not ratios:
        priors = priors.withColumn("prior", F.lit(0.0))
    return (
        scored.join(if_small(priors, whole.rows * 256), ["host", "path"])
        .withColumn("quality", _chance(F.col("evidence") + F.col("prior")))
        .select("doc_id", "text_key", "evidence", "prior", "quality", (F.col("quality") >= threshold).alias("kept"))
    )
