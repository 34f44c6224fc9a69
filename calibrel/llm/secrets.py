"""Secret scans by a battery of randomness tests, in DataFrame functions throughout.

Base rules find assignments, access keys and long hexadecimal runs. Beside them every other token
of 20 or more characters with letters and digits is a candidate. Its encoding is the narrowest
alphabet that holds all its characters; in that alphabet random characters are evenly used
(chi-squared), lie above and below the middle in as many runs as a fair coin (runs test) and do not
depend on the one before (serial correlation). The three add up to one statistic, small for random
tokens.

What language does to the statistic is the null: a non-central chi-squared law of three degrees of
freedom, further from the centre the longer the token. Long words of letters alone, wherever the
table has them, calibrate it: they are counted together with the law, which weighs as much as
``LAW_WORDS`` words, in each length class. That gives a candidate's p-value, the same way for every
table, and a step-up rule in each class holds the share of false discoveries. Short tokens, for which
language passes for random more often, so need smaller values.
Statistics are counted over the whole table into bins, whose number does not grow with it.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrel.llm.batches import texts, written
from calibrel.llm.native import apart_from, let, matches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_VALUE = 6

ALPHABETS = {
    "hex": string.digits + "abcdef",
    "upper hex": string.digits + "ABCDEF",
    "lower": string.ascii_lowercase,
    "base32": string.ascii_uppercase + "234567=",
    "base36": string.digits + string.ascii_lowercase,
    "letters": string.ascii_letters,
    "base62": string.digits + string.ascii_letters,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/=",
    "any": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/=_-",
}
LENGTH_CLASSES = (20, 24, 32, 48, 80)
BIN = 0.25
BINS = 400
FALSE_DISCOVERIES = 0.1
#: What language adds to the root of the statistic per character, and how many words the law weighs.
LANGUAGE = 0.167
LAW_WORDS = 400


def base_spans(text: Column) -> Column:
    """(start, kind, end, found) of the base rules, ordered by start and kind."""

    def of(kind: int, found: Column) -> Column:
        return F.transform(
            found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
        )

    valued = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["found"]) >= LEAST_VALUE)
    return F.array_sort(
        F.concat(of(0, valued), of(1, matches(text, ACCESS)), of(2, matches(text, HEX)))
    )


def alphabet_of(token: Column) -> Column:
    """The narrowest alphabet that holds every character of the token."""
    found = F.lit(ALPHABETS["any"])
    for name in reversed(list(ALPHABETS)[:-1]):
        letters = ALPHABETS[name]
        rest = F.translate(token, letters, "")
        found = F.when(F.length(rest) == 0, F.lit(letters)).otherwise(found)
    return found


def _squares(values: Column) -> Column:
    """Sum of the squared counts of the distinct values."""
    return F.aggregate(
        F.array_distinct(values),
        F.lit(0.0),
        lambda acc, d: acc + F.pow(F.size(F.filter(values, lambda v: v == d)).cast("double"), F.lit(2.0)),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def chi_squared(values: Column, size: Column) -> Column:
    """Standardised statistic of even use of ``size`` characters."""
    n = F.size(values).cast("double")
    free = size - 1
    return (size / n * _squares(values) - n - free) / F.sqrt(2.0 * free * (n - 1) / n)


def runs(values: Column, size: Column) -> Column:
    """Wald and Wolfowitz on characters of the upper and lower half of the alphabet."""

    def test(high: Column) -> Column:
        n, upper = F.size(high).cast("double"), _sum(high)
        turns = F.size(
            F.filter(F.sequence(F.lit(1), F.size(high) - 1), lambda i: F.get(high, i) != F.get(high, i - 1))
        )
        pairs = 2.0 * upper * (n - upper)
        spread = pairs * (pairs - n) / (n * n * (n - 1))
        # All on one side: as far from random as a sequence of this length can be.
        return F.when(spread > 0, (turns - pairs / n) / F.sqrt(spread)).otherwise(F.sqrt(n))

    return let(F.transform(values, lambda v: F.when(v * 2 >= size, 1.0).otherwise(0.0)), test)


def serial_correlation(values: Column) -> Column:
    """Standardised correlation of each character with the next."""

    def test(x: Column) -> Column:
        n = F.size(x).cast("double")
        mean = _sum(x) / n
        spread = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        both = F.aggregate(
            F.sequence(F.lit(1), F.size(x) - 1),
            F.lit(0.0),
            lambda acc, i: acc + (F.get(x, i) - mean) * (F.get(x, i - 1) - mean),
        )
        return F.when(spread > 0, (both / spread + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.sqrt(n))

    return let(values, test)


def battery(token: Column) -> Column:
    """Sum of the squares of the three statistics."""

    def of(letters: Column) -> Column:
        size = F.length(letters).cast("double")
        places = F.transform(F.split(token, ""), lambda c: (F.position(c, letters) - 1).cast("double"))
        return let(
            places,
            lambda v: F.pow(chi_squared(v, size), F.lit(2.0))
            + F.pow(runs(v, size), F.lit(2.0))
            + F.pow(serial_correlation(v), F.lit(2.0)),
        )

    return let(alphabet_of(token), of)


def length_class(length: Column) -> Column:
    found = F.lit(LENGTH_CLASSES[0])
    for least in LENGTH_CLASSES[1:]:
        found = F.when(length >= least, least).otherwise(found)
    return found


def language_law(length: int, statistic: float) -> float:
    """How often language of ``length`` characters has at most this statistic."""
    away, root = LANGUAGE * (length - 1), math.sqrt(statistic)
    normal = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    density = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    tails = (density(root - away) - density(root + away)) / away
    return max(0.0, normal(root - away) + normal(root + away) - 1 - tails)


def law_of(length: Column, bin_: Column) -> Column:
    """``language_law`` of a length class up to the end of a bin."""
    found = F.lit(None).cast("double")
    for least in LENGTH_CLASSES:
        values = F.array(*(F.lit(language_law(least, (k + 1) * BIN)) for k in range(BINS + 1)))
        found = F.when(length == least, F.get(values, bin_.cast("int"))).otherwise(found)
    return found


def discovery_limits(tested: DataFrame, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """``class, limit``: candidates of the class up to this bin are discoveries.

    ``tested`` has ``class``, ``bin`` and ``natural``, true for words of letters alone. The step-up
    rule takes the largest bin whose p-value times the number of candidates is at most ``share`` of
    the candidates up to it. There is one row per class and bin, whatever the size of the table.
    """
    counts = tested.groupBy("class", "bin").agg(
        F.count_if("natural").alias("words"), F.count_if(~F.col("natural")).alias("tokens")
    )
    up_to = Window.partitionBy("class").orderBy("bin")
    whole = Window.partitionBy("class")
    law = LAW_WORDS * law_of(F.col("class"), F.col("bin"))
    p = (law + F.sum("words").over(up_to)) / (LAW_WORDS + F.sum("words").over(whole))
    held = p * F.sum("tokens").over(whole) <= share * F.sum("tokens").over(up_to)
    return (
        counts.withColumn("passed", held).where("passed").groupBy("class").agg(F.max("bin").alias("limit"))
    )


def find_secrets(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float = FALSE_DISCOVERIES
) -> DataFrame:
    """One row per input row: ``doc_id, base, discovered, spans``, arrays of (start, kind, end).

    ``base`` holds the finds of the base rules, ``discovered`` the tokens that pass for random and
    overlap none of them, ``spans`` both, ordered by start and kind; code points, exclusive end.
    Null and empty texts have none. Repeated rows and null ids are kept, each with its spans. A
    table without long tokens has no discoveries. Other columns are left behind.
    """
    docs = texts(df, id_column, text_column)
    text = F.col("text")
    tokens = F.filter(
        matches(text, TOKEN),
        lambda m: m["found"].rlike("[0-9]") & m["found"].rlike("[A-Za-z]") | m["found"].rlike("^[A-Za-z]+$"),
    )
    found = written(
        docs.select(
            "doc_id", F.xxhash64("text").alias("text_key"), base_spans(text).alias("base"), tokens.alias("tokens")
        ),
        "secrets",
    )
    free = found.select(
        "doc_id",
        "text_key",
        F.explode(apart_from(F.col("tokens"), F.col("base"))).alias("t"),
    ).select("doc_id", "text_key", "t.*")
    natural = F.col("found").rlike("^[A-Za-z]+$")
    # every candidate has a digit, so a word gets one as well
    value = F.when(natural, F.concat(F.expr("left(found, length(found) - 1)"), F.lit("1"))).otherwise(F.col("found"))
    tested = written(
        free.select(
            "doc_id", "text_key", "start", "end",
            natural.alias("natural"),
            length_class(F.length("found")).alias("class"),
            F.least(F.floor(battery(value) / BIN), F.lit(BINS)).alias("bin"),
        ),
        "randomness",
    )
    null = tested.select("class", "bin", "natural")
    span = F.struct("start", F.lit(3).alias("kind"), "end")
    new = (
        tested.where(~F.col("natural"))
        .join(F.broadcast(discovery_limits(null, share)), "class")
        .where(F.col("bin") <= F.col("limit"))
        .groupBy(F.col("doc_id").alias("new_id"), F.col("text_key").alias("new_key"))
        .agg(F.collect_set(span).alias("discovered"))
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    discovered = F.array_sort(F.coalesce("discovered", none))
    same = F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_key") == F.col("new_key"))
    return (
        found.select("doc_id", "text_key", "base")
        .join(new, same, "left")
        .select(
            "doc_id",
            "base",
            discovered.alias("discovered"),
            F.array_sort(F.concat("base", discovered)).alias("spans"),
        )
    )
