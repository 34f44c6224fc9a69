"""Tokens of texts that are held in pieces, as one call on the whole text gives them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.session import checkpointed

#: Characters that a piece is read beyond each of its borders.
OVERLAP = 256

Tokenizer = Callable[[Column], Column]


def _with_neighbours(parts: DataFrame, key: str, to_next: Column, to_last: Column, own: list[str]) -> DataFrame:
    """``own`` with ``before`` and ``behind``: what the parts around each one send it, null where there is none.

    Three rows meet per part, however many parts a key has.
    """
    nothing = F.lit(None)
    columns = [F.col(c).alias(c) for c in own]
    none = [nothing.cast(parts.schema[c].dataType).alias(c) for c in own]
    kind = parts.select(to_next.alias("sent")).schema["sent"].dataType
    empty = nothing.cast(kind)
    rows = (
        parts.select(key, "part", F.lit(True).alias("_own"), *columns, empty.alias("before"), empty.alias("behind"))
        .union(parts.select(key, F.col("part") + 1, F.lit(False), *none, to_next, empty))
        .union(parts.select(key, F.col("part") - 1, F.lit(False), *none, empty, to_last))
    )
    first = [F.first(c, ignorenulls=True).alias(c) for c in (*own, "before", "behind")]
    return rows.groupBy(key, "part").agg(F.bool_or("_own").alias("_own"), *first).filter("_own").drop("_own")


def _whole(parts: DataFrame, key: str, ids_of: Tokenizer) -> DataFrame:
    """One call per text; its tokens stand in the first part, the others have none."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "text")))
    texts = parts.groupBy(key).agg(
        pieces.alias("_pieces"), (F.count("text") == F.count(F.lit(1))).alias("_complete")
    )
    joined = F.when(F.col("_complete"), F.array_join(F.col("_pieces")["text"], ""))
    tokens = texts.select(key, F.col("_pieces")["part"].alias("_parts"), ids_of(joined).alias("_tokens"))
    none = F.when(F.col("_tokens").isNotNull(), F.slice("_tokens", 1, 0))
    return tokens.select(key, F.posexplode("_parts").alias("_place", "part"), "_tokens").select(
        key, "part", F.when(F.col("_place") == 0, F.col("_tokens")).otherwise(none).alias("tokens")
    )


def _settled_or_whole(parts: DataFrame, found: DataFrame, key: str, ids_of: Tokenizer) -> DataFrame:
    """``found`` has ``tokens`` and ``settled``; texts with an unsettled border are tokenized as a whole."""
    open_keys = found.filter(~F.col("settled")).select(key).distinct()
    if open_keys.isEmpty():
        return found.select(key, "part", "tokens")
    kept = found.join(open_keys, key, "left_anti").select(key, "part", "tokens")
    return kept.unionByName(_whole(parts.join(open_keys, key, "left_semi"), key, ids_of))


def tokens_between_blanks(parts: DataFrame, key: str, ids_of: Tokenizer) -> DataFrame:
    """``(key, part, tokens)`` for a tokenizer whose tokens hold no blank and never look over one.

    What stands behind the last blank of a part goes to the next one. A text with a part
    without a blank is tokenized as a whole.
    """
    body = F.regexp_extract("text", r"(?s)^.*\s", 0)
    cut = parts.withColumn("_body", body).withColumn("_rest", F.expr("substring(text, length(_body) + 1)"))
    around = _with_neighbours(cut, key, F.col("_rest"), F.lit(""), ["text", "_body"])
    more = F.col("behind").isNotNull()
    text = F.concat(F.coalesce("before", F.lit("")), F.when(more, F.col("_body")).otherwise(F.col("text")))
    found = checkpointed(
        around.select(key, "part", ids_of(text).alias("tokens"), (~more | (F.col("_body") != "")).alias("settled"))
    )
    return _settled_or_whole(parts, found.withColumn("settled", F.coalesce("settled", F.lit(False))), key, ids_of)


def tokens_by_windows(
    parts: DataFrame, key: str, ids_of: Tokenizer, ends_of: Tokenizer, overlap: int = OVERLAP
) -> DataFrame:
    """``(key, part, tokens)`` for a tokenizer that also tells where its tokens end.

    ``ends_of`` gives an array of (id, end) with the ids of ``ids_of``. Each part is read together
    with ``overlap`` characters on either side, so both parts at a border see the text around it. The
    border is moved to the nearest place where a token ends, if both see the same tokens end at all
    places within half the overlap. Where they do not, where no token ends there, or where an inner part is shorter
    than the overlap, the whole text is tokenized in one call.
    """
    half, none = overlap // 2, F.array().cast("array<int>")
    given = parts.select(key, "part", F.coalesce("text", F.lit("")).alias("text"))
    around = _with_neighbours(given, key, F.right("text", F.lit(overlap)), F.left("text", F.lit(overlap)), ["text"])
    before, behind = F.coalesce("before", F.lit("")), F.coalesce("behind", F.lit(""))
    read = checkpointed(
        around.select(
            key,
            "part",
            F.length(before).alias("_start"),
            (F.length(before) + F.length("text")).alias("_end"),
            F.col("before").isNull().alias("_first"),
            F.col("behind").isNull().alias("_last"),
            (F.length("text") >= overlap).alias("_long"),
            ends_of(F.concat(before, F.col("text"), behind)).alias("_spans"),
        )
    )

    def ends_near(place: str) -> Column:
        near = F.filter(F.col("_spans"), lambda s: F.abs(s["end"] - F.col(place)) <= half)
        return F.coalesce(F.transform(near, lambda s: (s["end"] - F.col(place)).cast("int")), none)

    seen = F.struct
    marked = read.withColumns({"_at_start": ends_near("_start"), "_at_end": ends_near("_end")})
    near = _with_neighbours(
        marked,
        key,
        seen(F.col("_at_end").alias("ends"), (F.col("_long") | F.col("_first")).alias("long")),
        seen(F.col("_at_start").alias("ends"), (F.col("_long") | F.col("_last")).alias("long")),
        ["_start", "_end", "_first", "_last", "_long", "_spans", "_at_start", "_at_end"],
    )

    def agreed(own: str, other: str, own_long: Column) -> Column:
        same = (F.col(own) == F.col(other)["ends"]) & (F.size(own) > 0)
        return F.coalesce(same & own_long & F.col(other)["long"], F.lit(False))

    def nearest(own: str) -> Column:
        return F.array_min(F.transform(own, lambda e: F.struct(F.abs(e).alias("away"), e.alias("end"))))["end"]

    starts = F.col("_first") | agreed("_at_start", "before", F.col("_long") | F.col("_last"))
    ends = F.col("_last") | agreed("_at_end", "behind", F.col("_long") | F.col("_first"))
    low = F.when(F.col("_first"), F.lit(-1)).otherwise(F.col("_start") + nearest("_at_start"))
    high = F.when(F.col("_last"), F.col("_end")).otherwise(F.col("_end") + nearest("_at_end"))
    placed = near.select(key, "part", "_spans", low.alias("_low"), high.alias("_high"), (starts & ends).alias("settled"))
    inside = F.filter("_spans", lambda s: (s["end"] > F.col("_low")) & (s["end"] <= F.col("_high")))
    found = placed.select(key, "part", F.transform(inside, lambda s: s["id"]).alias("tokens"), "settled")
    # without spans of a part its text, or the window, could not be tokenized
    found = found.withColumn("settled", F.col("settled") & F.col("tokens").isNotNull())
    return _settled_or_whole(parts, checkpointed(found), key, ids_of)


def tokens_of_parts(
    parts: DataFrame,
    key: str,
    ids_of: Tokenizer,
    ends_of: Tokenizer | None = None,
    blanks: bool = False,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(key, part, tokens)`` of ``(key, part, text)``, parts of a text counted from 0 without gaps.

    In the order of the parts the tokens are those of one call of ``ids_of`` on the whole text. With
    ``blanks`` or ``ends_of`` no task holds more than a part and what is around it; with ``ids_of``
    alone a text is one row. A text with a null part has null tokens in one of its parts at least.
    """
    if blanks:
        return tokens_between_blanks(parts, key, ids_of)
    if ends_of is not None:
        return tokens_by_windows(parts, key, ids_of, ends_of, overlap)
    return _whole(parts, key, ids_of)


def join_tokens(parts: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, column)``: one row per key with the arrays of all its parts in order."""
    pieces = F.array_sort(F.collect_list(F.struct("part", column)))
    return parts.groupBy(key).agg(F.flatten(pieces[column]).alias(column))
