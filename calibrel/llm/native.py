"""Column expressions shared by the scans that stay inside Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


#: A scan covers arrays of up to ``2 ** SCAN_STEPS`` entries, more than an array can have.
SCAN_STEPS = 31


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Every entry combined with all before it, by doubling: n log n steps in all.

    ``combine`` must be associative. An ``aggregate`` that appends would copy the array per entry.
    """

    def wider(done: Column, reach: Column) -> Column:
        return F.transform(
            done, lambda v, i: F.when(i >= reach, combine(F.get(done, (i - reach).cast("int")), v)).otherwise(v)
        )

    reaches = F.array(*(F.lit(1 << k).cast("bigint") for k in range(SCAN_STEPS)))
    return let(
        values, lambda all_of: F.aggregate(F.filter(reaches, lambda r: r < F.size(all_of)), all_of, wider)
    )


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found) in code points.

    ``found`` is the given group. Spark's functions give matches without their places; the pieces
    between them have the lengths that are missing.
    """
    kind = "array<struct<start:bigint,end:bigint,found:string>>"

    def placed(all_of: Column) -> Column:
        groups = all_of if group == 0 else F.regexp_extract_all(text, F.lit(regex), group)

        def with_ends(ends: Column) -> Column:
            def item(m: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"))

            if group == 0:
                return F.transform(all_of, item)
            return let(
                groups,
                lambda g: F.transform(
                    all_of, lambda m, i: F.struct(item(m, i)["start"], item(m, i)["end"], F.get(g, i).alias("found"))
                ),
            )

        # The piece behind the last match is not of interest.
        lengths = let(
            F.split(text, regex, -1),
            lambda gaps: F.transform(
                all_of, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("bigint")
            ),
        )
        found = let(scan(lengths, lambda a, b: a + b), with_ends)
        return F.when(F.size(all_of) > 0, found.cast(kind)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(regex), 0), placed)


def apart_from(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``, both arrays of structs with ``start`` and ``end``."""

    def marked(all_of: Column) -> Column:
        last_end = scan(F.transform(all_of, lambda e: e["stop"]), F.greatest)
        backward = F.reverse(F.transform(all_of, lambda e: e["begin"]))
        next_start = F.reverse(scan(backward, F.least))

        def free(ends: Column) -> Column:
            return let(
                next_start,
                lambda starts: F.filter(
                    F.transform(
                        all_of,
                        lambda e, i: F.when(
                            e["own"].isNotNull()
                            & (F.get(ends, i) <= e["own"]["start"])
                            & (F.get(starts, i) >= e["own"]["end"]),
                            e["own"],
                        ),
                    ),
                    lambda s: s.isNotNull(),
                ),
            )

        return let(last_end, free)

    far = F.lit(1 << 62)
    given = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(-1).cast("long").alias("stop"), far.alias("begin"), s.alias("own")),
    )
    none = F.when(F.size(spans) < 0, F.get(spans, 0))
    between = F.transform(
        others,
        lambda o: F.struct(o["start"].alias("start"), o["end"].alias("stop"), o["start"].alias("begin"), none.alias("own")),
    )
    both = F.when((F.size(spans) > 0) & (F.size(others) > 0), let(F.array_sort(F.concat(given, between)), marked))
    return F.coalesce(both, spans)
