"""Repair of the turn structure of conversations by a dynamic program over runs.

A row is a symbol: what its role begins with, and its fault. Edits keep, re-role, delete or insert
rows so that the roles read ``(s?(ua)+)?``; the four states of that automaton and the cost of the
cheapest way between them make a 4 x 4 min-plus matrix of every symbol. Equal consecutive symbols are
one run, advanced by the binary powers of its matrix, which each worker keeps.

Rows are dealt out in ranges of (conversation, turn, ...), so a conversation of any length is cut into
pieces that tasks share. Min-plus products are associative: every piece becomes one matrix, a
backward scan over the matrices gives what follows each piece, the piece then unrolls its cheapest
edits for all four states that it may be entered in, and a forward scan picks the one that is. Only
matrices and states pass through the scans, never rows or texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from calibrel.llm.batches import bounded_batches, written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
ENDLESS = 1 << 60
#: Rows and characters of a piece, except that a longer text is a piece of its own.
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 20
#: Bytes of text that one task orders.
PART_BYTES = 32 << 20

# States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
#: The turn that may be inserted, and a row be re-roled to, in each state.
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Faults as letters of symbols; a symbol is a letter of s, u, a, x (other) and one of these.
FINE, CUT, GONE = "o", "t", "g"
_ACCEPTED = (START, ASSISTANT)

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
UNIT: Matrix = tuple(tuple(0 if i == j else ENDLESS for j in range(4)) for i in range(4))


@lru_cache(1 << 16)
def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(ENDLESS, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


@lru_cache(1 << 16)
def apply(a: Matrix, b: Vector) -> Vector:
    return tuple(min(ENDLESS, *(a[i][k] + b[k] for k in range(4))) for i in range(4))


def _inserts() -> Matrix:
    one = [list(row) for row in UNIT]
    for state, role in NEXT.items():
        one[state][STEPS[state, role]] = INSERT
    single = tuple(map(tuple, one))
    return times(times(single, single), times(single, single))


INSERTS = _inserts()
#: What it costs to end in each state: turns are inserted until the roles are complete.
ENDED: Vector = apply(INSERTS, tuple(0 if state in _ACCEPTED else ENDLESS for state in range(4)))


@lru_cache(None)
def edits(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, next state) of what may be done in a state with a row, in ASCII order."""
    role, fault = symbol
    found = [("D", DELETE, state)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        if (state, role) in STEPS:
            found.append(("K", KEEP + more, STEPS[state, role]))
        found.append(("R", REROLE + more, STEPS[state, NEXT[state]]))
    return tuple(found)


@lru_cache(None)
def matrix(symbol: str) -> Matrix:
    rows = [[ENDLESS] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in edits(symbol, state):
            rows[state][after] = min(rows[state][after], cost)
    return times(INSERTS, tuple(map(tuple, rows)))


@lru_cache(1 << 12)
def doubled(symbol: str, k: int) -> Matrix:
    """The matrix of ``2 ** k`` equal symbols."""
    return matrix(symbol) if k == 0 else times(doubled(symbol, k - 1), doubled(symbol, k - 1))


@lru_cache(1 << 14)
def power(symbol: str, n: int) -> Matrix:
    out, k = UNIT, 0
    while n >> k:
        if n >> k & 1:
            out = times(out, doubled(symbol, k))
        k += 1
    return out


def runs_of(symbols: str) -> list[tuple[str, int]]:
    """Equal consecutive symbols and how many there are; two letters are a symbol."""
    pairs = (symbols[k : k + 2] for k in range(0, len(symbols), 2))
    return [(symbol, len(list(same))) for symbol, same in groupby(pairs)]


def product(symbols: str) -> Matrix:
    out = UNIT
    for symbol, n in runs_of(symbols):
        out = times(out, power(symbol, n))
    return out


def unroll(symbols: str, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits from a state, given the costs from every state behind the piece."""
    runs = runs_of(symbols)
    behind = [after]
    for symbol, n in reversed(runs):
        behind.append(apply(power(symbol, n), behind[-1]))
    behind.reverse()
    out = []
    for (symbol, n), end in zip(runs, behind[1:]):
        # costs from each row of the run on: those behind it, then one more row at a time
        costs = [end]
        for _ in range(n):
            costs.append(apply(matrix(symbol), costs[-1]))
        for left in range(n, 0, -1):
            here, beyond = costs[left], costs[left - 1]
            while True:
                choices = edits(symbol, state)
                done = next((c for c in choices if c[0] < "I" and c[1] + beyond[c[2]] == here[state]), None)
                inserted = STEPS[state, NEXT[state]]
                if done is None and INSERT + here[inserted] == here[state]:
                    out.append("I")
                    state = inserted
                    continue
                edit, _, state = done or next(c for c in choices if c[1] + beyond[c[2]] == here[state])
                out.append(edit)
                break
    return "".join(out), state


def ending(state: int) -> str:
    """The roles' initials that are inserted behind the last row."""
    out = ""
    while state not in _ACCEPTED:
        out, state = out + NEXT[state], STEPS[state, NEXT[state]]
    return out


def repaired_rows(rows: list[dict], audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) after the edits of one piece that is entered in ``state``."""
    out, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        role = row["role"][:1] if edit == "K" else NEXT[state]
        out.append((row["role"] if edit == "K" else ROLES[role], "" if row is None else row["text"]))
        state = STEPS[state, role]
    return out


def _order() -> list[Column]:
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_hash"), F.col("row")]


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with ``symbol``; the first fault of a row counts, and of equal rows the first is none."""
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    told = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    keyed = keyed.withColumn("same", F.sha2(told, 256))
    keyed = written(keyed, "turns")
    place = F.struct(F.coalesce(F.col("turn"), F.lit(-(1 << 63))).alias("turn"), F.col("row"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), place.alias("at"))
    # One row per distinct text of a conversation; copies are added up before the shuffle.
    firsts = keyed.groupBy("conv", "same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select(F.col("conv").alias("of"), F.col("same").alias("equal"), "first")
    joined = keyed.join(firsts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("equal")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    repeated = F.col("first").isNotNull() & (place > F.col("first"))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, "b").when(repeated, "d").when(cut, "t").otherwise("o")
    return joined.select("conv", "turn", "role", "text", "row", "text_hash", fault.alias("fault"))


_PIECES = (
    "conv {kind}, part long, piece long, symbols string, roles string, first_turn long, last_turn long, "
    "turns long, blank long, duplicate long, truncated long, illegal long, matrix array<long>, "
    "rows array<struct<role:string,text:string>>"
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict]]]:
    """(part, conversation, rows) of bounded size, in the order of the rows."""
    held, chars, now = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["conv"], row["part"])
            if held and (own != now or len(held) >= PIECE_ROWS or chars + len(row["text"]) > PIECE_CHARS):
                yield now[1], now[0], held
                held, chars = [], 0
            now = own
            held.append(row)
            chars += len(row["text"])
    if held:
        yield now[1], now[0], held


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") and role else "x"


def _summary(part: int, conv, piece: int, rows: list[dict]) -> dict:
    faults = "".join(r["fault"] for r in rows)
    roles = "".join(_initial(r["role"]) for r in rows)
    letters = {"b": GONE, "d": GONE, "t": CUT, "o": FINE}
    symbols = "".join(role + letters[fault] for role, fault in zip(roles, faults))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    return {
        "conv": conv,
        "part": part,
        "piece": piece,
        "symbols": symbols,
        "roles": roles[0] + roles[-1],
        "first_turn": min(turns, default=None),
        "last_turn": max(turns, default=None),
        "turns": len(set(turns)),
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
        "matrix": [cost for row in product(symbols) for cost in row],
        "rows": [{"role": r["role"], "text": r["text"]} for r in rows],
    }


def pieces(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows in order, some at a time: ``conv, part, piece`` and what is known of the piece itself."""
    marked = written(_marked(rows), "marked-turns")
    total = marked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranged = marked.repartitionByRange(max(1, -(-total // part_bytes)), *_order()).sortWithinPartitions(*_order())
    schema = _PIECES.format(kind=rows.schema["conv"].dataType.simpleString())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for number, (part, conv, some) in enumerate(_cut(batches)):
            out.append(_summary(part, conv, number, some))
            chars += sum(len(r["text"]) for r in some)
            if len(out) >= 1000 or chars > PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    chosen = ranged.select("conv", F.spark_partition_id().cast("long").alias("part"), "turn", "role", "text", "fault")
    return written(chosen.mapInArrow(run, schema), "pieces")


def _scan(rows: DataFrame, backward: bool) -> DataFrame:
    """Rows of one conversation in one task after the other, in or against their order."""
    order = [F.desc("part"), F.desc("piece")] if backward else [F.asc("part"), F.asc("piece")]
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _followed(cut: DataFrame) -> DataFrame:
    """``part, piece, after, last, cost``: the costs from every state behind each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, after = object(), ENDED
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                last = row["conv"] != now
                if last:
                    now, after = row["conv"], ENDED
                flat = row["matrix"]
                before = apply(tuple(tuple(flat[k : k + 4]) for k in range(0, 16, 4)), after)
                out.append((row["part"], row["piece"], list(after), last, before[START]))
                after = before
            names = ["part", "piece", "after", "last", "cost"]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    narrow = cut.select("conv", "part", "piece", "matrix")
    return _scan(narrow, True).mapInArrow(run, "part long, piece long, after array<long>, last boolean, cost long")


def _unrolled(cut: DataFrame, followed: DataFrame) -> DataFrame:
    """With ``ends`` and ``audits``: where each of the four states leads, and by which edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [unroll(symbols, tuple(after), state) for state in range(4)]
                for symbols, after in zip(batch["symbols"].to_pylist(), batch["after"].to_pylist())
            ]
            kept = ["conv", "part", "piece", "last", "cost"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in kept),
                    pa.array([[state for _, state in four] for four in found], pa.list_(pa.int64())),
                    pa.array([[audit for audit, _ in four] for four in found], pa.list_(pa.string())),
                ],
                names=[*kept, "ends", "audits"],
            )

    kind = cut.schema["conv"].dataType.simpleString()
    joined = cut.select("conv", "part", "piece", "symbols").join(followed, ["part", "piece"])
    schema = f"conv {kind}, part long, piece long, last boolean, cost long, ends array<long>, audits array<string>"
    return written(joined.mapInArrow(run, schema), "unrolled")


def _entered(unrolled: DataFrame) -> DataFrame:
    """``part, piece, state``: the state in which each piece is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), START
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != now:
                    now, state = row["conv"], START
                out.append((row["part"], row["piece"], state))
                state = row["ends"][state]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)], names=["part", "piece", "state"]
            )

    narrow = unrolled.select("conv", "part", "piece", "ends")
    return _scan(narrow, False).mapInArrow(run, "part long, piece long, state long")


def repair(
    df: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    part_bytes: int = PART_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair; ``(report, repaired)``.

    ``report`` has a row per conversation with rows: ``conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit``. ``repaired`` has its rows in bounded pieces: ``conv, part, piece, rows``, an array of
    (role, text) each, in the order of (part, piece).

    Rows stand in the order of their turns, null ones first, those of one turn by role and text. The
    first fault of a row counts: blank, duplicate (role and text stood earlier in the conversation),
    truncated (does not end in ``.``, ``!`` or ``?``). Keeping a row costs 0, another role (user or
    assistant) 3, deleting it 4, which blank and duplicate rows must be, and an inserted empty turn 3;
    a truncated row that stays costs 3 more. Of the cheapest edits that leave the roles' initials
    as ``(s?(ua)+)?`` the ASCII-least initials K, R, D, I are the audit. Null roles and texts are one
    space; a null conversation is one like any other; other columns are left; repeated rows are
    duplicates; an empty table gives no rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(
        df[conv_column].alias("conv"),
        df[turn_column].cast("long").alias("turn"),
        F.coalesce(df[role_column], F.lit(" ")).alias("role"),
        F.coalesce(df[text_column], F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    cut = pieces(rows, part_bytes)
    unrolled = _unrolled(cut, _followed(cut))
    chosen = unrolled.join(_entered(unrolled), ["part", "piece"])
    state = F.col("state").cast("int")
    chosen = written(
        chosen.select(
            "part", "piece", "last", "cost", "state",
            F.get("audits", state).alias("audit"), F.get("ends", state).alias("end"),
        ),
        "chosen",
    )
    return _report(cut, chosen), _repaired(cut, chosen)


def _report(cut: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pieces of a conversation added up; a turn or a pair of roles may stand across two of them."""
    facts = cut.drop("rows", "symbols", "matrix").join(chosen, ["part", "piece"])
    more = F.array(*(F.lit("I" * len(ending(state))) for state in range(4)))
    audit = F.concat("audit", F.when(F.col("last"), F.get(more, F.col("end").cast("int"))).otherwise(""))
    piece = F.struct("part", "piece", "roles", "first_turn", "last_turn", audit.alias("audit"), "cost")
    # As many entries as tasks and pieces of ``PIECE_ROWS`` share the conversation.
    found = facts.groupBy("conv").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")),
        F.max("last_turn").alias("last"),
        F.min("first_turn").alias("first"),
    )
    numbers = F.sequence(F.lit(1), F.size("pieces") - 1)
    numbers = F.when(F.size("pieces") > 1, numbers).otherwise(F.array().cast("array<int>"))
    before, here = (lambda i: F.get("pieces", i - 1)), (lambda i: F.get("pieces", i))
    pair = lambda i: F.concat(F.substring(before(i)["roles"], 2, 1), F.substring(here(i)["roles"], 1, 1))
    broken = F.size(F.filter(numbers, lambda i: ~pair(i).isin("su", "ua", "au")))
    again = F.size(F.filter(numbers, lambda i: before(i)["last_turn"] == here(i)["first_turn"]))
    gaps = F.col("last") - F.col("first") + 1 - (F.col("turns") - again)
    return found.select(
        "conv",
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + broken).cast("long").alias("illegal"),
        F.get("pieces", F.lit(0))["cost"].alias("cost"),
        F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"),
    )


def _repaired(cut: DataFrame, chosen: DataFrame) -> DataFrame:
    kind = cut.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, part long, piece long, rows array<struct<role:string,text:string>>"
    pairs = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, audit, state, end, last in zip(
                *(batch[c].to_pylist() for c in ("rows", "audit", "state", "end", "last"))
            ):
                after = repaired_rows(rows, audit, state)
                if last:
                    after += [(ROLES[role], "") for role in ending(end)]
                out.append([{"role": role, "text": text} for role, text in after])
            kept = [batch[c] for c in ("conv", "part", "piece")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pairs)], names=["conv", "part", "piece", "rows"])

    joined = cut.select("conv", "part", "piece", "rows").join(chosen, ["part", "piece"])
    return joined.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: of the rows as ``role:text``, joined by newlines.

    A digest is of one sequence of bytes, so the pieces of a conversation go by one task, which holds
    one of them at a time.
    """
    kind = repaired.schema["conv"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started, out = None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv"] != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state, started = row["conv"], hashlib.sha256(), False
                for turn in row["rows"]:
                    state.update((("\n" if started else "") + f"{turn['role']}:{turn['text']}").encode())
                    started = True
            if len(out) > 1000:
                yield _digest_batch(out, arrow)
                out = []
        if state is not None:
            out.append((now, state.hexdigest()))
        if out:
            yield _digest_batch(out, arrow)

    return _scan(repaired, False).mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")


def _digest_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    convs, found = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs, kind), pa.array(found, pa.string())], names=["conv", "repaired_sha256"]
    )
