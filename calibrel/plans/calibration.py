"""From conversations to a calibration set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.functions.chat import (
    CHATML,
    ROLE_HEADERS,
    Layout,
    convert,
    convert_turns,
    dropped_turns,
    render,
)
from calibrel.functions.tokens import attention_mask, tokenize, truncate
from calibrel.operators.accounting import classify, merge_parts, merged_facts
from calibrel.operators.assemble import (
    PART_TURNS,
    assemble,
    join_parts,
    long_conversations,
    split_arrays,
    truncate_parts,
)
from calibrel.operators.filters import settle
from calibrel.operators.long_texts import join_tokens, tokens_of_parts
from calibrel.operators.sampling import SEED, sample_conversations, sample_rows
from calibrel.operators.vocabulary import encode
from calibrel.session import bounded_batches


@dataclass(frozen=True)
class Calibration:
    """What a calibration set is made of."""

    n: int = 512
    seed: int = SEED
    mode: str = "lenient"
    layout: Layout = ROLE_HEADERS
    least_turns: int = 0
    least_tokens: int = 0
    max_length: int | None = 2048
    # "fail" stops the job on a conversation that cannot be rendered, "skip" counts it
    on_error: str = "fail"
    # begin token put in front of the rendered text once more before its length is tested
    extra_bos: str | None = None
    # text to ids by the caller's tokenizer; the length is tested and cut on what it gives, and a
    # text with null ids has failed
    tokenizer: Callable[[Column], Column] | None = None
    # text to an array of (id, end of the token in the text), with the tokenizer's ids: conversations
    # of several parts are then tokenized part by part
    token_ends: Callable[[Column], Column] | None = None

    @property
    def filters(self) -> bool:
        return self.on_error == "skip" or self.least_turns > 0 or self.least_tokens > 0


# Sample sizes, limits and role handling of the usual jobs.
PRESETS = {
    "w8a8_messages": Calibration(n=512, mode="as_is", layout=CHATML),
    "w8a8_sharegpt": Calibration(n=1024, mode="strict", layout=CHATML),
    "gptq_ids": Calibration(n=1024, mode="strict", layout=CHATML, max_length=None),
    "gptq_text": Calibration(
        n=2048, least_turns=2, least_tokens=10, on_error="skip", extra_bos=ROLE_HEADERS.bos
    ),
    "w8a8_mixed": Calibration(n=512),
    "text_export": Calibration(n=4001, max_length=None),
}


def take_sample(
    source: DataFrame,
    options: Calibration,
    key: str = "conv_id",
    shape: str = "sharegpt",
    element: Column | None = None,
    on_short: str = "error",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """n sampled conversations as arrays, from array rows or from flat turn rows.

    The sample is taken before any other work and never filled up again after filters.
    """
    if "turn" not in source.columns:
        return sample_rows(source, key, options.n, options.seed, on_short)
    sampled = sample_conversations(source, options.n, options.seed, on_short, key)
    return assemble(sampled, shape, key, part_turns=part_turns, element=element)


def with_text(
    rows: DataFrame,
    options: Calibration,
    column: str = "conversations",
    closes: Column | None = None,
    add_generation_prompt: bool = False,
) -> DataFrame:
    """Adds ``chat`` and ``text`` and keeps the other columns."""
    opens = F.col("part") == 0 if "part" in rows.columns else None
    chat = convert(F.col(column), options.mode, tolerant=options.on_error == "skip")
    text = render(F.col("chat"), options.layout, add_generation_prompt, opens, closes)
    if options.on_error == "fail":
        text = F.coalesce(
            text, F.raise_error(F.lit("conversation cannot be rendered")).cast("string")
        )
    return rows.withColumn("chat", chat).withColumn("text", text)


def tokens_of(text: Column, options: Calibration) -> Column:
    return options.tokenizer(text) if options.tokenizer else tokenize(text)


def with_tokens(
    rows: DataFrame, options: Calibration, column: str = "conversations", **_
) -> DataFrame:
    """Adds ``tokens`` of the whole text to what ``with_text`` adds, for rows of whole conversations.

    Tokens are ids where there is a tokenizer. The extra begin token stands before the text.
    """
    text = F.col("text")
    if options.tokenizer is not None:
        bounded_batches(rows.sparkSession)
    if options.extra_bos is None:
        tokens = tokens_of(text, options)
    elif options.tokenizer is None:
        tokens = tokenize(text, options.extra_bos)
    else:
        tokens = options.tokenizer(F.concat(F.lit(options.extra_bos), text))
    if options.on_error == "fail" and options.tokenizer is not None:
        failed = F.raise_error(F.lit("conversation cannot be tokenized"))
        tokens = F.when(text.isNotNull(), F.coalesce(tokens, failed.cast("array<int>")))
    return with_text(rows, options, column).withColumn("tokens", tokens)


def with_part_tokens(
    parts: DataFrame, options: Calibration, key: str = "conv_id", column: str = "conversations"
) -> DataFrame:
    """Adds ``chat``, ``text`` and ``tokens`` to parts of conversations.

    In the order of the parts the tokens are those of one call on the whole text.
    """
    rows = settle(with_text(parts, options, column), "chat", "text")
    text, own = F.col("text"), options.tokenizer is not None
    if own:
        bounded_batches(parts.sparkSession)
    if options.extra_bos is not None and own:
        text = F.when(F.col("part") == 0, F.concat(F.lit(options.extra_bos), text)).otherwise(text)
    given = rows.select(key, "part", text.alias("text"))
    tokens = tokens_of_parts(given, key, lambda t: tokens_of(t, options), options.token_ends, blanks=not own)
    rows = rows.join(tokens, [key, "part"], "left")
    if options.extra_bos is not None and not own:
        opened = F.concat(F.array(F.lit(options.extra_bos)), F.col("tokens"))
        rows = rows.withColumn("tokens", F.when(F.col("part") == 0, opened).otherwise(F.col("tokens")))
    if options.on_error == "fail" and own:
        failed = F.raise_error(F.lit("conversation cannot be tokenized"))
        rows = rows.withColumn("tokens", F.coalesce("tokens", failed.cast("array<int>")))
    return rows


def turns_digest(conversations: Column, options: Calibration, start: Column | int) -> Column:
    """Exclusive or over the turns' hashes of position, role and content."""
    turns = convert_turns(conversations, options.mode, start, tolerant=True)
    written = F.transform(
        turns,
        lambda t: F.concat(t["position"].cast("string"), F.lit(":"), t["role"], F.lit("="), t["content"]),
    )
    return F.aggregate(
        written,
        F.lit(0).cast("bigint"),
        lambda acc, w: acc.bitwiseXOR(F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("bigint")),
    )


def with_facts(
    rows: DataFrame,
    options: Calibration,
    column: str = "conversations",
    raw: str | None = None,
    parts_of: str | None = None,
) -> DataFrame:
    """Adds what the skip rules look at: turns, tokens, missing fields and failures.

    ``raw`` is the unparsed column, where there is one: null means missing, while null
    after parsing means failed. Rows are whole conversations, or parts of those that ``parts_of``
    names.
    """
    start = F.col("start") if "start" in rows.columns else 0
    # filters on the facts must not render and tokenize once more
    if parts_of is None:
        tokenized = settle(with_tokens(rows, options, column), "chat", "text", "tokens")
    else:
        tokenized = with_part_tokens(rows, options, parts_of, column)
    return tokenized.select(
        "*",
        F.col(raw or column).isNull().alias("missing"),
        (F.col("text").isNull() | F.col("tokens").isNull()).alias("failed"),
        F.size("chat").alias("n_turns"),
        dropped_turns(F.col(column)).alias("dropped"),
        F.size("tokens").alias("n_tokens"),
        turns_digest(F.col(column), options, start).alias("digest"),
    )


def _classified(facts: DataFrame, options: Calibration) -> DataFrame:
    return classify(facts, options.least_turns, options.least_tokens, options.max_length)


def conversation_facts(
    rows: DataFrame, options: Calibration, key: str = "conv_id", column: str = "conversations", **read
) -> DataFrame:
    """One row per conversation: its facts and the ``reason`` it is kept or skipped for.

    The same for array rows and for parts of any size.
    """
    if "part" not in rows.columns:
        return _classified(with_facts(rows, options, column, **read), options)
    whole, parts = split_by_length(rows, key, column)
    counts = ("n_turns", "dropped", "n_tokens")
    facts = with_facts(whole, options, column, **read).select(
        key, "missing", "failed", *(F.col(c).cast("bigint").alias(c) for c in counts), "digest"
    )
    if parts is not None:
        facts = facts.unionByName(merge_parts(with_facts(parts, options, column, parts_of=key, **read), key))
    return _classified(facts, options)


def split_by_length(rows: DataFrame, key: str, column: str = "conversations") -> tuple[DataFrame, DataFrame | None]:
    """Rows that hold a whole conversation, and the parts of the longer ones if there are any.

    A whole conversation is judged and cut on its own row; only the long ones need their
    parts counted together. Array rows longer than a part are cut like parts; the rows of a
    stream are taken as they are.
    """
    if "part" not in rows.columns:
        rows = rows.withColumn("part", F.lit(0).cast("bigint")).withColumn("start", F.lit(0).cast("bigint"))
        if rows.isStreaming:
            return rows, None
        long = F.coalesce(F.size(column) > PART_TURNS, F.lit(False))
        if rows.filter(long).isEmpty():
            return rows, None
        return rows.filter(~long), split_arrays(rows.filter(long).drop("part", "start"), column)
    keys, n = long_conversations(rows, key)
    if n == 0:
        return rows, None
    return rows.join(keys, key, "left_anti"), rows.join(keys, key, "left_semi")


def _accepted_whole(rows: DataFrame, options: Calibration, **read) -> DataFrame:
    if not options.filters:
        return with_tokens(rows, options, **read)
    facts = with_facts(rows, options, **read)
    return _classified(facts, options).filter(F.col("reason") == "ok")


def accepted(
    rows: DataFrame, options: Calibration, key: str = "conv_id", column: str = "conversations", **read
) -> DataFrame:
    """``(key, part, start, text, tokens)`` of the conversations that pass all filters.

    Conversations of up to ``PART_TURNS`` turns are one row, longer ones as many as they have parts.
    """
    columns = [key, "part", "start", "text", "tokens"]
    whole, parts = split_by_length(rows, key, column)
    kept = _accepted_whole(whole, options, column=column, **read).select(columns)
    if parts is None:
        return kept
    if not options.filters:
        return kept.unionByName(with_part_tokens(parts, options, key, column).select(columns))
    facts = with_facts(parts, options, column, parts_of=key, **read)
    passed = _classified(merge_parts(facts, key), options).filter(F.col("reason") == "ok")
    return kept.unionByName(facts.join(passed.select(key), key, "left_semi").select(columns))


def calibration_texts(
    rows: DataFrame, options: Calibration, key: str = "conv_id", column: str = "conversations", **read
) -> DataFrame:
    """``(key, part, text)``: whole texts, uncut even where the length test cuts.

    One row for up to ``PART_TURNS`` turns; longer conversations have several, cut alike
    whatever the rows given hold.
    """
    columns = [key, "part", "text"]
    whole, parts = split_by_length(rows, key, column)
    if not options.filters:
        kept = with_text(whole, options, column).select(columns)
        if parts is None:
            return kept
        texts = with_text(parts, options, column).select(key, "part", "start", "text")
    else:
        kept = _accepted_whole(whole, options, column=column, **read).select(columns)
        if parts is None:
            return kept
        facts = with_facts(parts, options, column, parts_of=key, **read)
        passed = _classified(merge_parts(facts, key), options).filter(F.col("reason") == "ok")
        texts = facts.join(passed.select(key), key, "left_semi").select(key, "part", "start", "text")
    joined = join_parts(texts, key, text=lambda pieces: F.array_join(pieces, ""))
    return kept.unionByName(joined.select(columns))


def _tokens_in_parts(rows: DataFrame, options: Calibration, key: str, **read) -> DataFrame:
    """``(key, part, tokens)`` of the kept conversations, uncut; the extra begin token is never among them."""
    if options.extra_bos is None or not options.filters:
        return accepted(rows, replace(options, extra_bos=None), key, **read).select(key, "part", "tokens")
    column = read.get("column", "conversations")
    passed = accepted(rows, options, key, **read).select(key).distinct()
    whole, parts = split_by_length(rows.join(passed, key, "left_semi"), key, column)
    plain = replace(options, extra_bos=None)
    kept = with_tokens(whole, plain, column).select(key, "part", "tokens")
    if parts is None:
        return kept
    return kept.unionByName(with_part_tokens(parts, plain, key, column).select(key, "part", "tokens"))


def _cut(
    rows: DataFrame, options: Calibration, key: str, name: str, column: str = "conversations", **read
) -> DataFrame:
    """``(key, name)`` with the first ``max_length`` tokens per conversation."""
    plain = replace(options, extra_bos=None)
    whole, parts = split_by_length(rows, key, column)
    tokens = F.col("tokens")
    if options.extra_bos is not None:
        # the extra begin token is only tested with, never part of a set
        tokens = tokens_of(F.col("text"), options)
    cut = _accepted_whole(whole, options, column=column, **read).select(
        key, truncate(tokens, options.max_length).alias(name)
    )
    if parts is None:
        return cut
    every = with_part_tokens(parts, plain, key, column).select(key, "part", F.col("tokens").alias(name))
    if options.filters:
        facts = with_facts(parts, options, column, parts_of=key, **read)
        passed = _classified(merge_parts(facts, key), options).filter(F.col("reason") == "ok")
        every = every.join(passed.select(key), key, "left_semi")
    return cut.unionByName(truncate_parts(every, name, options.max_length, key).select(key, name))


def calibration_tokens(rows: DataFrame, options: Calibration, key: str = "conv_id", **read) -> DataFrame:
    """``(key, tokens)``: the tokens of each conversation in one row, cut to ``max_length`` if there is one."""
    if options.max_length is not None:
        return _cut(rows, options, key, "tokens", **read)
    return join_tokens_of(_tokens_in_parts(rows, options, key, **read), rows, key, "tokens", **read)


def join_tokens_of(
    tokens: DataFrame, rows: DataFrame, key: str, name: str, column: str = "conversations", **_
) -> DataFrame:
    """One row per conversation; only those of several parts are gathered."""
    if "part" in rows.columns:
        keys, n = long_conversations(rows, key)
        keys = keys.select(key)
    else:
        keys = tokens.filter(F.col("part") > 0).select(key).distinct()
        n = 0 if rows.isStreaming else rows.filter(F.size(column) > PART_TURNS).limit(1).count()
    if n == 0:
        return tokens.select(key, name)
    short = tokens.join(keys, key, "left_anti").select(key, name)
    return short.unionByName(join_tokens(tokens.join(keys, key, "left_semi"), key, name))


def calibration_ids(
    rows: DataFrame,
    options: Calibration,
    vocabulary: DataFrame | None = None,
    key: str = "conv_id",
    unknown_id: int = -1,
    begin: int | None = None,
    end: int | None = None,
    **read,
) -> DataFrame:
    """``(key, input_ids, attention_mask)``, one row per conversation; every other column is dropped.

    Ids come from a vocabulary table or from the options' tokenizer, which must add no special
    tokens itself: they are those of one call on the whole text, however long the conversation is
    and however its turns came. ``begin`` and ``end`` stand before the first and behind the last id
    of a conversation, before it is cut.
    """
    if (vocabulary is None) == (options.tokenizer is None):
        raise ValueError("give a vocabulary or a tokenizer")
    length, name = options.max_length, "input_ids"
    if vocabulary is None:
        ids = calibration_tokens(rows, options, key, **read).withColumnRenamed("tokens", name)
    elif length is not None:
        tokens = calibration_tokens(rows, options, key, **read)
        ids = encode(tokens, "tokens", vocabulary, [key], unknown_id).withColumnRenamed("tokens", name)
    else:
        # parts are encoded before they are put together
        tokens = _tokens_in_parts(rows, options, key, **read)
        coded = encode(tokens, "tokens", vocabulary, [key, "part"], unknown_id).withColumnRenamed("tokens", name)
        ids = join_tokens_of(coded, rows, key, name, **read)
    value = F.col(name)
    if begin is not None:
        value = F.concat(F.array(F.lit(begin)), value)
    if end is not None:
        value = F.concat(value, F.array(F.lit(end)))
    if (begin is not None or end is not None) and length is not None:
        value = truncate(value, length)
    return ids.select(key, value.alias(name)).withColumn("attention_mask", attention_mask(F.col(name)))
