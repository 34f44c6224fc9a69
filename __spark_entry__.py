"""Registered queries and the SQL that gives the same rows.

Every query runs over whole tables. ``conversations`` is flat and clean, so the shapes the
library has to cope with are derived from it, in the query and in its SQL alike.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Callable, Mapping
from dataclasses import replace
from itertools import accumulate

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrel.functions import (
    CHATML,
    LABELS,
    ROLE_HEADERS,
    Layout,
    artifact_name,
    convert,
    dropped_turns,
    pad_fallback,
    render,
    tokenize,
)
from calibrel.functions.chat import WHITESPACE
from calibrel.functions.tokens import TOKEN_PATTERN, batch_tokenizer
from calibrel.operators.accounting import account, any_in, frequency
from calibrel.operators.assemble import PART_TURNS, assemble, join_parts, mark_last_part
from calibrel.operators.error import recon_error
from calibrel.operators.filters import (
    min_tokens,
    min_turns,
    name_contains,
    require_rows,
    select_targets,
)
from calibrel.operators.codes import (
    FP8_MAX,
    channel_scales,
    dequantize,
    fp8_codes,
    int_codes,
)
from calibrel.operators.runs import run_compare, run_summary
from calibrel.operators.sampling import first_conversations, peek, sample_n, shuffle_key
from calibrel.operators.smooth import smooth, smooth_scales
from calibrel.operators.stats import (
    channel_state,
    channel_stats,
    importance,
    merge_states,
    second_moment,
    stats_of,
)
from calibrel.operators.vocabulary import build_vocabulary, detokenize, encode
from calibrel.plans.calibration import (
    PRESETS,
    Calibration,
    calibration_ids,
    calibration_texts,
    calibration_tokens,
    conversation_facts,
    take_sample,
    with_text,
)
from calibrel.plans.recipe import IntCodes, Smooth, run_recipe, run_recipe_on_both
from calibrel.session import scratch_path
from calibrel.sinks import read_codes, write_calibration, write_codes, write_sharded, write_text
from calibrel.sources import (
    parse_conversations,
    read_conversations,
    read_run_logs,
    read_stage_logs,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- conversations: shapes derived from the flat table -------------------------------------


def source_role(role: Column) -> Column:
    return F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)


def sharegpt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.withColumn("role", source_role(F.col("role")))


SHAREGPT_SQL = """
turns AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS source_role
  FROM conversations)"""


def mixed_turn() -> Column:
    """Turns in both shapes, in neither, or with unknown roles, by position."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(11))
    blank = (k == 0) | ((F.pmod(F.col("conv_id"), F.lit(31)) == 7) & (F.col("turn") > 0))
    role, text = F.col("role"), F.col("text")
    from_ = F.when(blank | k.isin(1, 2), None).when(k == 3, "narrator").otherwise(source_role(role))
    value = F.when(blank | k.isin(1, 2, 5), None).otherwise(text)
    chat_role = F.when(~blank & k.isin(1, 2, 4, 5), role)
    content = F.when(~blank & k.isin(1, 2, 5), text).when(~blank & (k == 4), "ignored")
    return F.struct(
        from_.alias("from"), value.alias("value"), chat_role.alias("role"), content.alias("content")
    )


def broken_arrays(rows: DataFrame) -> DataFrame:
    """Some conversations without the field and some with text that is not JSON."""
    conv_id = F.col("conv_id")
    raw = (
        F.when(F.pmod(conv_id, F.lit(29)) == 5, None)
        .when(F.pmod(conv_id, F.lit(41)) == 9, "{bad")
        .otherwise(F.to_json("conversations"))
    )
    return rows.withColumn("raw", raw).withColumn(
        "conversations", parse_conversations(F.col("raw"))
    )


def mixed_rows(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    rows = assemble(table(spark, sf_dir, "conversations"), element=mixed_turn())
    return broken_arrays(rows) if broken else rows


MIXED_SQL = """
marked AS (
  SELECT *, (conv_id * 7 + turn) % 11 AS k,
         ((conv_id * 7 + turn) % 11 = 0) OR (conv_id % 31 = 7 AND turn > 0) AS blank,
         CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS source_role
  FROM conversations),
mixed AS (
  SELECT conv_id, turn,
         CASE WHEN blank OR k IN (1, 2) THEN NULL WHEN k = 3 THEN 'narrator'
              ELSE source_role END AS f,
         CASE WHEN blank OR k IN (1, 2, 5) THEN NULL ELSE text END AS v,
         CASE WHEN NOT blank AND k IN (1, 2, 4, 5) THEN role END AS r,
         CASE WHEN NOT blank AND k IN (1, 2, 5) THEN text
              WHEN NOT blank AND k = 4 THEN 'ignored' END AS c
  FROM marked),
judged AS (
  SELECT conv_id, turn,
         (f IS NOT NULL AND v IS NOT NULL) OR (r IS NOT NULL AND c IS NOT NULL) AS known,
         CASE WHEN f IS NOT NULL AND v IS NOT NULL
              THEN CASE f WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE f END
              ELSE r END AS role,
         CASE WHEN f IS NOT NULL AND v IS NOT NULL THEN v ELSE c END AS content
  FROM mixed),
chat AS (SELECT * FROM judged WHERE known)"""


def fragment_sql(layout: Layout, role: str, content: str) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("\n", "' || chr(10) || '") + "'"

    def chosen(usual: str, special: Mapping[str, str]) -> str:
        cases = "".join(f" WHEN '{name}' THEN {quoted(text)}" for name, text in special.items())
        return f"CASE {role}{cases} ELSE {usual} END" if cases else usual

    if layout.strip_content:
        space = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
        content = f"regexp_replace({content}, '^{space}+|{space}+\\z', '', 'g')"
    pieces = (
        chosen(quoted(layout.before_role), layout.before_role_of),
        chosen(role, layout.role_names),
        chosen(quoted(layout.after_role), layout.after_role_of),
        content,
        chosen(quoted(layout.after_content), layout.after_content_of),
    )
    return " || ".join(f"({p})" for p in pieces)


def text_sql(layout: Layout, source: str, role: str = "role", content: str = "text") -> str:
    """``rendered(conv_id, text)`` of a CTE with one row per turn."""
    return f"""
rendered AS (
  SELECT conv_id, '{layout.bos}' ||
         string_agg({fragment_sql(layout, role, content)}, '' ORDER BY turn) AS text
  FROM {source} GROUP BY conv_id)"""


# Like text_sql on the mixed shape, where every turn of a conversation may be dropped.
def mixed_text_sql(layout: Layout) -> str:
    return f"""
rendered AS (
  SELECT conv_id, '{layout.bos}' || coalesce(
           string_agg({fragment_sql(layout, 'role', 'content')}, '' ORDER BY turn)
             FILTER (WHERE known), '') AS text
  FROM judged GROUP BY conv_id)"""


TOKENS_SQL = f"regexp_extract_all(text, '{TOKEN_PATTERN}')"
SHUFFLE_SQL = "md5('42:' || CAST(conv_id AS VARCHAR))"
# an exclusive or over the turns kept
DIGEST_SQL = """coalesce(bit_xor(CAST(('0x' || substr(md5(turn || ':' || role || '=' || content), 1, 15))
  AS BIGINT)) FILTER (WHERE known), 0)"""


def vocabulary_sql(source: str) -> str:
    """``vocabulary(token, id)`` of the column text of a table."""
    return f"""
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY substr(md5(token), 1, 3), token) - 1 AS id
  FROM (SELECT DISTINCT unnest({TOKENS_SQL}) AS token FROM {source}))"""


def vocabulary_of(texts: DataFrame) -> DataFrame:
    """The vocabulary of a text column, written once and read from there."""
    spark = texts.sparkSession
    path = scratch_path(spark, "vocabulary")
    # each text names a token once, which leaves less to count before the shuffle
    tokens = texts.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    build_vocabulary(tokens).write.parquet(path)
    return spark.read.parquet(path)


def joined(values: str | Column, glue: str = ",") -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(values, lambda v: v.cast("string")), glue)


def chat_digest(chat: Column) -> Column:
    return F.md5(
        F.array_join(
            F.transform(chat, lambda t: F.concat(t["role"], F.lit("="), t["content"])), "|"
        )
    )


CHAT_DIGEST_SQL = "md5(string_agg({role} || '=' || {content}, '|' ORDER BY turn))"


# --- sampling, assembly, rendering ----------------------------------------------------------


@query(
    "sample_n",
    f"""
SELECT conv_id, {SHUFFLE_SQL} AS shuffle_key
FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY shuffle_key, conv_id LIMIT 50""",
)
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "conversations").select("conv_id")
    return sample_n(keys, "conv_id", 50, on_short="truncate").distinct()


@query(
    "sample_n_by_cutting",
    f"""
SELECT l_partkey, md5('7:' || CAST(l_partkey AS VARCHAR)) AS shuffle_key
FROM (SELECT DISTINCT l_partkey FROM lineitem) ORDER BY shuffle_key LIMIT 1500""",
)
def _(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select("l_partkey")
    return sample_n(parts, "l_partkey", 1500, seed=7, on_short="truncate").distinct()


@query(
    "scan_split",
    """
SELECT conv_id, count(*) AS n_turns FROM conversations
GROUP BY conv_id HAVING substr(md5(CAST(conv_id AS VARCHAR)), 1, 1) >= '8'""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split = F.when(F.md5(F.col("conv_id").cast("string")) >= "8", "train").otherwise("test")
    rows = assemble(table(spark, sf_dir, "conversations"), "chat").withColumn("split", split)
    rows.write.partitionBy("split").parquet(path)
    found = read_conversations(spark, path, split="train")
    return found.select("conv_id", F.size("conversations").cast("bigint").alias("n_turns"))


@query(
    "scan_json",
    f"""
WITH {MIXED_SQL}
SELECT conv_id, count(*) FILTER (WHERE known) AS n_known, count(*) AS n_turns
FROM judged GROUP BY conv_id""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "json")
    mixed_rows(spark, sf_dir).select("conv_id", "conversations").write.json(path)
    schema = (
        "conv_id bigint, conversations "
        "array<struct<from:string,value:string,role:string,content:string>>"
    )
    rows = read_conversations(spark, path, schema=schema, format="json")
    return rows.select(
        "conv_id",
        F.size(convert(F.col("conversations"))).cast("bigint").alias("n_known"),
        F.size("conversations").cast("bigint").alias("n_turns"),
    )


@query(
    "assemble",
    f"""
WITH {SHAREGPT_SQL}
SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n_turns,
       md5(string_agg(source_role || '=' || text, '|' ORDER BY turn)) AS digest
FROM turns GROUP BY conv_id""",
)
def _(spark, sf_dir):
    return assembled(assemble(sharegpt_turns(spark, sf_dir)))


@query(
    "assemble_in_parts",
    f"""
WITH {SHAREGPT_SQL}
SELECT conv_id, turn // 3 AS part, count(*) AS n_turns,
       md5(string_agg(source_role || '=' || text, '|' ORDER BY turn)) AS digest
FROM turns GROUP BY conv_id, turn // 3""",
)
def _(spark, sf_dir):
    return assembled(assemble(sharegpt_turns(spark, sf_dir), part_turns=3))


def assembled(rows: DataFrame) -> DataFrame:
    turns = F.transform(
        "conversations", lambda t: F.concat(t["from"], F.lit("="), t["value"])
    )
    return rows.select(
        "conv_id",
        "part",
        F.size("conversations").cast("bigint").alias("n_turns"),
        F.md5(F.array_join(turns, "|")).alias("digest"),
    )


def rendered(spark: SparkSession, sf_dir: str, layout: Layout) -> DataFrame:
    rows = assemble(table(spark, sf_dir, "conversations"), "chat")
    options = Calibration(mode="as_is", layout=layout)
    return with_text(rows, options).select(
        "conv_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars")
    )


def rendered_sql(layout: Layout) -> str:
    return f"""
WITH {text_sql(layout, "conversations")}
SELECT conv_id, md5(text) AS digest, length(text) AS n_chars FROM rendered"""


@query("render_headers", rendered_sql(ROLE_HEADERS))
def _(spark, sf_dir):
    return rendered(spark, sf_dir, ROLE_HEADERS)


@query("render_labels", rendered_sql(LABELS))
def _(spark, sf_dir):
    return rendered(spark, sf_dir, LABELS)


@query("render_chatml", rendered_sql(CHATML))
def _(spark, sf_dir):
    return rendered(spark, sf_dir, CHATML)


@query(
    "render_prompt_in_parts",
    f"""
WITH {text_sql(CHATML, "conversations")}
SELECT conv_id, text || '<|im_start|>assistant' || chr(10) AS text FROM rendered""",
)
def _(spark, sf_dir):
    parts = mark_last_part(assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3))
    text = render(
        convert(F.col("conversations"), "as_is"),
        CHATML,
        add_generation_prompt=True,
        opens=F.col("part") == 0,
        closes=F.col("closes"),
    )
    texts = parts.select("conv_id", "start", text.alias("text"))
    return join_parts(texts, "conv_id", text=lambda pieces: F.array_join(pieces, "")).drop("part")


# Two fifths of the conversations, a sample that bites at every scale; presets run with their own n too.
SAMPLED = "(SELECT count(DISTINCT conv_id) * 2 // 5 FROM conversations)"


def sampled_n(spark: SparkSession, sf_dir: str) -> int:
    found = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id")).first()[0]
    return found * 2 // 5


def export_sql(n: int | str = SAMPLED) -> str:
    return f"""
{MIXED_SQL}, {mixed_text_sql(ROLE_HEADERS)},
sampled AS (SELECT conv_id, text FROM rendered ORDER BY {SHUFFLE_SQL}, conv_id LIMIT {n})"""


def export_texts(
    spark: SparkSession, sf_dir: str, part_turns: int = PART_TURNS, n: int | None = None
) -> DataFrame:
    options = replace(PRESETS["text_export"], n=sampled_n(spark, sf_dir) if n is None else n)
    turns = table(spark, sf_dir, "conversations")
    rows = take_sample(turns, options, element=mixed_turn(), on_short="truncate", part_turns=part_turns)
    return calibration_texts(rows, options)


@query(
    "text_export_rows",
    f"WITH {export_sql(PRESETS['text_export'].n)} SELECT conv_id, CAST(0 AS BIGINT) AS part, text FROM sampled",
)
def _(spark, sf_dir):
    return export_texts(spark, sf_dir, n=PRESETS["text_export"].n)


WRITTEN_SQL = f"""
WITH {export_sql()}
SELECT line, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM sampled) GROUP BY line"""


def lines_written(texts: DataFrame) -> DataFrame:
    path = scratch_path(texts.sparkSession, "text")
    write_text(texts, path, order_by=(shuffle_key(F.col("conv_id")),))
    lines = texts.sparkSession.read.text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("text_export_written", WRITTEN_SQL)
def _(spark, sf_dir):
    return lines_written(export_texts(spark, sf_dir))


@query("text_export_written_in_parts", WRITTEN_SQL)
def _(spark, sf_dir):
    return lines_written(export_texts(spark, sf_dir, part_turns=3))


@query(
    "text_lines_of_parts",
    f"""
WITH {text_sql(CHATML, "conversations")}
SELECT line, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM rendered) GROUP BY line""",
)
def _(spark, sf_dir):
    # the parts as they are, so that lines run over the borders of rows
    parts = assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3)
    options = Calibration(mode="as_is", layout=CHATML)
    return lines_written(with_text(parts, options).select("conv_id", "part", "text"))


# --- conversion ------------------------------------------------------------------------------


@query(
    "convert_strict",
    f"""
SELECT conv_id, count(*) AS n_turns,
       {CHAT_DIGEST_SQL.format(role="role", content="text")} AS digest
FROM conversations GROUP BY conv_id""",
)
def _(spark, sf_dir):
    chat = convert(F.col("conversations"), "strict")
    return (
        assemble(sharegpt_turns(spark, sf_dir))
        .withColumn("chat", chat)
        .select("conv_id", F.size("chat").cast("bigint").alias("n_turns"),
                chat_digest(F.col("chat")).alias("digest"))
    )


@query(
    "convert_lenient",
    f"""
WITH {MIXED_SQL}
SELECT conv_id, count(*) FILTER (WHERE known) AS n_turns,
       md5(coalesce(string_agg(role || '=' || content, '|' ORDER BY turn) FILTER (WHERE known), ''))
         AS digest
FROM judged GROUP BY conv_id""",
)
def _(spark, sf_dir):
    return (
        mixed_rows(spark, sf_dir)
        .withColumn("chat", convert(F.col("conversations")))
        .select("conv_id", F.size("chat").cast("bigint").alias("n_turns"),
                chat_digest(F.col("chat")).alias("digest"))
    )


@query(
    "unknown_turns",
    f"""
WITH {MIXED_SQL}
SELECT conv_id, count(*) FILTER (WHERE NOT known) AS dropped FROM judged GROUP BY conv_id""",
)
def _(spark, sf_dir):
    return mixed_rows(spark, sf_dir).select(
        "conv_id", dropped_turns(F.col("conversations")).cast("bigint").alias("dropped")
    )


@query(
    "min_turns",
    f"""
WITH {MIXED_SQL}
SELECT conv_id, count(*) AS n_turns FROM chat GROUP BY conv_id HAVING count(*) >= 2""",
)
def _(spark, sf_dir):
    rows = mixed_rows(spark, sf_dir).withColumn("chat", convert(F.col("conversations")))
    return min_turns(rows, 2).select("conv_id", F.size("chat").cast("bigint").alias("n_turns"))


@query(
    "peek",
    f"""
WITH {SHAREGPT_SQL}
SELECT conv_id, string_agg(source_role || '=' || text, '|' ORDER BY turn) AS turns FROM turns
WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn < 2 GROUP BY conv_id""",
)
def _(spark, sf_dir):
    first = peek(assemble(first_conversations(sharegpt_turns(spark, sf_dir))), "conv_id", n=1, turns=2)
    turns = F.transform(
        "conversations", lambda t: F.concat(t["from"], F.lit("="), t["value"])
    )
    return first.select("conv_id", F.array_join(turns, "|").alias("turns"))


# --- tokens ----------------------------------------------------------------------------------


@query(
    "tokenize_truncate",
    f"""
WITH {text_sql(ROLE_HEADERS, "conversations")}
SELECT conv_id, least(len({TOKENS_SQL}), 128) AS n_tokens,
       md5(array_to_string({TOKENS_SQL}[1:128], ' ')) AS digest
FROM rendered""",
)
def _(spark, sf_dir):
    # parts of three turns, so that the cut runs through conversations of several parts
    rows = assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3)
    options = Calibration(mode="as_is", max_length=128)
    return calibration_tokens(rows, options).select(
        "conv_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(
    "token_lengths",
    f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS BIGINT) AS n_tokens FROM documents",
)
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id", F.size(tokenize(F.col("text"))).cast("bigint").alias("n_tokens")
    )


@query(
    "min_tokens",
    f"""
SELECT doc_id, CAST(len({TOKENS_SQL}) AS BIGINT) AS n_tokens FROM documents
WHERE len({TOKENS_SQL}) >= 50""",
)
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tokens = documents.select("doc_id", tokenize(F.col("text")).alias("input_ids"))
    return min_tokens(tokens, 50).select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_tokens")
    )


@query(
    "vocabulary",
    f"WITH {vocabulary_sql('documents')} SELECT token, CAST(id AS INTEGER) AS id FROM vocabulary",
)
def _(spark, sf_dir):
    return vocabulary_of(table(spark, sf_dir, "documents"))


ENCODED_SQL = f"""
{vocabulary_sql("rendered")},
placed AS (
  SELECT conv_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
  FROM (SELECT conv_id, {TOKENS_SQL} AS tokens FROM rendered))"""


ENCODE_CHAT_SQL = f"""
WITH {text_sql(CHATML, "conversations")}, {ENCODED_SQL}
SELECT conv_id, count(*) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids,
       count(*) AS mask_sum
FROM placed JOIN vocabulary USING (token) GROUP BY conv_id"""


def chat_ids(spark: SparkSession, sf_dir: str, part_turns: int = PART_TURNS) -> DataFrame:
    rows = assemble(sharegpt_turns(spark, sf_dir), part_turns=part_turns)
    vocabulary = vocabulary_of(calibration_texts(rows, PRESETS["gptq_ids"]))
    return encoded(calibration_ids(rows, PRESETS["gptq_ids"], vocabulary))


@query("encode_chat", ENCODE_CHAT_SQL)
def _(spark, sf_dir):
    return chat_ids(spark, sf_dir)


@query("encode_chat_in_parts", ENCODE_CHAT_SQL)
def _(spark, sf_dir):
    return chat_ids(spark, sf_dir, part_turns=3)


@query(
    "encode_chat_with_edges",
    ENCODE_CHAT_SQL.replace("count(*) AS n_ids, string_agg", "count(*) + 2 AS n_ids, '-7,' || string_agg")
    .replace("ORDER BY pos) AS ids", "ORDER BY pos) || ',-9' AS ids")
    .replace("count(*) AS mask_sum", "count(*) + 2 AS mask_sum"),
)
def _(spark, sf_dir):
    rows = assemble(sharegpt_turns(spark, sf_dir), part_turns=3)
    vocabulary = vocabulary_of(calibration_texts(rows, PRESETS["gptq_ids"]))
    return encoded(calibration_ids(rows, PRESETS["gptq_ids"], vocabulary, begin=-7, end=-9))


def encoded(ids: DataFrame) -> DataFrame:
    return ids.select(
        "conv_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        joined("input_ids").alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).cast("bigint").alias("mask_sum"),
    )


@query(
    "detokenize",
    f"SELECT doc_id, md5(array_to_string({TOKENS_SQL}, ' ')) AS digest FROM documents",
)
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    vocabulary = vocabulary_of(documents)
    tokens = documents.select("doc_id", tokenize(F.col("text")).alias("ids"))
    ids = encode(tokens, "ids", vocabulary, ["doc_id"])
    texts = detokenize(ids, "ids", vocabulary, ["doc_id"])
    return texts.select("doc_id", F.md5("text").alias("digest"))


@query(
    "encode_large_vocabulary",
    f"""
WITH {vocabulary_sql("documents")}
SELECT doc_id, count(*) AS n_ids, CAST(sum(id) AS BIGINT) AS id_sum
FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents) JOIN vocabulary USING (token)
GROUP BY doc_id""",
)
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tokens = documents.select("doc_id", tokenize(F.col("text")).alias("ids"))
    ids = encode(tokens, "ids", vocabulary_of(documents), ["doc_id"], shared=False)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + i)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), total.alias("id_sum"))


# A tokenizer made of Spark expressions: an id per word, and another count than the token pattern's.
def word_ids(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\s<|>]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


WORD_IDS_SQL = """
list_transform(list_filter(string_split_regex(text, '[\\s<|>]+'), lambda w: w <> ''),
               lambda w: CAST(('0x' || substr(md5(w), 1, 7)) AS INTEGER))"""

OWN_SHORT = 70


@query(
    "own_ids_filtered",
    f"""
WITH {text_sql(CHATML, "conversations")}, coded AS (SELECT conv_id, {WORD_IDS_SQL} AS ids FROM rendered)
SELECT conv_id, CAST(least(len(ids), 96) AS BIGINT) AS n_ids,
       array_to_string(ids[1:96], ',') AS ids, CAST(least(len(ids), 96) AS BIGINT) AS mask_sum
FROM coded WHERE least(len(ids), 96) >= {OWN_SHORT}""",
)
def _(spark, sf_dir):
    options = replace(
        PRESETS["w8a8_messages"], max_length=96, least_tokens=OWN_SHORT, on_error="skip", tokenizer=word_ids
    )
    rows = assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3)
    return encoded(calibration_ids(rows, options))


# A tokenizer of the caller's in Python, whose tokens run over the borders of turns: up to four
# letters and blanks, or one other character.
ACROSS_PATTERN = r"[A-Za-z ]{1,4}|[^A-Za-z ]"
ACROSS_SQL = f"""
WITH rendered AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
coded AS (
  SELECT conv_id, list_transform(regexp_extract_all(text, '{ACROSS_PATTERN}'),
                                 lambda w: CAST(('0x' || substr(md5(w), 1, 7)) AS INTEGER)) AS ids FROM rendered)
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ',') AS ids,
       CAST(len(ids) AS BIGINT) AS mask_sum FROM coded"""
BARE = Layout("", "", "", "", "", writes_role=False)


def across_ends() -> Callable[[Column], Column]:
    """Ids of the tokens, and where they end."""
    pattern = ACROSS_PATTERN

    def spans(texts: pa.Array) -> pa.Array:
        # numbers only: an object per token would take a hundred times the text
        ids, ends, firsts, find, known = array("i"), array("i"), array("i", [0]), re.compile(pattern).findall, {}
        for text in texts:
            tokens = find(text.as_py() or "")
            for token in tokens:
                if token not in known:
                    known[token] = int(hashlib.md5(token.encode()).hexdigest()[:7], 16)
            ids.extend(map(known.__getitem__, tokens))
            # every character is in a token
            ends.extend(accumulate(map(len, tokens)))
            firsts.append(len(ids))
        values = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (ids, ends)], names=["id", "end"])
        return pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), values, mask=texts.is_null())

    return F.arrow_udf(spans, "array<struct<id:int,end:int>>")


def across_ids(rows: DataFrame, with_ends: bool) -> DataFrame:
    ends = across_ends()
    options = Calibration(
        mode="as_is",
        layout=BARE,
        max_length=None,
        tokenizer=lambda text: F.transform(ends(text), lambda s: s["id"]),
        token_ends=ends if with_ends else None,
    )
    return encoded(calibration_ids(rows, options))


@query("own_ids_across_borders", ACROSS_SQL)
def _(spark, sf_dir):
    # parts of three turns: the tokenizer sees each with what is around it
    return across_ids(assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3), True)


@query("own_ids_of_whole_texts", ACROSS_SQL)
def _(spark, sf_dir):
    return across_ids(assemble(table(spark, sf_dir, "conversations"), "chat", part_turns=3), False)


@query(
    "tokenizer_errors_skipped",
    f"""
WITH {text_sql(CHATML, "conversations")}
SELECT CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS reason, count(*) AS n
FROM rendered GROUP BY 1""",
)
def _(spark, sf_dir):
    def fails_on_some(texts: list[str]) -> list[list[int]]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("a length that this tokenizer does not take")
        return [[len(t)] for t in texts]

    tokenizer = batch_tokenizer(fails_on_some, isolate=True)
    options = Calibration(mode="as_is", layout=CHATML, on_error="skip", tokenizer=tokenizer)
    rows = assemble(table(spark, sf_dir, "conversations"), "chat")
    return account(conversation_facts(rows, options))


# --- accounting and calibration sets -----------------------------------------------------------

# No conversation of the tables has fewer than ten tokens, so a higher limit is tested.
SHORT = 60
TOLERANT = Calibration(least_turns=2, least_tokens=SHORT, on_error="skip")

FACTS_SQL = f"""
{MIXED_SQL}, {mixed_text_sql(ROLE_HEADERS)},
counted AS (
  SELECT conv_id, text, n_turns, len({TOKENS_SQL}) AS n_tokens, digest
  FROM rendered
  JOIN (SELECT conv_id, count(*) FILTER (WHERE known) AS n_turns, {DIGEST_SQL} AS digest
        FROM judged GROUP BY conv_id) USING (conv_id)),
facts AS (
  SELECT *, CASE WHEN conv_id % 29 = 5 THEN 'missing' WHEN conv_id % 41 = 9 THEN 'error'
                 WHEN n_turns < 2 THEN 'few_turns'
                 WHEN least(n_tokens, 2048) < {SHORT} THEN 'short' ELSE 'ok' END AS reason
  FROM counted)"""


@query("skip_account", f"WITH {FACTS_SQL} SELECT reason, count(*) AS n FROM facts GROUP BY reason")
def _(spark, sf_dir):
    rows = mixed_rows(spark, sf_dir, broken=True)
    return account(conversation_facts(rows, TOLERANT, raw="raw"))


def calibration_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, fetch, assemble, convert, render, tokenize, cut, filter."""
    turns = table(spark, sf_dir, "conversations")
    options = replace(TOLERANT, n=sampled_n(spark, sf_dir))
    rows = broken_arrays(take_sample(turns, options, element=mixed_turn(), on_short="truncate"))
    facts = conversation_facts(rows, TOLERANT, raw="raw").filter(F.col("reason") == "ok")
    return facts.select(
        "conv_id",
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.least(F.col("n_tokens"), F.lit(TOLERANT.max_length)).cast("bigint").alias("n_tokens"),
        "digest",
    )


_SAMPLED_FACTS_SQL = f"""
WITH {FACTS_SQL}, sampled AS (SELECT * FROM facts ORDER BY {SHUFFLE_SQL}, conv_id LIMIT {SAMPLED})"""
query(
    "calibration_set",
    f"""{_SAMPLED_FACTS_SQL}
SELECT conv_id, n_turns, CAST(least(n_tokens, 2048) AS BIGINT) AS n_tokens, digest FROM sampled
WHERE reason = 'ok'""",
)(calibration_set)


GPTQ_TEXTS_SQL = f"""{_SAMPLED_FACTS_SQL}
SELECT conv_id, CAST(0 AS BIGINT) AS part, text FROM sampled WHERE reason = 'ok'"""


def gptq_texts(spark: SparkSession, sf_dir: str, part_turns: int = PART_TURNS) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    options = replace(TOLERANT, n=sampled_n(spark, sf_dir))
    rows = take_sample(turns, options, element=mixed_turn(), on_short="truncate", part_turns=part_turns)
    return calibration_texts(broken_arrays(rows), TOLERANT, raw="raw")


@query("gptq_texts", GPTQ_TEXTS_SQL)
def _(spark, sf_dir):
    return gptq_texts(spark, sf_dir)


@query("gptq_texts_in_parts", GPTQ_TEXTS_SQL)
def _(spark, sf_dir):
    return gptq_texts(spark, sf_dir, part_turns=3)


@query("gptq_texts_from_arrays", GPTQ_TEXTS_SQL)
def _(spark, sf_dir):
    # the usual input: one row per conversation, so nothing is gathered or joined back
    path = scratch_path(spark, "arrays")
    mixed_rows(spark, sf_dir, broken=True).drop("part", "start").write.parquet(path)
    options = replace(TOLERANT, n=sampled_n(spark, sf_dir))
    rows = take_sample(read_conversations(spark, path), options, on_short="truncate")
    return calibration_texts(rows, TOLERANT, raw="raw")


@query(
    "gptq_text_preset",
    f"""
WITH {MIXED_SQL}, {mixed_text_sql(ROLE_HEADERS)},
counted AS (
  SELECT conv_id, text, count(*) FILTER (WHERE known) AS n_turns
  FROM rendered JOIN judged USING (conv_id) GROUP BY 1, 2),
sampled AS (SELECT * FROM counted ORDER BY {SHUFFLE_SQL}, conv_id LIMIT {PRESETS["gptq_text"].n})
SELECT conv_id, CAST(0 AS BIGINT) AS part, text FROM sampled
WHERE n_turns >= 2 AND len({TOKENS_SQL}) + 1 >= 10""",
)
def _(spark, sf_dir):
    options = PRESETS["gptq_text"]
    turns = table(spark, sf_dir, "conversations")
    rows = take_sample(turns, options, element=mixed_turn(), on_short="truncate")
    return calibration_texts(rows, options)


@query(
    "strict_skips_errors",
    f"""
WITH {MIXED_SQL},
whole AS (
  SELECT conv_id, bool_and(f IS NOT NULL AND v IS NOT NULL AND f IN ('system', 'human', 'gpt')) AS fine
  FROM mixed GROUP BY conv_id)
SELECT CASE WHEN fine THEN 'ok' ELSE 'error' END AS reason, count(*) AS n FROM whole GROUP BY 1""",
)
def _(spark, sf_dir):
    options = Calibration(mode="strict", on_error="skip")
    return account(conversation_facts(mixed_rows(spark, sf_dir), options))


@query(
    "require_rows",
    f"""
WITH {FACTS_SQL} SELECT conv_id, reason FROM facts WHERE reason = 'ok'""",
)
def _(spark, sf_dir):
    rows = mixed_rows(spark, sf_dir, broken=True)
    facts = conversation_facts(rows, TOLERANT, raw="raw").select("conv_id", "reason")
    return require_rows(facts.filter(F.col("reason") == "ok"))


def preset_sql(source: str, n: int | str, cut: int | None) -> str:
    kept = f"WHERE pos <= {cut}" if cut else ""
    return f"""
WITH {source}, {ENCODED_SQL},
sampled AS (SELECT conv_id FROM rendered ORDER BY {SHUFFLE_SQL}, conv_id LIMIT {n})
SELECT conv_id, count(*) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids,
       count(*) AS mask_sum
FROM placed JOIN vocabulary USING (token) JOIN sampled USING (conv_id) {kept} GROUP BY conv_id"""


def preset_ids(
    turns: DataFrame, options: Calibration, shape: str = "sharegpt", element: Column | None = None
) -> DataFrame:
    every = calibration_texts(assemble(turns, shape, element=element), options)
    rows = take_sample(turns, options, shape=shape, element=element, on_short="truncate")
    return encoded(calibration_ids(rows, options, vocabulary_of(every)))


@query("w8a8_messages", preset_sql(text_sql(CHATML, "conversations"), PRESETS["w8a8_messages"].n, 2048))
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return preset_ids(turns, PRESETS["w8a8_messages"], "chat")


@query("gptq_ids_sampled", preset_sql(text_sql(CHATML, "conversations"), PRESETS["gptq_ids"].n, None))
def _(spark, sf_dir):
    return preset_ids(sharegpt_turns(spark, sf_dir), PRESETS["gptq_ids"])


@query("w8a8_sharegpt", preset_sql(text_sql(CHATML, "conversations"), PRESETS["w8a8_sharegpt"].n, 2048))
def _(spark, sf_dir):
    return preset_ids(sharegpt_turns(spark, sf_dir), PRESETS["w8a8_sharegpt"])


@query(
    "w8a8_mixed",
    preset_sql(f"{MIXED_SQL}, {mixed_text_sql(ROLE_HEADERS)}", PRESETS["w8a8_mixed"].n, 2048),
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return preset_ids(turns, PRESETS["w8a8_mixed"], element=mixed_turn())


@query(
    "calibration_written",
    preset_sql(text_sql(CHATML, "conversations"), SAMPLED, 64),
)
def _(spark, sf_dir):
    path = scratch_path(spark, "calibration")
    options = replace(PRESETS["w8a8_messages"], n=sampled_n(spark, sf_dir), max_length=64)
    turns = table(spark, sf_dir, "conversations")
    every = calibration_texts(assemble(turns, "chat"), options)
    rows = take_sample(turns, options, shape="chat", on_short="truncate")
    write_calibration(calibration_ids(rows, options, vocabulary_of(every)), path)
    return encoded(spark.read.parquet(path))


@query(
    "pad_fallback",
    """
SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN NULL ELSE '<pad:' || lang || '>' END,
                        '<end:' || source || '>') AS pad FROM documents""",
)
def _(spark, sf_dir):
    pad = F.when(F.col("lang") != "en", F.concat(F.lit("<pad:"), "lang", F.lit(">")))
    eos = F.concat(F.lit("<end:"), "source", F.lit(">"))
    return table(spark, sf_dir, "documents").select("doc_id", pad_fallback(pad, eos).alias("pad"))


# --- names, targets, placement -----------------------------------------------------------------


@query("name_contains", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org')")
def _(spark, sf_dir):
    return name_contains(table(spark, sf_dir, "pages"), "url", "Example.ORG").select("page_id", "url")


@query(
    "select_targets",
    """
SELECT p_partkey, p_type, p_name FROM part
WHERE p_type IN ('LARGE', 'PROMO') AND p_name NOT IN ('small ring', 'red widget')""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    chosen = select_targets(
        part, "p_type", "p_name", ["LARGE", "PROMO"], ["small ring", "red widget"]
    )
    return chosen.select("p_partkey", "p_type", "p_name")


@query(
    "select_targets_by_table",
    """
SELECT p_partkey, p_type, p_name FROM part
WHERE p_type = 'SMALL' AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50)""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ignored = part.filter(F.col("p_size") == 50).select("p_name").distinct()
    chosen = select_targets(part, "p_type", "p_name", "SMALL", ignored)
    return chosen.select("p_partkey", "p_type", "p_name")


def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    device = (
        F.when(F.col("p_brand") == "Brand#3", "cpu")
        .when(F.col("p_brand") == "Brand#7", "disk")
        .otherwise(F.pmod("p_size", F.lit(12)).cast("string"))
    )
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), device.alias("device"))


PLACEMENT_SQL = """
placement AS (
  SELECT p_name AS name, CASE p_brand WHEN 'Brand#3' THEN 'cpu' WHEN 'Brand#7' THEN 'disk'
                              ELSE CAST(p_size % 12 AS VARCHAR) END AS device FROM part)"""


@query(
    "frequency_mixed",
    f"WITH {PLACEMENT_SQL} SELECT device, count(*) AS n FROM placement GROUP BY device",
)
def _(spark, sf_dir):
    return frequency(placement(spark, sf_dir), "device")


@query(
    "any_in",
    f"WITH {PLACEMENT_SQL} SELECT coalesce(bool_or(device IN ('cpu', 'disk')), false) AS found FROM placement",
)
def _(spark, sf_dir):
    return any_in(placement(spark, sf_dir), "device", ["cpu", "disk"])


@query(
    "artifact_name",
    """
SELECT p_partkey, split_part(p_brand || '/' || p_name, '/', 2) || '-W8A8' AS artifact FROM part""",
)
def _(spark, sf_dir):
    model_id = F.concat("p_brand", F.lit("/"), "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", artifact_name(model_id, "-W8A8").alias("artifact")
    )


# --- vectors -------------------------------------------------------------------------------------

VALUES_SQL = """
vals AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
stats AS (
  SELECT pos, max(abs(x)) AS abs_max, avg(x) AS mean, avg(x * x) AS mean_sq, count(x) AS n
  FROM vals GROUP BY pos)"""


def int_code_sql(x: str, scale: str, qmax: int) -> str:
    return (
        f"CASE WHEN {scale} = 0 THEN 0 ELSE greatest(least(round_even({x} / {scale}, 0), {qmax}),"
        f" -{qmax}) END"
    )


def grouped_sql(bits: int, size: int | None, position: str = "pos") -> str:
    """``coded(vec_id, pos, x, grp, scale, code)`` of group-wise integers."""
    qmax = 2 ** (bits - 1) - 1
    group = f"{position} // {size}" if size else "0"
    return f"""
grouped AS (
  SELECT *, {group} AS grp, max(abs(x)) OVER (PARTITION BY vec_id, {group}) / {qmax} AS scale
  FROM vals),
coded AS (
  SELECT vec_id, pos, x, grp, scale, CAST({int_code_sql("x", "scale", qmax)} AS INTEGER) AS code
  FROM grouped)"""


CODES_SQL = """
SELECT vec_id, codes, scales FROM
  (SELECT vec_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes FROM coded GROUP BY vec_id)
  JOIN (SELECT vec_id, string_agg(CAST(CAST(round(scale * 1000000000) AS BIGINT) AS VARCHAR), ',' ORDER BY grp) AS scales
        FROM (SELECT DISTINCT vec_id, grp, scale FROM coded) GROUP BY vec_id) USING (vec_id)"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def rounded_scales(scales: str | Column) -> Column:
    scales = F.col(scales) if isinstance(scales, str) else scales
    return F.transform(scales, lambda s: F.round(s * 1000000000).cast("bigint"))


def code_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "vec_id", joined("codes").alias("codes"), joined(rounded_scales("scales")).alias("scales")
    )


@query(
    "channel_stats",
    f"""
WITH {VALUES_SQL}
SELECT CAST(pos AS INTEGER) AS pos, abs_max, round(mean, 9) AS mean, round(mean_sq, 9) AS mean_sq, n,
       0 AS n_other
FROM stats""",
)
def _(spark, sf_dir):
    stats = channel_stats(embeddings(spark, sf_dir), "embedding")
    return stats.withColumn("mean", F.round("mean", 9)).withColumn("mean_sq", F.round("mean_sq", 9))


@query(
    "channel_stats_merged",
    f"""
WITH {VALUES_SQL}
SELECT CAST(pos AS INTEGER) AS pos, abs_max, round(mean, 9) AS mean, round(mean_sq, 9) AS mean_sq, n,
       0 AS n_other
FROM stats""",
)
def _(spark, sf_dir):
    # one state per folder of input, kept beside it; the whole is made of the states alone
    path = scratch_path(spark, "states")
    vectors = embeddings(spark, sf_dir)
    for label in range(0, 10, 5):
        some = vectors.filter(F.col("label").between(label, label + 4))
        channel_state(some, "embedding").write.parquet(f"{path}/folder={label}")
    merged = stats_of(merge_states(spark.read.parquet(path)))
    return merged.withColumns({c: F.round(c, 9) for c in ("mean", "mean_sq")})


@query(
    "importance",
    f"""
WITH {VALUES_SQL}
SELECT CAST(pos AS INTEGER) AS pos,
       CAST(row_number() OVER (ORDER BY mean_sq DESC, pos) - 1 AS INTEGER) AS rank
FROM stats""",
)
def _(spark, sf_dir):
    return importance(channel_stats(embeddings(spark, sf_dir), "embedding"))


@query("int8_row", f"WITH {VALUES_SQL}, {grouped_sql(8, None)} {CODES_SQL}")
def _(spark, sf_dir):
    return code_rows(int_codes(embeddings(spark, sf_dir), "embedding", 8))


@query("int4_group32", f"WITH {VALUES_SQL}, {grouped_sql(4, 32)} {CODES_SQL}")
def _(spark, sf_dir):
    return code_rows(int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 32))


@query("int8_group32", f"WITH {VALUES_SQL}, {grouped_sql(8, 32)} {CODES_SQL}")
def _(spark, sf_dir):
    return code_rows(int_codes(embeddings(spark, sf_dir), "embedding", 8, "group", 32))


@query("int4_group24_short_last", f"WITH {VALUES_SQL}, {grouped_sql(4, 24)} {CODES_SQL}")
def _(spark, sf_dir):
    return code_rows(int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 24))


ORDERED_SQL = f"""
{VALUES_SQL.replace("vals AS", "plain AS").replace("FROM vals", "FROM plain")},
ranks AS (
  SELECT pos, row_number() OVER (ORDER BY mean_sq DESC, pos) - 1 AS rank FROM stats),
vals AS (SELECT * FROM plain JOIN ranks USING (pos))"""


@query("int4_group32_ordered", f"WITH {ORDERED_SQL}, {grouped_sql(4, 32, 'rank')} {CODES_SQL}")
def _(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return code_rows(int_codes(vectors, "embedding", 4, "group", 32, order="importance"))


CHANNEL_SQL = f"""
{VALUES_SQL},
coded AS (
  SELECT vec_id, pos, x, abs_max / 127 AS scale,
         CAST({int_code_sql("x", "(abs_max / 127)", 127)} AS INTEGER) AS code
  FROM vals JOIN stats USING (pos))"""


@query(
    "int8_channel",
    f"""
WITH {CHANNEL_SQL}
SELECT vec_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes FROM coded GROUP BY vec_id""",
)
def _(spark, sf_dir):
    coded = int_codes(embeddings(spark, sf_dir), "embedding", 8, "channel")
    return coded.select("vec_id", joined("codes").alias("codes"))


def fp8_sql(y: str) -> str:
    step = f"pow(2.0, greatest(floor(log2(abs({y}))), -6) - 3)"
    return (
        f"CASE WHEN {y} = 0 THEN 0.0 ELSE sign({y}) * least(round_even(abs({y}) / {step}, 0) * {step}, 448.0) END"
    )


FP8_ROWS_SQL = f"""
SELECT vec_id, string_agg(CAST(CAST(code * 512 AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS codes
FROM (SELECT vec_id, pos, {fp8_sql("y")} AS code FROM scaled) GROUP BY vec_id"""


# E4M3 values are multiples of 1/512, so that 512 times the value is a whole number.
def fp8_rows(df: DataFrame) -> DataFrame:
    whole = F.transform("codes", lambda c: (c * 512).cast("bigint"))
    return df.select("vec_id", joined(whole).alias("codes"))


@query(
    "fp8_row",
    f"""
WITH {VALUES_SQL},
scaled AS (SELECT vec_id, pos, x / (max(abs(x)) OVER (PARTITION BY vec_id) / 448.0) AS y FROM vals)
{FP8_ROWS_SQL}""",
)
def _(spark, sf_dir):
    return fp8_rows(fp8_codes(embeddings(spark, sf_dir), "embedding"))


@query(
    "fp8_channel",
    f"""
WITH {VALUES_SQL},
scaled AS (SELECT vec_id, pos, x / (abs_max / 448.0) AS y FROM vals JOIN stats USING (pos))
{FP8_ROWS_SQL}""",
)
def _(spark, sf_dir):
    return fp8_rows(fp8_codes(embeddings(spark, sf_dir), "embedding", "channel"))


@query(
    "recon_error_fp8",
    f"""
WITH {VALUES_SQL},
scaled AS (
  SELECT x, abs_max / 448.0 AS scale, x / (abs_max / 448.0) AS y FROM vals JOIN stats USING (pos)),
coded AS (SELECT x, scale, {fp8_sql("y")} AS code FROM scaled)
SELECT round(avg((x - code * scale) * (x - code * scale)) * 1000000, 6) AS mse FROM coded""",
)
def _(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    stats = channel_stats(vectors, "embedding")
    coded = fp8_codes(vectors, "embedding", "channel", stats)
    return micro(recon_error(dequantize(coded, scales=channel_scales(stats, FP8_MAX)), "embedding"))


@query(
    "dequantize",
    f"""
WITH {VALUES_SQL}, {grouped_sql(4, 32)}
SELECT vec_id, string_agg(CAST(CAST(round(code * scale * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos)
  AS decoded FROM coded GROUP BY vec_id""",
)
def _(spark, sf_dir):
    coded = int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 32)
    decoded = dequantize(coded, group_size=32)
    whole = F.transform("decoded", lambda v: F.round(v * 1000000).cast("bigint"))
    return decoded.select("vec_id", joined(whole).alias("decoded"))


ERROR = "(x - code * scale) * (x - code * scale)"


@query(
    "recon_error",
    f"""
WITH {VALUES_SQL}, {grouped_sql(4, 32)}
SELECT round(avg({ERROR}) * 1000000, 6) AS mse FROM coded""",
)
def _(spark, sf_dir):
    coded = int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 32)
    return micro(recon_error(dequantize(coded, group_size=32), "embedding"))


def micro(errors: DataFrame) -> DataFrame:
    return errors.withColumn("mse", F.round(F.col("mse") * 1000000, 6))


@query(
    "recon_error_by_row",
    f"""
WITH {VALUES_SQL}, {grouped_sql(8, None)}
SELECT vec_id, round(avg({ERROR}) * 1000000, 6) AS mse FROM coded GROUP BY vec_id""",
)
def _(spark, sf_dir):
    decoded = dequantize(int_codes(embeddings(spark, sf_dir), "embedding", 8))
    return micro(recon_error(decoded, "embedding", by="row", key="vec_id"))


@query(
    "recon_error_by_group",
    f"""
WITH {VALUES_SQL}, {grouped_sql(4, 16)}
SELECT CAST(grp AS INTEGER) AS grp, round(avg({ERROR}) * 1000000, 6) AS mse FROM coded GROUP BY grp""",
)
def _(spark, sf_dir):
    coded = int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 16)
    decoded = dequantize(coded, group_size=16)
    return micro(recon_error(decoded, "embedding", by="group", group_size=16))


@query(
    "recon_error_weighted",
    f"""
WITH {ORDERED_SQL}, {grouped_sql(4, 32, 'rank')}
SELECT round(sum({ERROR} * mean_sq) / sum(mean_sq) * 1000000, 6) AS mse
FROM coded JOIN stats USING (pos)""",
)
def _(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    stats = channel_stats(vectors, "embedding")
    coded = int_codes(vectors, "embedding", 4, "group", 32, order="importance", stats=stats)
    decoded = dequantize(coded, group_size=32, ranks=importance(stats))
    return micro(recon_error(decoded, "embedding", weights=stats))


@query(
    "recon_error_channel",
    f"WITH {CHANNEL_SQL} SELECT round(avg({ERROR}) * 1000000, 6) AS mse FROM coded",
)
def _(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    stats = channel_stats(vectors, "embedding")
    coded = int_codes(vectors, "embedding", 8, "channel", stats=stats)
    return micro(recon_error(dequantize(coded, scales=channel_scales(stats, 127)), "embedding"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, the second table of smoothing."""
    means = (
        embeddings(spark, sf_dir)
        .select("label", F.posexplode("embedding").alias("pos", "value"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
    )
    placed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return means.groupBy("label").agg(placed["value"].alias("mean_vector"))


SMOOTH_SQL = f"""
{VALUES_SQL},
means AS (SELECT label, pos, avg(x) AS m FROM vals GROUP BY label, pos),
factors AS (
  SELECT pos, CASE WHEN abs_max > 0 AND w_max > 0
                   THEN pow(abs_max, 0.8::DOUBLE) / pow(w_max, (1.0::DOUBLE - 0.8::DOUBLE)) ELSE 1.0 END AS s
  FROM stats JOIN (SELECT pos, max(abs(m)) AS w_max FROM means GROUP BY pos) USING (pos))"""


@query(
    "smooth_scales",
    f"WITH {SMOOTH_SQL} SELECT CAST(pos AS INTEGER) AS pos, round(s, 9) AS s FROM factors",
)
def _(spark, sf_dir):
    x = channel_stats(embeddings(spark, sf_dir), "embedding")
    w = channel_stats(label_means(spark, sf_dir), "mean_vector")
    return smooth_scales(x, w).withColumn("s", F.round("s", 9))


@query(
    "smooth_weights",
    f"""
WITH {SMOOTH_SQL}
SELECT label, string_agg(CAST(CAST(round(m * s * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS w
FROM means JOIN factors USING (pos) GROUP BY label""",
)
def _(spark, sf_dir):
    w = smooth(embeddings(spark, sf_dir), label_means(spark, sf_dir), "embedding", "mean_vector")[1]
    whole = F.transform("mean_vector", lambda v: F.round(v * 1000000).cast("bigint"))
    return w.select("label", joined(whole).alias("w"))


@query(
    "smooth_then_int8",
    f"""
WITH {SMOOTH_SQL.replace("vals AS", "plain AS").replace("FROM vals", "FROM plain")},
vals AS (SELECT vec_id, pos, x / s AS x FROM plain JOIN factors USING (pos)),
{grouped_sql(8, None)} {CODES_SQL}""",
)
def _(spark, sf_dir):
    weights = label_means(spark, sf_dir)
    steps = [Smooth(weights, "embedding", "mean_vector"), IntCodes("embedding")]
    return code_rows(run_recipe(embeddings(spark, sf_dir), steps))


@query(
    "smooth_then_both",
    f"""
WITH {SMOOTH_SQL.replace("vals AS", "plain AS").replace("FROM vals", "FROM plain")},
sides AS (
  SELECT 'x' AS side, vec_id AS id, pos, x / s AS x FROM plain JOIN factors USING (pos)
  UNION ALL SELECT 'w', label, pos, m * s FROM means JOIN factors USING (pos)),
spread AS (SELECT side, pos, max(abs(x)) / 127 AS channel FROM sides GROUP BY side, pos),
scaled AS (
  SELECT side, id, pos, x,
         CASE side WHEN 'x' THEN max(abs(x)) OVER (PARTITION BY side, id) / 127 ELSE channel END AS scale
  FROM sides JOIN spread USING (side, pos))
SELECT side, id, string_agg(CAST(CAST({int_code_sql("x", "scale", 127)} AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS codes
FROM scaled GROUP BY side, id""",
)
def _(spark, sf_dir):
    smoothing = Smooth(label_means(spark, sf_dir), "embedding", "mean_vector")
    vectors = embeddings(spark, sf_dir)
    rows, weights = run_recipe_on_both(
        vectors, smoothing, [IntCodes("embedding")], [IntCodes("mean_vector", per="channel")]
    )
    return rows.select(F.lit("x").alias("side"), F.col("vec_id").alias("id"), joined("codes").alias("codes")).union(
        weights.select(F.lit("w"), F.col("label").cast("bigint"), joined("codes"))
    )


# Every seventh vector has a NaN, every eleventh an infinite value, every thirteenth is empty, and
# dimension 3 is zero throughout; all are 1e-7 of what they were.
def odd_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")

    def value(x: Column, pos: Column) -> Column:
        small = x.cast("double") * 1e-7
        return (
            F.when(pos == 3, F.lit(0.0))
            .when((F.pmod(vec_id, F.lit(7)) == 0) & (pos == 5), F.lit(float("nan")))
            .when((F.pmod(vec_id, F.lit(11)) == 0) & (pos == 6), F.lit(float("-inf")))
            .otherwise(small)
        )

    values = F.transform("embedding", value)
    empty = F.array().cast("array<double>")
    return embeddings(spark, sf_dir).withColumn(
        "embedding", F.when(F.pmod(vec_id, F.lit(13)) == 1, empty).otherwise(values)
    )


ODD_SQL = """
plain AS (
  SELECT vec_id, unnest(embedding)::DOUBLE * 1e-7::DOUBLE AS small, generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings WHERE vec_id % 13 <> 1),
odd AS (
  SELECT vec_id, pos, CASE WHEN pos = 3 THEN 0 ELSE small END AS x,
         NOT ((vec_id % 7 = 0 AND pos = 5 AND pos <> 3) OR (vec_id % 11 = 0 AND pos = 6)) AS fine
  FROM plain),
stats AS (
  SELECT pos, max(abs(x)) FILTER (WHERE fine) AS abs_max, avg(x * x) FILTER (WHERE fine) AS mean_sq,
         count(*) FILTER (WHERE fine) AS n, count(*) FILTER (WHERE NOT fine) AS n_other
  FROM odd GROUP BY pos)"""


@query(
    "importance_of_odd_vectors",
    f"""
WITH {ODD_SQL}
SELECT CAST(pos AS INTEGER) AS pos, n, n_other,
       CAST(row_number() OVER (ORDER BY mean_sq DESC, pos) - 1 AS INTEGER) AS rank
FROM stats""",
)
def _(spark, sf_dir):
    stats = channel_stats(odd_vectors(spark, sf_dir), "embedding")
    return importance(stats).join(stats.select("pos", "n", "n_other"), "pos")


@query(
    "int8_row_of_odd_vectors",
    f"""
WITH {ODD_SQL},
sound AS (SELECT vec_id FROM odd GROUP BY vec_id HAVING bool_and(fine)),
scaled AS (
  SELECT vec_id, pos, x, max(abs(x)) OVER (PARTITION BY vec_id) / 127 AS scale
  FROM odd JOIN sound USING (vec_id)),
coded AS (
  SELECT vec_id, string_agg(CAST(CAST({int_code_sql("x", "scale", 127)} AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS codes
  FROM scaled GROUP BY vec_id)
SELECT vec_id, CASE WHEN vec_id % 13 = 1 THEN '' ELSE codes END AS codes
FROM embeddings LEFT JOIN coded USING (vec_id)""",
)
def _(spark, sf_dir):
    coded = int_codes(odd_vectors(spark, sf_dir), "embedding", 8)
    return coded.select("vec_id", joined("codes").alias("codes"))


@query(
    "second_moment",
    f"""
WITH {VALUES_SQL},
cells AS (
  SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS h
  FROM vals a JOIN vals b USING (vec_id) GROUP BY a.pos, b.pos)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(h + CASE WHEN i = j THEN 0.01 * (SELECT avg(h) FROM cells WHERE i = j) ELSE 0 END, 8) AS h
FROM cells""",
)
def _(spark, sf_dir):
    cells = second_moment(embeddings(spark, sf_dir), "embedding", damp=0.01)
    return cells.withColumn("h", F.round("h", 8))


@query(
    "codes_written",
    f"""
WITH {VALUES_SQL}, {grouped_sql(8, 32)}
SELECT *, (SELECT CAST(count(*) AS BIGINT) FROM vals) AS n_values FROM ({CODES_SQL})""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "codes")
    vectors = embeddings(spark, sf_dir)
    stats = channel_stats(vectors, "embedding")
    coded = int_codes(vectors, "embedding", 8, "group", 32)
    write_codes(coded, path, "embedding", {"stats": stats})
    rows = code_rows(spark.read.parquet(f"{path}/rows"))
    # the shared table is read back too: its dimensions and the values in them
    shared = spark.read.parquet(f"{path}/stats").agg(F.sum("n").alias("n_values")).scalar()
    return rows.withColumn("n_values", shared)


def packed_codes(coded: DataFrame, packing: str) -> DataFrame:
    """Written packed and read back, with the bytes that the codes take."""
    path = scratch_path(coded.sparkSession, "packed")
    write_codes(coded, path, "embedding", packing=packing)
    sizes = coded.sparkSession.read.parquet(f"{path}/rows").select(
        "vec_id", F.length(f"codes_{packing}").cast("bigint").alias("n_bytes")
    )
    return read_codes(coded.sparkSession, path).join(sizes, "vec_id")


@query(
    "codes_packed_int4",
    f"""
WITH {VALUES_SQL}, {grouped_sql(4, 32)}
SELECT *, CAST(32 AS BIGINT) AS n_bytes FROM ({CODES_SQL})""",
)
def _(spark, sf_dir):
    rows = packed_codes(int_codes(embeddings(spark, sf_dir), "embedding", 4, "group", 32), "int4")
    return code_rows(rows).join(rows.select("vec_id", "n_bytes"), "vec_id")


@query(
    "codes_packed_e4m3",
    f"""
WITH {VALUES_SQL},
scaled AS (SELECT vec_id, pos, x / (max(abs(x)) OVER (PARTITION BY vec_id) / 448.0) AS y FROM vals)
SELECT *, CAST(64 AS BIGINT) AS n_bytes FROM ({FP8_ROWS_SQL})""",
)
def _(spark, sf_dir):
    rows = packed_codes(fp8_codes(embeddings(spark, sf_dir), "embedding"), "e4m3")
    return fp8_rows(rows).join(rows.select("vec_id", "n_bytes"), "vec_id")


@query(
    "sharded_written",
    """
SELECT doc_id, md5(text) AS digest, lang, source, n_chars, true AS bounded, true AS filled FROM documents""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "sharded")
    limit = 1 << 20
    write_sharded(table(spark, sf_dir, "documents"), path, limit)
    found = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    row = F.octet_length("text") + F.octet_length("lang") + F.octet_length("source") + 16
    sizes = found.groupBy("file").agg(
        F.sum(row).alias("bytes"), F.max(row).alias("top"), F.count(F.lit(1)).alias("rows")
    )
    # of the files of small rows, all but the last are full to nine tenths
    small = F.col("top") <= limit // 20
    short = sizes.filter(small & (F.col("bytes") < 0.9 * limit)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.join(sizes, "file").select(
        "doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars",
        ((F.col("bytes") <= limit) | (F.col("rows") == 1)).alias("bounded"), (short <= 1).alias("filled"),
    )


# --- run logs ------------------------------------------------------------------------------------

# The modules of a layer and the passes they share. Line numbers 1 to 7 stand for them,
# orders for layers.
MODULES = (
    "self_attn.k_proj",
    "self_attn.v_proj",
    "self_attn.q_proj",
    "self_attn.o_proj",
    "mlp.up_proj",
    "mlp.gate_proj",
    "mlp.down_proj",
)
MODULE_STAGES = ("kvq", "kvq", "kvq", "o", "up_gate", "up_gate", "down")


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def fixed(number: Column | str, digits: int) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return number.cast(f"decimal(20,{digits})").cast("string")


def write_logs(spark: SparkSession, sf_dir: str, newline: str = "\n", close: str = "}") -> str:
    """The whole of lineitem as run logs, one per return flag and line status."""
    path = scratch_path(spark, "runs")
    line = F.col("l_linenumber")
    modules = F.array(*[F.lit(m) for m in MODULES])
    stages = F.array(*[F.lit(s) for s in MODULE_STAGES])
    forward = F.pmod(F.col("l_orderkey"), F.lit(500)) + F.length(F.get(stages, line - 1)) / 4
    record = F.struct(
        F.lit("gptq").alias("process"),
        F.col("l_orderkey").cast("int").alias("layer"),
        F.get(modules, line - 1).alias("module"),
        fixed("l_extendedprice", 8).alias("loss"),
        F.col("l_quantity").cast("int").cast("string").alias("samples"),
        fixed("l_tax", 5).alias("damp"),
        fixed("l_discount", 3).alias("time"),
        fixed(forward, 3).alias("fwd_time"),
    )
    name = F.concat(
        F.lit("gptq_log_"),
        F.concat("l_returnflag", "l_linestatus"),
        F.lit("_time_02_03_2031_04h_05m_06s.log"),
    )
    value = F.to_json(record, {"pretty": "true"})
    if newline != "\n":
        value = F.replace(value, F.lit("\n"), F.lit(newline))
    if close != "}":
        value = F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.lit(close))
    # a writer per log stays open in each task, so that no task sorts its rows by log
    writers = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "16")
    try:
        table(spark, sf_dir, "lineitem").select(name.alias("log"), value.alias("value")).write.partitionBy("log").text(path)
    finally:
        spark.conf.set(WRITERS, writers)
    return path


_MODULES_SQL = "[" + ", ".join(f"'{m}'" for m in MODULES) + "]"
_STAGES_SQL = "[" + ", ".join(f"'{s}'" for s in MODULE_STAGES) + "]"
LOGS_SQL = f"""
logs AS (
  SELECT l_returnflag || l_linestatus AS run, CAST(l_orderkey AS INTEGER) AS layer,
         {_MODULES_SQL}[l_linenumber] AS module, {_STAGES_SQL}[l_linenumber] AS stage,
         l_extendedprice AS loss, CAST(l_quantity AS INTEGER) AS samples, l_tax AS damp,
         l_discount AS time,
         l_orderkey % 500 + length({_STAGES_SQL}[l_linenumber]) / 4 AS fwd_time
  FROM lineitem)"""


RUN_LOGS_SQL = f"""
WITH {LOGS_SQL}
SELECT run, '2031-02-03 04:05:06' AS started, layer, module, loss, samples, damp, time, fwd_time
FROM logs"""


def run_log_rows(logs: DataFrame) -> DataFrame:
    return logs.select(
        "run", F.col("started").cast("string").alias("started"), "layer", "module", "loss",
        "samples", "damp", "time", "fwd_time",
    )


@query("run_logs", RUN_LOGS_SQL)
def _(spark, sf_dir):
    return run_log_rows(read_run_logs(spark, write_logs(spark, sf_dir)))


@query("run_logs_crlf", RUN_LOGS_SQL)
def _(spark, sf_dir):
    # carriage returns within and behind every record, and blanks behind its brace
    return run_log_rows(read_run_logs(spark, write_logs(spark, sf_dir, "\r\n", "}  \r")))


@query("run_logs_compact", RUN_LOGS_SQL)
def _(spark, sf_dir):
    # objects of one line, three on a line
    return run_log_rows(read_run_logs(spark, write_logs(spark, sf_dir, "", "}")))


@query(
    "run_summary",
    f"""
WITH {LOGS_SQL},
stages AS (
  SELECT run, layer, stage, count(*) AS modules, sum(time) AS time, max(fwd_time) AS fwd_time,
         max(loss) AS max_loss, max(damp) AS max_damp
  FROM logs GROUP BY run, layer, stage)
SELECT run, '2031-02-03 04:05:06' AS started, layer, CAST(sum(modules) AS BIGINT) AS modules, round(sum(time), 6) AS time,
       round(sum(fwd_time), 6) AS fwd_time, max(max_loss) AS max_loss, max(max_damp) AS max_damp
FROM stages GROUP BY run, layer""",
)
def _(spark, sf_dir):
    summary = run_summary(read_run_logs(spark, write_logs(spark, sf_dir)))
    return summary.withColumns(
        {
            "started": F.col("started").cast("string"),
            "time": F.round("time", 6),
            "fwd_time": F.round("fwd_time", 6),
        }
    )


@query(
    "run_compare",
    f"""
WITH {LOGS_SQL},
a AS (SELECT layer, module, max(loss) AS loss, sum(time) AS time FROM logs WHERE run = 'AF' GROUP BY 1, 2),
b AS (SELECT layer, module, max(loss) AS loss, sum(time) AS time FROM logs WHERE run = 'RO' GROUP BY 1, 2)
SELECT layer, module, a.loss AS left_loss, b.loss AS right_loss, round(a.time, 6) AS left_time,
       round(b.time, 6) AS right_time, round(b.loss - a.loss, 6) AS loss_change
FROM a FULL OUTER JOIN b USING (layer, module)""",
)
def _(spark, sf_dir):
    compared = run_compare(read_run_logs(spark, write_logs(spark, sf_dir)), "AF", "RO")
    for name in ("left_time", "right_time", "loss_change"):
        compared = compared.withColumn(name, F.round(name, 6))
    return compared


@query(
    "stage_log",
    """
SELECT strftime(ts, '%Y-%m-%d') || ' 00:00:00' AS started, event_type AS stage, count(*) AS n
FROM events GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "stages")
    (
        table(spark, sf_dir, "events")
        .select(
            F.date_format("ts", "dd-MM-yyyy_'00.00.00.log'").alias("log"),
            F.concat(F.lit("manager stage: "), "event_type").alias("value"),
        )
        .repartition("log", F.pmod(F.hash("value"), F.lit(4)))
        .write.partitionBy("log")
        .text(path)
    )
    stages = read_stage_logs(spark, path)
    return stages.groupBy(F.col("started").cast("string").alias("started"), "stage").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- contract ------------------------------------------------------------------------------------

try:
    from calibrel.llm import queries as _llm
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith("calibrel.llm"):
        raise
    _llm = None

try:
    import corpus_pipeline as _pipeline
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not (missing.name or "").startswith("calibrel.llm"):
        raise
    _pipeline = None


def entry(spark: SparkSession) -> DataFrame:
    """The flagship query on the smallest tables."""
    return calibration_set(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    own = {**(_llm.QUERIES if _llm else {}), **({"pipeline": _pipeline.run} if _pipeline else {})}
    return {**_QUERIES, **own}


def oracle_sql() -> dict[str, str]:
    own = dict(_llm.SQL) if _llm else {}
    if _pipeline and _pipeline.ORACLE_SQL:
        own["pipeline"] = _pipeline.ORACLE_SQL
    return {**_SQL, **own}
