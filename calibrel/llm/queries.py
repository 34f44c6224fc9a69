"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrel.llm import (
    bpe,
    decontaminate,
    exact,
    license,
    pii,
    quality,
    ranking,
    repair,
    secrets,
    simhash,
    suffix,
    tokenfiles,
    urls,
)
from calibrel.llm.batches import written

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spans_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op1_simhash_dedup")
def _(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query(
    "op2_exact_dedup",
    r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
)
def _(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def multi_tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern of the tokenizer that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_byte_bpe")
def _(spark, sf_dir):
    path, pattern = multi_tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # written in between: a task then runs one of the two workers, not both
    ids = written(bpe.encode(docs, path, pattern).select("doc_id", "ids"), "token-ids")
    # [1,2,3]: the numbers and commas stand between the brackets
    digest = F.sha2(F.btrim(F.to_json("ids"), F.lit("[]")), 256)
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    # the bytes in place of the ids, which then do not travel back
    coded = bpe.decode(told, path, bytes_column="ids")
    return coded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("ids", 256).alias("decoded_sha256"))


@query("op4_quality")
def _(spark, sf_dir):
    judged = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = (F.round(c, 6).alias(c) for c in ("evidence", "prior", "quality"))
    return judged.select("doc_id", *rounded, "kept")


_CANONICAL_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}),
  '(?m)^[^a-z0-9\n]*((copyright )?(\(c\)|©)|copyright:? +[0-9<\[]|copyright\b[^\n]*\b[0-9]{{4}}\b|all rights reserved\.? *\r?$)[^\n]*$',
  ' ', 'g'), 'licen[cs]e', 'license', 'g'),
  'https?://(www\.)?', '', 'g'), '\bv(er(sion)?)?\.? ?([0-9])', 'version \3', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
_PARTS_SQL = r"regexp_split_to_array({0}, '\n[^A-Za-z0-9\n]*\n')"


def _license_sql() -> str:
    values = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license.KNOWN_LICENSES
    )
    parts = f"list_filter(list_transform({_PARTS_SQL.format('text')}, lambda p: {_CANONICAL_SQL.format('p')}), lambda p: p <> '')"
    return f"""
WITH given AS (SELECT * FROM (VALUES {values}) AS v(license, text)),
alone AS (
  SELECT form, min(license) AS license FROM (SELECT license, unnest({parts}) AS form FROM given)
  WHERE len(string_split(form, ' ')) >= {license.LEAST_PARAGRAPH} GROUP BY form HAVING count(DISTINCT license) = 1),
known AS (
  SELECT license, sha256({_CANONICAL_SQL.format("text")}) AS digest FROM given
  UNION SELECT license, sha256(form) FROM alone),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, {parts} AS parts FROM docs),
forms AS (
  SELECT doc_id, 'text' AS unit, {_CANONICAL_SQL.format("text")} AS form FROM docs
  UNION ALL SELECT doc_id, 'text', array_to_string(parts[2:], ' ') FROM split
  WHERE len(parts) > 1 AND regexp_matches(parts[1], '{license.TITLE}')
  UNION ALL SELECT doc_id, 'paragraph', unnest(parts) FROM split
  UNION ALL SELECT doc_id, 'line', {_CANONICAL_SQL.format("line")}
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
digests AS (SELECT doc_id, unit, sha256(form) AS digest FROM forms WHERE form <> '')
SELECT doc_id, license, bool_or(unit = 'text') AS whole_text,
       count(*) FILTER (unit = 'paragraph') AS n_paragraphs, count(*) FILTER (unit = 'line') AS n_lines
FROM digests JOIN known USING (digest) GROUP BY 1, 2"""


@query("op5_license_scan", _license_sql())
def _(spark, sf_dir):
    return license.scan_licenses(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def _(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(count_of(base, k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(spans_text(base, pii.KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans"), pii.KINDS).alias("spans"),
        F.size("discovered").cast("long").alias("n_discovered"),
    )


@query("op8_decontaminate")
def _(spark, sf_dir):
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key")


@query("op9_secret_scan")
def _(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(count_of(base, k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS[:3])),
        F.sha2(spans_text(base, secrets.KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans"), secrets.KINDS).alias("spans"),
        F.size("discovered").cast("long").alias("n_discovered"),
    )


URL_RULES = (
    urls.Rule("net", "/", "block"),
    urls.Rule("example.net", "/en/", "allow"),
    urls.Rule("example.com", "/de/", "block"),
    urls.Rule("org", "/fr/", "allow"),
)


@query(
    "op7_url_filter",
    r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, '.' || host AS dotted,
         CASE WHEN ends_with(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ends_with(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ends_with(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host, 'adult|bets|casino|pills|porn|warez') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
)
def _(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op10_suffix_dedup")
def _(spark, sf_dir):
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    lengths = F.transform("removed", lambda r: r["end"] - r["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Appended to every document by ``op13_token_files``.
END_ID = 2


@query("op13_token_files")
def _(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfiles.stored_ids(table(spark, sf_dir, "documents"), path, END_ID)


@query(
    "op11_ranked_search",
    r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
found AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM found, whole GROUP BY term, docs),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS part
  FROM found JOIN weights USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM wanted JOIN parts USING (term) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50""",
)
def _(spark, sf_dir):
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by a checksum of their place."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    told = turns.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", ""))
    return told.where("k <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


@query("op12_conversation_repair")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    report, repaired = repair.repair(damaged(turns))
    found = report.join(repair.digests(repaired).withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("one"))
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
