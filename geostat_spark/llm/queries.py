"""The corpus operators as named queries, with SQL where it can express them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from geostat_spark.llm.bpe import token_digests
from geostat_spark.llm.conversation_repair import repair_conversations
from geostat_spark.llm.exact_dedup import exact_dedup
from geostat_spark.llm.language_id import identify_language
from geostat_spark.llm.mixing import mix_sources
from geostat_spark.llm.ngram_lm import score_documents
from geostat_spark.llm.periodic_runs import periodic_runs
from geostat_spark.llm.quality_rules import RULES, host_quality
from geostat_spark.llm.sharding import shard_documents
from geostat_spark.llm.simhash import simhash_near_dedup
from geostat_spark.llm.substring_dedup import remove_earlier_passages
from geostat_spark.llm.suffix_dedup import remove_repeats
from geostat_spark.llm.text import LOWER, UPPER, hash_part
from geostat_spark.llm.warc import read_warc, write_warc
from geostat_spark.session import new_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(_documents(spark, sf_dir), shingle=4, max_bits=4)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(hash_part(F.col("doc_id"), 3) == 1, F.lit(False))
    found = identify_language(_documents(spark, sf_dir).select("doc_id", "text", "lang"), held_out=held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, least_bytes=0)
    number = lambda urn: F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return read_warc(spark, path, with_payload=False).where("fault is null").select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir), shards=8)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir), tokenizer_path())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=400)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir), held_out=hash_part(F.col("doc_id"), 5) == 1)


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier_passages(_documents(spark, sf_dir), length=50)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with the damage that crc32 of ``conv_id:turn`` modulo 20 names: 0 no row,
    1 no text, 2 no sentence ends, 3 the row twice, 4 role user. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return (
        rows.withColumn("harm", harm)
        .where("harm <> 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1))))
        .select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"))
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = repair_conversations(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), empty)


def planted_run(id: int | None, words: np.ndarray) -> np.ndarray:
    """The places of the words that stand in a document whose crc32(doc_id) ends in 0 in decimal: from one place on
    they repeat with one period. Other documents, and null ids, keep their words."""
    at, n = np.arange(len(words)), len(words)
    h = zlib.crc32(str(id).encode()) if id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_documents(spark, sf_dir), prepare=planted_run).drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_simhash_near_dedup, op3_language_id, op4_warc, op5_sharding, op6_bpe, op7_mixing,
        op8_suffix_dedup, op9_lm_scoring, op10_host_quality, op11_substring_dedup, op12_conversation_repair,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

_PIECES = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {at}, 10))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for at in (1, 11, 21, 31)
    for shift in range(35, -1, -5)
)
ORACLES["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
     h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, {_PIECES} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_FAILED = ", ".join(f"sum(({rule})::INT) AS {name}" for name, rule in RULES.items())
_RATES = " OR ".join(
    f"""({name} + s_{name} * m_{name}) / (n_docs + s_{name}) > 0.5""" for name in RULES
)
_PRIOR = ", ".join(
    f"sum({name}) / sum(n_docs) AS m_{name}, sum(n_docs * ({name} / n_docs) * ({name} / n_docs)) / sum(n_docs) AS q_{name}" for name in RULES
)
_STRENGTH = ", ".join(
    f"m_{n}, CASE WHEN q_{n} - m_{n} * m_{n} > 1e-12 THEN greatest(10.0, m_{n} * (1 - m_{n}) / (q_{n} - m_{n} * m_{n}) - 1) ELSE 10.0 END AS s_{n}"
    for n in RULES
)
ORACLES["op10_host_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {_WORDS} AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN covered USING (r)),
h AS (SELECT source, count(*)::DOUBLE AS n_docs, {_FAILED} FROM m GROUP BY source),
prior AS (SELECT {_STRENGTH} FROM (SELECT {_PRIOR} FROM h)),
v AS (SELECT source, {_RATES} AS rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""

ORACLES["op11_substring_dedup"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
g AS (SELECT r, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS gram FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
again AS (SELECT r, i FROM g JOIN first USING (gram) WHERE doc_id > least OR (doc_id IS NULL AND least IS NOT NULL)),
marked AS (SELECT p.r, k, word, max(i) OVER (PARTITION BY p.r ORDER BY k) AS last FROM p LEFT JOIN again ON p.r = again.r AND k = i),
c AS (SELECT r, count(*) FILTER (WHERE last >= k - 49) AS n_removed,
             string_agg(word, ' ' ORDER BY k) FILTER (WHERE last IS NULL OR last < k - 49) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (r)
"""

_NOT_BLANK = r"regexp_matches(text, '[^\x20\x09-\x0D]')"
_STATES = ("s0", "s1", "s2", "s3")  # nothing yet, after system, after user, after assistant; null: out of reach


def _best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x : x IS NOT NULL))"


def _step(state: str, cost: str, letter: str, when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"


def _kept_or_given(state: str, initial: str) -> list[str]:
    whole = "fault NOT IN ('blank', 'duplicate')"
    more = "CASE fault WHEN 'truncated' THEN 5 ELSE 0 END"
    kept = [_step(state, more, "K", f"{whole} AND role[1] = '{initial}'")]
    return kept + ([_step(state, f"1 + {more}", "R", whole)] if initial != "s" else [])


# A row is read, then up to two rows are put in: from nothing, system or assistant a user, from user an assistant.
_READ = [
    _step("s0", "2", "D"),
    _best(_step("s1", "2", "D"), *_kept_or_given("s0", "s")),
    _best(_step("s2", "2", "D"), *[w for s in ("s0", "s1", "s3") for w in _kept_or_given(s, "u")]),
    _best(_step("s3", "2", "D"), *_kept_or_given("s2", "a")),
]
_PUT_IN = [
    "s0",
    "s1",
    _best("s2", *[_step(s, "5", "I") for s in ("s0", "s1", "s3")]),
    _best("s3", _step("s2", "5", "I"), *[_step(s, "10", "II") for s in ("s0", "s1")]),
]
_AS = lambda values: ", ".join(f"{v} AS {s}" for v, s in zip(values, _STATES))
_NOTHING = "NULL::STRUCT(c INTEGER, a VARCHAR)"
_WAYS = _best("s0", "s3")

# The repaired rows follow from the letters: kept roles stay, others alternate after what stands before.
ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bits AS (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _ : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
         FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits),
damage AS (
  SELECT h.*, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(k) + 1), lambda i : ascii(k[i])::BIGINT),
                              lambda c, b : xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS harm FROM h, crc_table),
d AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE harm WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM damage WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM d),
f AS (
  SELECT *, CASE WHEN NOT {_NOT_BLANK} THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {_AS(_PUT_IN)}
  FROM (SELECT DISTINCT conv_id, {{'c': 0, 'a': ''}} AS s0, {_NOTHING} AS s1, {_NOTHING} AS s2, {_NOTHING} AS s3 FROM f)
  UNION ALL
  SELECT conv_id, n, {_AS(_PUT_IN)}
  FROM (SELECT w.conv_id, f.n, {_AS(_READ)} FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)),
best AS (SELECT conv_id, arg_max({_WAYS}, n) AS b FROM walk GROUP BY conv_id),
letters AS (SELECT conv_id, b.a AS audit, unnest(range(1, length(b.a) + 1)) AS i FROM best),
lettered AS (
  SELECT conv_id, i, audit[i] AS letter, count(*) FILTER (WHERE audit[i] <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n FROM letters),
placed AS (
  SELECT l.conv_id, i, letter, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY i) AS pos,
         max(CASE WHEN letter = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM lettered l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND letter <> 'I' WHERE letter <> 'D'),
lines AS (
  SELECT conv_id, i, CASE WHEN letter = 'K' THEN role WHEN (pos - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM placed),
repaired AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE n > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
