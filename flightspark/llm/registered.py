"""The registered queries of this subpackage and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightspark.llm import (chat_format, decontaminate, importance, lexical_search, probminhash, quality_crf, quality_rules, runlength, sentencepieces, substring,
                             token_counts, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = F.col("bits").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "bits",
                       base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


WORD = r"'[^\x20\x09-\x0D]+'"
ORACLES["op4_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, {WORD}) AS words, string_split(text, chr(10)) AS lines FROM d),
tri AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
        FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
hit AS (SELECT k, i FROM tri QUALIFY count(*) OVER (PARTITION BY k, t) > 1),
rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY k),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT k, unnest(lines) AS l FROM w)
       WHERE regexp_matches(l, {WORD}) GROUP BY k),
m AS (SELECT w.k, doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
             length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_lower,
             length(text) - length(replace(text, '!', '')) AS n_exclaim
      FROM w LEFT JOIN rep ON w.k = rep.k LEFT JOIN ln ON w.k = ln.k),
b AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality_rules.RULES))} AS BIGINT) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, bits,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (bits & {quality_rules.mask(quality_rules.POLICIES[quality_rules.DEFAULT_POLICY])}) = 0 AS kept
FROM b"""


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


# DuckDB has SHA-1 in hexadecimal only; base 32 takes five bits a letter from it.
ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
nib AS (SELECT page_id, n, hex, list_transform(string_split(hex, ''), lambda x: instr('0123456789abcdef', x) - 1) AS v FROM h),
dig AS (SELECT page_id, n, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          1 + CAST((((v[(i * 5) // 4 + 1] * 256 + coalesce(v[(i * 5) // 4 + 2], 0) * 16 + coalesce(v[(i * 5) // 4 + 3], 0)) >> (12 - 5 - (i * 5) % 4)) & 31) AS INTEGER), 1)), '') AS b32 FROM nib),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, n) AS top FROM dig)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b32 AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, true AS intact FROM g"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "_cut.n_words", "_cut.n_removed", "_cut.kept_sha256")


ORACLES["op3_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS t
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
later AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY md5(t)) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
                CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END AS k
         FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept"""


@query
def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_runlength_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = runlength.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256")


@query
def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, then after edits that take out lines standing earlier in their document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = token_counts.Tokenizer.load()
    edited = token_counts.follow(token_counts.with_counts(docs, tokenizer), token_counts.line_edits(docs), tokenizer)
    return edited.select("doc_id", token_counts.total("_tree").alias("tokens_before"), token_counts.total("_edited.tree").alias("tokens_after"),
                         "_edited.leaves", F.col("_edited.encoded").alias("leaves_encoded"), "_edited.encoded_bytes")


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
# DuckDB has no CRC-32: the table of 256 remainders comes from its polynomial, a text is folded byte by byte, once a distinct feature.
ORACLES["op11_importance_resampling"] = rf"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab),
t AS (SELECT 'd' AS side, row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT side, k, doc_id, regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
f AS MATERIALIZED (SELECT side, k, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM w),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
bytes AS (SELECT f, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bs FROM hexed),
b AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(bs, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM bytes, crc),
n AS (SELECT bucket, CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT k, count(*) AS n_features, sum(gain) AS total FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY k),
r AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CAST(CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m ON w.k = m.k WHERE side = 'd'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS p, count(*) FILTER (n_words >= 20) OVER () AS able FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND p <= 25 * able // 100 THEN p END AS rank FROM o"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
ORACLES["op12_lexical_search"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {TERM}) AS words FROM documents),
c AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), {TERM})) AS t FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(words) AS n, unnest(words) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, n_docs),
p AS (SELECT k, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS part FROM tf JOIN w USING (t), c),
s AS (SELECT item_id, k, doc_id, CAST(sum(part * times) AS BIGINT) AS score FROM p JOIN q USING (t) GROUP BY ALL HAVING sum(part * times) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, which says control strings."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.examples(rows.unionByName(odd)))


# The length of a written turn: its marks, and one character more for each that is escaped (two for those in roles).
ORACLES["op13_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
l AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7
             + 3 * length(role) - 2 * length(regexp_replace(role, '[%:<]', '', 'g')) + 4 + 2 + 8 AS chars FROM t),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""
