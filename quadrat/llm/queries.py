"""The ten operators as queries over whole tables, and the pipeline."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, html, licenses, neardup, packing, shards, threads, tokenstore, toxicity
from .common import shared_folder, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its SQL compares every window; the query's search is approximate and finds the same on the test tables."""
    rows = decontam.leaks(table(spark, "documents", sf_dir), table(spark, "benchmark", sf_dir))
    return rows.withColumn("similarity", F.round("similarity", 6))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as the compacted store reads them, texts by length and digest."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    rows = shards.sharded(table(spark, "documents", sf_dir), folder).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("digest"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replies says whether a message replies to any; readers differ in the type of a null in a column of integers, so reply_to names the message itself where it doesn't."""
    rows = threads.conversations(table(spark, "conversations", sf_dir))
    return rows.withColumns({"replies": F.col("reply_to").isNotNull(), "reply_to": F.coalesce("reply_to", "turn")})


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its SQL compares all documents; the query's search is approximate and finds the same on the test tables."""
    return neardup.duplicates(table(spark, "documents", sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, "documents", sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, "documents", sf_dir), table(spark, "labels", sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, "documents", sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, "documents", sf_dir))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all texts, then reads every frame by the index and returns what it decodes to, by length and digest."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return tokenstore.read_digests(tokenstore.write(table(spark, "documents", sf_dir), folder), folder)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, "pages", sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_sharding, op3_chat_formatting, op4_minhash_near_dedup, op5_best_fit_packing, op6_toxicity, op7_license_scan, op8_exact_dedup, op9_token_output, op10_html_extraction)}


ORACLE_SQL = {
    "op1_decontamination": r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER (ORDER BY doc_id) AS row, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', row_number() OVER (ORDER BY item_id), item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') FROM benchmark WHERE text IS NOT NULL),
shingles AS (SELECT kind, row, id, unnest(range(greatest(len(ws) - 1, 1))) AS pos, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) ELSE ws END) AS sh FROM words WHERE len(ws) > 0),
bag AS (SELECT row AS item, sh, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY 1, 2),
total AS (SELECT count(DISTINCT item) AS items FROM bag),
weight AS (SELECT sh, 1 + ln((any_value(items) + 1) / (count(*) + 1)) AS w FROM bag, total GROUP BY 1),
item AS (SELECT item, sum(n) AS size, sum(n * w) AS whole FROM bag JOIN weight USING (sh) GROUP BY 1),
doc AS (SELECT row AS doc, pos, sh, w AS known, coalesce(w, 1 + ln(items + 1)) AS w FROM shingles LEFT JOIN weight USING (sh), total WHERE kind = 'd'),
sums AS (SELECT doc, pos, sum(w) OVER (PARTITION BY doc ORDER BY pos) - w AS before, count(*) OVER (PARTITION BY doc) AS len, sum(w) OVER (PARTITION BY doc) AS every FROM doc),
hit AS (SELECT doc, pos, sh, w FROM doc WHERE known IS NOT NULL),
held AS (SELECT doc, item, sum(w * least(m, n)) AS most FROM (SELECT doc, sh, any_value(w) AS w, count(*) AS m FROM hit GROUP BY 1, 2) JOIN bag USING (sh) GROUP BY 1, 2),
pair AS (SELECT doc, item, size, whole FROM held JOIN item USING (item) WHERE most >= 0.5 * whole - 1e-9),
near AS (SELECT doc, item, size, whole, h.pos, h.sh, h.w, b.n FROM pair JOIN hit h USING (doc) JOIN bag b USING (item, sh)),
part AS (SELECT doc, item, any_value(size) AS size, any_value(whole) AS whole, start, sh, least(count(*), any_value(n)) * any_value(w) AS w
  FROM (SELECT *, unnest(range(greatest(pos - size::BIGINT + 1, 0), pos + 1)) AS start FROM near) GROUP BY doc, item, start, sh),
shared AS (SELECT doc, item, start, any_value(size) AS size, any_value(whole) AS whole, sum(w) AS w FROM part GROUP BY 1, 2, 3),
scored AS (SELECT p.doc, item, start, p.w / (coalesce(e.before, s.every) - s.before + whole - p.w) AS sim
  FROM shared p JOIN sums s ON s.doc = p.doc AND s.pos = p.start LEFT JOIN sums e ON e.doc = p.doc AND e.pos = p.start + p.size),
best AS (SELECT doc, item, max(sim) AS sim, arg_min(start, (-round(sim, 9), start)) AS start FROM scored WHERE sim >= 0.5 - 1e-12 GROUP BY 1, 2)
SELECT d.id AS doc_id, i.id AS item_id, round(sim, 6) + 0.0 AS similarity, start AS first_word FROM best JOIN words d ON d.kind = 'd' AND d.row = doc JOIN words i ON i.kind = 'i' AND i.row = item""",
    "op4_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k:k + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.5 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS id, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id)
SELECT id AS doc_id, min(root) AS duplicate_of FROM reach GROUP BY 1 HAVING min(root) < id""",
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS text_bytes, md5(text) AS digest FROM documents",
    "op9_token_output": "SELECT doc_id, strlen(text)::BIGINT AS text_bytes, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "op8_exact_dedup": """
SELECT doc_id, keep AS duplicate_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
WHERE doc_id <> keep GROUP BY ALL""",
    "op3_chat_formatting": r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS LAST, text NULLS LAST) AS k FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE k = 1),
split AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM m WHERE text IS NOT NULL),
lines AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM split),
marked AS (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]*)+') AS marks FROM lines),
leveled AS (SELECT conv_id, turn, k, length(marks) - length(replace(marks, '>', '')) AS level, substr(line, length(marks) + 1) AS body FROM marked),
kept AS (
  SELECT * FROM (SELECT *, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY k) AS next FROM leveled)
  WHERE NOT (next > level AND regexp_matches(body, '(?i)\b(wrote|writes|said|schrieb|a écrit|écrit|escribió)\b[^\n]{0,40}:[ \t]*$')) OR next IS NULL),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY k) AS run FROM (
    SELECT *, CASE WHEN lag(level) OVER (PARTITION BY conv_id, turn ORDER BY k) = level THEN 0 ELSE 1 END AS new FROM kept WHERE level = 0 OR trim(body, E' \t\r\x0b\x0c') <> '')),
passages AS (SELECT conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY k) AS body FROM runs GROUP BY ALL),
cut AS (SELECT conv_id, turn, level, unnest(string_split(regexp_replace(trim(regexp_replace(body, '\s+', ' ', 'g')), '([.!?…。！？]) ', '\1' || chr(1), 'g'), chr(1))) AS s FROM passages),
sentences AS (SELECT conv_id, turn, level, array_to_string(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), ' ') AS s FROM cut),
quoting AS (SELECT DISTINCT conv_id, turn FROM sentences WHERE level > 0 AND s <> ''),
own AS (SELECT DISTINCT conv_id, turn AS source, s FROM sentences WHERE level = 0 AND s <> ''),
votes AS (SELECT q.conv_id, q.turn, q.level, o.source, count(*) AS n FROM sentences q JOIN own o ON o.conv_id = q.conv_id AND o.s = q.s AND o.source < q.turn WHERE q.level > 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) AS r FROM votes),
clean AS (SELECT conv_id, turn, trim(string_agg(trim(body, chr(10)), chr(10) ORDER BY run), E' \n\t\r\x0b\x0c') AS text FROM passages JOIN quoting USING (conv_id, turn) WHERE level = 0 GROUP BY ALL),
linked AS (
  SELECT m.conv_id, m.turn, m.role, CASE WHEN q.turn IS NULL THEN m.text ELSE coalesce(c.text, '') END AS text, coalesce(b.source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS reply_to
  FROM m LEFT JOIN best b ON b.conv_id = m.conv_id AND b.turn = m.turn AND b.r = 1 LEFT JOIN quoting q ON q.conv_id = m.conv_id AND q.turn = m.turn LEFT JOIN clean c ON c.conv_id = m.conv_id AND c.turn = m.turn),
tree AS (
  SELECT conv_id, turn, [turn] AS path FROM linked WHERE reply_to IS NULL
  UNION ALL SELECT l.conv_id, l.turn, list_append(t.path, l.turn) FROM tree t JOIN linked l ON l.conv_id = t.conv_id AND l.reply_to = t.turn)
SELECT l.conv_id, (row_number() OVER (PARTITION BY l.conv_id ORDER BY path) - 1)::BIGINT AS position, l.turn, l.role, l.reply_to IS NOT NULL AS replies, coalesce(l.reply_to, l.turn) AS reply_to, (len(path) - 1)::BIGINT AS depth, l.text
FROM linked l JOIN tree USING (conv_id, turn)""",
}
