"""One query for each operator, applied to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, linededup, media, neardup, packing, passages, pii, ppm
from .tables import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.line_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without distance, that of the fingerprints."""
    return decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")).drop("distance")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs.withColumn("held_out", langid.held_out()), model, ["doc_id", "held_out"])


#: What conversation -7 says in both turns.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    records = chat.records_of_rows(rows.unionByName(extra))
    return chat.chat_digests(chat.format_chats(records, "conv_id", "record"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut_pieces(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without n_links, which depends on the pairs that happen to be compared; the classes don't."""
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_links")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents),
line AS (SELECT doc_id, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS k FROM doc),
own AS (SELECT doc_id, k, line, list_distinct(list_filter(string_split_regex(lower(line), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')) AS w FROM line),
class AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS c, len(w) AS n FROM own WHERE len(w) > 0 QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, k) = 1),
tok AS (SELECT c, n, unnest(w) AS t FROM class),
df AS (SELECT t, count(*) AS lines FROM tok GROUP BY t),
prefix AS (SELECT c, n, t FROM tok JOIN df USING (t) QUALIFY row_number() OVER (PARTITION BY c ORDER BY lines, t) <= n - ceil(n * 4 / 5) + 1),
pair AS (SELECT DISTINCT a.c AS early, b.c AS late FROM prefix a JOIN prefix b ON a.t = b.t AND a.c < b.c AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
link AS (SELECT b.c AS late, b.doc_id AS ld, a.doc_id AS ed FROM pair JOIN class a ON a.c = early JOIN class b ON b.c = late
  WHERE 5 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
gone AS (SELECT o.doc_id, o.k FROM own o LEFT JOIN class c ON o.doc_id = c.doc_id AND o.k = c.k WHERE len(o.w) > 0 AND (c.c IS NULL OR c.c IN (SELECT late FROM link))),
cut AS (SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS removed FROM gone GROUP BY doc_id),
ends AS (SELECT doc_id, count(*) AS n FROM (SELECT ed AS doc_id FROM link UNION ALL SELECT ld FROM link) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed,
  coalesce(removed, '') AS removed, CAST(coalesce(ends.n, 0) AS BIGINT) AS n_links
FROM doc d LEFT JOIN cut USING (doc_id) LEFT JOIN ends USING (doc_id)
"""

# Every window around a shared shingle is compared with the item, without fingerprints.
OP2_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT *, least(len(w), 5) AS k FROM (
  SELECT row_number() OVER () AS i, item_id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
place AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k),
own AS (SELECT r, k, p - 1 AS p, array_to_string(w[p : p + k - 1], ' ') AS s FROM place),
letters AS (SELECT r, k, p, s, length(s) - k + 1 AS weight, sum(length(s) - k + 1) OVER (PARTITION BY r, k ORDER BY p) AS upto FROM own),
its AS (SELECT i, s, count(*) AS n FROM (SELECT i, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM item)) GROUP BY ALL),
size AS (SELECT i, item_id, k, len(w) AS words, (SELECT sum(n * (length(s) - k + 1)) FROM its WHERE its.i = item.i) AS weight FROM item),
hit AS (SELECT l.r, z.i, l.p, l.s, l.weight, its.n, unnest(range(greatest(0, l.p + z.k - z.words), least(l.p, greatest(0, len(d.w) - z.words)) + 1)) AS start
  FROM letters l JOIN its ON l.s = its.s JOIN size z ON z.i = its.i AND z.k = l.k JOIN doc d ON d.r = l.r),
common AS (SELECT r, i, start, sum(shared) AS shared FROM (SELECT r, i, start, s, min(weight) * least(count(*), min(n)) AS shared FROM hit GROUP BY r, i, start, s) GROUP BY ALL),
win AS (SELECT c.r, c.i, start, shared, z.weight + b.upto - a.upto + a.weight - shared AS whole FROM common c JOIN size z ON z.i = c.i JOIN doc d ON d.r = c.r
  JOIN letters a ON a.r = c.r AND a.k = z.k AND a.p = start JOIN letters b ON b.r = c.r AND b.k = z.k AND b.p = least(start + z.words, len(d.w)) - z.k)
SELECT doc_id, item_id, round(shared / whole, 6) AS similarity, start AS first_word, CAST(least(z.words, len(d.w)) AS BIGINT) AS n_words
FROM win JOIN doc d ON d.r = win.r JOIN size z ON z.i = win.i WHERE shared / whole >= 0.8
QUALIFY row_number() OVER (PARTITION BY win.r, win.i ORDER BY shared / whole DESC, start) = 1
"""

OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), each AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<turn>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)(/?turn>)', '<\\\1\2', 'g'))
             + length('</turn>') + 1) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256,
       CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM each
"""

# Every pair of texts that share a shingle is compared, so this is for small tables only.
OP8_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) AS s FROM doc WHERE len(w) > 0),
tf AS (SELECT r, s, count(*) AS n FROM shingle GROUP BY ALL),
df AS (SELECT s, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM tf GROUP BY s),
node AS (SELECT w, min(r) AS r FROM doc WHERE len(w) > 0 GROUP BY w),
part AS (SELECT r, s, n * idf AS weight FROM tf JOIN df USING (s) SEMI JOIN node USING (r)),
total AS (SELECT r, sum(weight) AS total FROM part GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, sum(least(a.weight, b.weight)) AS shared FROM part a JOIN part b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN total x ON x.r = a JOIN total y ON y.r = b WHERE shared >= 0.8 * (x.total + y.total - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link UNION ALL SELECT r, r FROM node),
reach AS (SELECT r AS a, r AS b FROM node UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
class AS (SELECT a AS r, min(b) AS c FROM reach GROUP BY a),
named AS (SELECT doc.r, doc_id, coalesce(c, -doc.r) AS c FROM doc LEFT JOIN node USING (w) LEFT JOIN class ON class.r = node.r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id, count(*) OVER (PARTITION BY c) AS class_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY c) AS representative
FROM named
"""


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_language_id": op4_language_id,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_near_dedup": op8_near_dedup,
        "op9_personal_data": op9_personal_data,
        "op10_media_columns": op10_media_columns,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_decontamination": OP2_SQL, "op5_chat_formatting": OP5_SQL, "op8_near_dedup": OP8_SQL}
