"""The registered queries opN_<name> and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitally.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.lines import drop_boilerplate
    return drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


OP1_SQL = """
WITH lines AS (
  SELECT source, text, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line
  FROM documents WHERE text IS NOT NULL),
seen AS (SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT text) >= 5),
hosts AS (SELECT source, count(DISTINCT text) AS pages FROM documents WHERE text IS NOT NULL GROUP BY source),
boiler AS (
  SELECT s.source, list(s.line) AS bad FROM seen s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  WHERE s.n::DOUBLE / h.pages > 0.05 GROUP BY s.source),
kept AS (
  SELECT d.doc_id, string_split(d.text, chr(10)) AS every,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.bad, CAST([] AS VARCHAR[])), trim(x))) AS rest
  FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN every IS NULL THEN NULL WHEN len(rest) = 0 THEN '' ELSE array_to_string(rest, chr(10)) END AS text,
  coalesce(len(every), 0) AS n_lines, coalesce(len(every) - len(rest), 0) AS n_dropped
FROM kept
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.simhash import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.packing import crc32_column, pack
    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", crc32_column().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.urls import filter_urls
    return filter_urls(read(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.pii import find_personal_data
    return find_personal_data(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.quality import classify
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.bitsliced import top_k
    rows = read(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.repeats import remove_repeats
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.extract import extract
    return extract(read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.decontaminate import contaminated
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.alignment import align
    return align(read(spark, sf_dir, "documents"))[0]


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.codes import compress
    return compress(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equitally.llm.jaccard import join
    return join(read(spark, sf_dir, "documents"))


_ASSIGN = """
a{i} AS MATERIALIZED (
  SELECT s.vec_id, s.p, min({{'d': list_inner_product(s.x, s.x) - 2 * list_inner_product(s.x, b.x) + list_inner_product(b.x, b.x), 'e': b.e}}) AS m
  FROM parts s JOIN b{i} b ON s.p = b.p GROUP BY s.vec_id, s.p)"""
_AVERAGE = """
s{i} AS (
  SELECT a.p, a.m.e AS e, i, sum(s.x[i + 1])::HUGEINT AS total, count(*)::HUGEINT AS n
  FROM a{i} a JOIN parts s ON s.vec_id = a.vec_id AND s.p = a.p, width, unnest(range(width.w)) AS r(i) GROUP BY ALL),
b{j} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(f.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT p, e, list(((total - ((total % n) + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{i} GROUP BY p, e) f ON f.p = b.p AND f.e = b.e)"""
OP12_SQL = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(q)) // 16 AS w FROM v),
parts AS MATERIALIZED (SELECT vec_id, p, list_slice(q, p * w + 1, (p + 1) * w) AS x FROM v, width, unnest(range(16)) AS r(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),""" + ",".join([
    _ASSIGN.format(i=0), _AVERAGE.format(i=0, j=1), _ASSIGN.format(i=1), _AVERAGE.format(i=1, j=2), _ASSIGN.format(i=2)]) + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(x[i + 1]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM b2, width, unnest(range(width.w)) AS r(i))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, books.h AS codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_url_filter": op4_url_filter,
        "op5_personal_data": op5_personal_data,
        "op6_quality": op6_quality,
        "op7_bitsliced_topk": op7_bitsliced_topk,
        "op8_repeated_windows": op8_repeated_windows,
        "op9_main_text": op9_main_text,
        "op10_decontamination": op10_decontamination,
        "op11_alignment": op11_alignment,
        "op12_vector_codes": op12_vector_codes,
        "op13_jaccard_join": op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op7_bitsliced_topk": OP7_SQL, "op12_vector_codes": OP12_SQL}
