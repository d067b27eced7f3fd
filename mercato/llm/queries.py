"""The driver's queries over the operators of this package, and their SQL.

Each query applies its operator to the whole table, with production parameters,
and derives the digest columns of its contract from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.alignment import align
from mercato.llm.bitsliced import top_k
from mercato.llm.exact_dedup import exact_dedup
from mercato.llm.html_text import extract
from mercato.llm.langid import fit, identify
from mercato.llm.mixing import mix_plan
from mercato.llm.packing import pack
from mercato.llm.shared import fewer, read_table, shipped, work_path
from mercato.llm.sharding import shard
from mercato.llm.simhash import simhash_dedup
from mercato.llm.suffix_dedup import remove_repeats
from mercato.llm.token_files import read_token_files, write_token_files
from mercato.llm.toxicity import fit as fit_lexicon
from mercato.llm.toxicity import score
from mercato.llm.whitening import components_of, whiten


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text`` is what is left, with replacement characters where a cut parts one."""
    docs = read_table(spark, sf_dir, "documents")
    found = remove_repeats(fewer(docs, docs.rdd.getNumPartitions()))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op2_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_token_files(read_table(spark, sf_dir, "documents"), path)

    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: text without markup, the language their markup declares, their
    host. The text models come from the labelled documents."""
    model = fit(read_table(spark, sf_dir, "documents").select("text", "lang"))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html", F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return identify(pages, model, "page_id", "html", "declared", "host", markup=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_spill_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a CRC-32 divisible by 5 are held out of the fit."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    lexicon = fit_lexicon(docs.filter(~held_out), labels.filter(~held_out))
    return score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(*whiten(read_table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


_OPERATORS = (
    op1_suffix_dedup,
    op2_bitsliced_topk,
    op3_source_mixing,
    op4_token_files,
    op5_order_packing,
    op6_stratified_shards,
    op7_language_id,
    op8_exact_dedup,
    op9_simhash,
    op10_html_text,
    op11_spill_alignment,
    op12_toxicity,
    op13_block_whitening,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: shipped(f) for f in _OPERATORS}

ORACLE_SQL = {
    "op2_bitsliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5""",
    "op3_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM per),
summed AS (
  SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS ws,
         coalesce(sum(3 * s) OVER b, 0) AS s0, coalesce(sum(w) OVER b, 0) AS w0
  FROM weighed
  WINDOW b AS (ORDER BY s / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (t - s0) * w > 3 * s * (ws - w0) AS c FROM summed),
rest AS (
  SELECT *, sum(CASE WHEN c THEN 3 * s ELSE 0 END) OVER () AS s1, sum(CASE WHEN c THEN w ELSE 0 END) OVER () AS w1
  FROM capped),
targets AS (
  SELECT source, s, c,
         CASE WHEN c THEN CAST(3 * s AS DOUBLE) ELSE CAST((t - s1) * w AS DOUBLE) / CAST(ws - w1 AS DOUBLE) END AS target
  FROM rest),
rates AS (
  SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE WHEN c THEN 3.0::DOUBLE ELSE least(target / s, 3.0::DOUBLE) END AS rate
  FROM targets),
drawn AS (
  SELECT d.doc_id, d.size, r.s AS source_size, r.target, r.rate,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || CAST(d.size AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM drawn""",
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""",
}
