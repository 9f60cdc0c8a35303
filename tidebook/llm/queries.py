"""The registered queries of this subpackage, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import embeddings, linededup, media, mixing, packing, pii, simhash, tokenfile, toxicity, warc
from tidebook.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows whose labels no training sees."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(labels.where(~held_out()), docs, Scratch(spark, "op1"))
    out = toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.deduplicate(docs, Scratch(spark, "op3"))
    lines = F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    ranges = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", lines.cast("long").alias("removed_lines"), words.alias("removed_words"), ranges.alias("removed"), "text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "op5")))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_shards(tokenfile.write_shards(table(spark, sf_dir, "documents"), Scratch(spark, "op6")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are of the base spans, which base_sha256 digests; spans holds those and the added ones."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), *pii.train(spark))
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("found")).alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media: the query makes a picture of every row of embeddings, and edited copies of every twentieth."""
    scratch = Scratch(spark, "op10")
    return media.copies(media.pictures(table(spark, sf_dir, "embeddings")), scratch)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash_near_dedup, op3_line_dedup, op4_best_fit_packing, op5_warc_bundles, op6_token_ids, op7_personal_data, op8_embedding_near_dedup, op9_source_mixing, op10_image_copies)}
SQL: dict[str, str] = {
    "op5_warc_bundles": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
    # compares all pairs of a label: for small tables
    "op8_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM r GROUP BY vec_id""",
}
