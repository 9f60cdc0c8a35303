"""The training-corpus pipeline: five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import linededup, mixing, packing, similar, toxicity
from tidebook.llm.common import Scratch, free_names

#: Most bytes of an Arrow batch that an executor builds for a Python worker. Each task holds a batch
#: several times: in the JVM, in the stream to the worker, in the worker as Arrow and as strings.
BATCH_BYTES = 4 << 20


def stage_scratch(spark: SparkSession, stage: str) -> Scratch:
    """Scratch of a stage, with Arrow batches of at most about BATCH_BYTES unless the session sets its own limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, BATCH_BYTES)
    return Scratch(spark, f"stage-{stage}")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below the threshold; trained on labels that are not held out.

    Null and empty texts are scored like any other (and so stay), repeated rows stay all, rows with
    a null doc_id train nothing. Without labels of both classes nothing is dropped unless all labels
    are toxic. Other columns may have any name; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = toxicity.train(labels, docs, stage_scratch(spark, "toxicity"))
    score = free_names(docs, "score")[0]
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; documents of which nothing is left go.

    Null and empty texts stay. n_chars follows the text where lines went. Of rows equal in doc_id
    and text one stays if they have the words of a run, else all. Other columns may have any name.
    """
    name = free_names(docs, "removed")[0]
    found = linededup.deduplicate(docs, stage_scratch(spark, "lines"), name=name)
    changed = F.size(name) > 0
    return found.where(~changed | (F.length("text") > 0)).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8.

    Nulls, empty texts and repeated rows as ``similar.keep_one`` says.
    """
    return similar.keep_one(docs, stage_scratch(spark, "similar"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; nulls and repeated rows as ``mixing.apply_mix`` says."""
    return mixing.apply_mix(docs, stage_scratch(spark, "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; a null text is an empty one, each row has its own pieces."""
    return packing.pack_documents(docs, stage_scratch(spark, "pack"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, similarity over shingles and a tokenizer are not SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return STAGES[-1][1](spark, docs, sf_dir)
