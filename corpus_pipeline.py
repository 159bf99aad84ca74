"""A training-data pipeline over `documents`: each stage gets what the one before kept, written and read again.

run(spark, sf_dir) is the whole pipeline; STAGES are its steps. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm import bpe, chosen_path, langid, latent, pii
from sitefold.llm.common import table, written
from sitefold.llm.queries import PII_KEY, tokenizer_file

# A text that costs at least as many bits as its plain bytes under every learned language is no language.
REJECTED_BITS = 8.0
# Bytes of text whose words are listed together: a task holds some ten times as much.
WORD_BLOCK = 8 << 20
# A task holds an Arrow batch several times, in the executor and in its Python worker. Rows do not depend on where batches end.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
# Of the texts read at once a task holds one array, which doubles as it grows.
READ_KEY, READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "512"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches have at most BATCH_BYTES and whose read batches READ_ROWS from then on, unless the session has sizes of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, size in ((BATCH_KEY, BATCH_BYTES), (READ_KEY, READ_ROWS)):
            if key not in spark.conf.getAll:
                spark.conf.set(key, size)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; `lang` becomes the predicted one. Null texts, texts without letters and noise go."""
    named = langid.predict(docs, langid.train(docs), pred_col="_predicted", score_col="_score", bits_col="_bits")
    kept = named.where((F.col("_predicted") != "und") & (F.col("_bits") < REJECTED_BITS))
    return kept.withColumn("lang", F.col("_predicted")).select(*docs.columns)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Rows that share an id stay or go together; a null id stays."""
    groups = chosen_path.near_duplicates(docs.select("doc_id", "text"))
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. A null id cannot be told from another and stays."""
    found = latent.leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


@in_small_batches
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in `text` replaced; `n_chars` follows the text."""
    done = pii.pseudonymise(docs, PII_KEY, count_col="_found", kinds_col="_kinds")
    return done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text with the text they decode to, and the other columns."""
    done = bpe.encode(docs, tokenizer_file(), block_bytes=WORD_BLOCK, decoded_col="decoded")
    other = [c for c in docs.columns if c not in ("text", "ids", "decoded", "n_tokens")]
    return done.select(*other, F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pseudonyms), ("bpe", tokens)]

# Learned statistics, minwise hashes and keyed permutations have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
