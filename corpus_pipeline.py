"""From raw documents to token ids: language, near duplicates, repeated passages, benchmark leaks, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Stages 1 to 4
return the columns of ``documents``; the last returns one row for each document with its token
counts and digests. Decisions are taken back row by row: rows without an id, or of one id, are
judged each by its own text. Null text is carried like empty text, which the first stage rejects.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.llm import byte_bpe, decontaminate, lang_id, near_dedup, suffix_dedup
from eventmill.llm.scratch import Scratch, small_batches

#: Ids up to this number are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Languages that are kept; None for all that the model knows.
LANGUAGES: frozenset[str] | None = None
#: A language that scores less has lost a contest to another, so that none can be told.
LEAST_SCORE = 0.5
#: Words of a passage that is cut when it occurs twice.
PASSAGE_WORDS = 50


def _rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with __row, a number for each row: doc_id if ids are filled and differ, else one that is written with the rows."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    return Scratch(docs.sparkSession, name).keep(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``rows`` without those whose number is in ``dropped``, and without the numbers."""
    dropped = Scratch(rows.sparkSession, name).keep(dropped.distinct(), "dropped")
    small = dropped.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(dropped) if small else dropped, "__row", "left_anti").select(*(c for c in rows.columns if c != "__row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language, or none of ``LANGUAGES``, can be told; an unknown ``lang`` becomes the one told."""
    small_batches(spark)
    judged = lang_id.identify(docs, lang_id.train(docs, row_key=F.col("doc_id")))
    told = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if LANGUAGES is not None:
        told &= F.col("lang_pred").isin(*LANGUAGES)
    return judged.where(told).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near duplicates, of a similarity of 0.8 or more."""
    small_batches(spark)
    rows = _rows(docs, "near-rows")
    judged = near_dedup.near_duplicates(rows, id_col="__row", percent=80)
    return _without(rows, judged.where("not kept").select(F.col("doc_id").alias("__row")), "near-stage")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 50 words that starts anywhere else, too."""
    small_batches(spark)
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_WORDS, unit="word", as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return cut.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold passages of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _rows(docs, "leak-rows")
    return _without(rows, decontaminate.contaminated(rows, items, id_col="__row").select(F.col("doc_id").alias("__row")), "leak-stage")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, as digests beside those of the text they decode to."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), *digests)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: Learned models, suffix arrays and merges by rank can't be said in SQL; a test holds ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
