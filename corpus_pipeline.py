"""The corpus pipeline: five stages, each over all documents that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. `run`
applies them one after another; a driver may as well write each result and hand it to the next stage.

Stages judge rows: rows that repeat a doc_id each stay or go, null texts count as empty, and no stage needs a doc_id except where
its description says so. Of an empty table every stage makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.bloom import without
from evalfold.llm.common import read, staged
from evalfold.llm.decontaminate import find_contamination
from evalfold.llm.line_dedup import dedup_lines
from evalfold.llm.near_dedup import near_duplicates
from evalfold.llm.quality import resample
from evalfold.llm.sentence_pieces import sample_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps. Rows without doc_id draw their noise from 0 and have no label."""
    return resample(docs, read(spark, sf_dir, "labels"), carry=COLUMNS).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; n_chars is that of the new text. Rows of one doc_id count as one document for a
    line; a row without doc_id keeps no repeated line."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the one of least doc_id) of each group of near duplicates: five-word shingles, similarity 0.8.

    A doc_id that goes takes all its rows with it; rows without doc_id stay, as nothing names them. `docs` is read several
    times, so it should be a written table (`run` writes it)."""
    gone = staged(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, whatever their doc_id."""
    return find_contamination(docs, read(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces and, as `text`, what they decode to; the draws follow doc_id."""
    import public_tokenizers

    found = sample_pieces(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", "n_pieces", "pieces", lossless.alias("lossless"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentence pieces", pieces_stage),
]

#: SQL can't express the first stage's models nor the last stage's sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is line_stage:  # the next stage reads it more than once
            docs = staged(docs, name.replace(" ", "-"))
    return docs
