"""From documents to packed sequences: language ID, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and may be given any further columns. Tables
that a stage stages are removed by run() once its result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language_id as lid
from weftline.llm import line_dedup, mixing, near_dedup, packing
from weftline.llm.common import clear, staged, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (`und`: null and empty texts among them); learns from those with a lang. Rows that
    repeat a doc_id are judged each; without any lang all go; an empty table stays empty."""
    model = lid.train(docs.select("doc_id", "text", "lang"), lid.default_vocabulary())
    whole = F.struct(*[c for c in docs.columns if c != "text"]).alias("whole")
    found = lid.identify(docs.select("doc_id", "text", whole), model)
    return found.where("lang_pred <> 'und'").select(*["text" if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts without their repeated lines; all documents stay, a null text as an empty one. n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.line_dedup(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("whole")))
    length = F.length("text").cast("long")
    return out.select(*[c if c in ("doc_id", "text") else length.alias(c) if c == "n_chars" else F.col("whole")[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: one with the smallest doc_id (null before all others, if all are null).
    Texts without a word are no group and stay."""
    numbered = stage(docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row")), "numbered")
    found = near_dedup.near_dedup(numbered.select("whole.doc_id", "whole.text", "row"), row_id="row")
    kept = found.where("kept").groupBy("root").agg(F.min("row").alias("row"))
    return numbered.join(kept.select("row").hint("merge"), "row", "left_semi").select(*[F.col("whole")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mix takes of them, repeats on lines of their own; documents that it doesn't take go, as do those
    without a word. A null source is a source of its own."""
    return mixing.mix_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null text is its end token alone, a null doc_id stays null, rows that repeat a
    doc_id are packed each, and an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix), ("packing", pack)]

#: Tokenizing and models have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before = staged()
        docs = stage(function(spark, docs, sf_dir), name)
        clear(staged() - before - {docs.staged_at})
    return STAGES[-1][1](spark, docs, sf_dir)
