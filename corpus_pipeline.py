"""From raw documents to a training mix: quality, near duplicates, repeated passages, benchmark leaks, source weights.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's docs.
All but the last keep the columns of docs. Rows with a null text pass the stages that compare texts, rows with a null key are
compared like all others; empty tables pass all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf
from voxcohort.llm.decontaminate import without_leaks
from voxcohort.llm.ngram_join import similar_documents
from voxcohort.llm.quality import score_quality
from voxcohort.llm.registry import table
from voxcohort.llm.source_mixing import mixed_rows
from voxcohort.llm.suffix_dedup import remove_repeated_bytes

#: Least probability of good quality of a document that stays.
LEAST_QUALITY = 0.3


#: Bytes of a repeated passage at least; 50 words are 200 to 500 bytes.
PASSAGE = 200


def _row(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name meets a stage's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on three quarters of the labelled rows, calibrated on the rest."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = docs.select("doc_id", "text", _row(docs).alias("row"))
    scored = score_quality(rows, table(spark, sf_dir, "labels"), fold > 0, fold == 0)
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of similar rows: that of least key, one without a key only where no other has one.

    Rows are the nodes, by key and text together (two 64-bit hashes): keys may repeat or be missing. Of rows equal in both one
    stays. Rows without words are similar to none.
    """
    shelf = Shelf(spark)
    same = ["one", "two"]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("one"), F.xxhash64(F.lit(1), "doc_id", "text").alias("two"), "doc_id", "text", _row(docs).alias("row"))
    found = similar_documents(rows, "one", carry=("two", "doc_id"))
    found = shelf.put(found.where("n_shingles > 0").select(*same, "doc_id", "component_id"))
    least = F.min(F.struct(F.isnull("doc_id").alias("keyless"), "doc_id", *same)).alias("least")
    stay = found.groupBy("component_id").agg(least).select("least.one", "least.two", F.lit(True).alias("stays"))
    copies = found.groupBy(*same).agg(F.count("*").alias("n"))
    # stored, so that the join knows its size
    marked = shelf.put(copies.join(stay, same, "left").where("stays is null or n > 1").select(*same, F.col("stays").isNotNull().alias("once")))
    # one hash parts the rows; of those that share it with a row that goes, the second tells who does
    doubt = marked.select("one").distinct()
    out = rows.join(doubt, "one", "left_anti").select("row").unionByName(
        rows.join(doubt, "one", "left_semi").join(marked.select(*same), same, "left_anti").select("row"))
    once = marked.where("once").select(*same)
    if not once.isEmpty():
        out = out.unionByName(rows.join(once, same, "left_semi").dropDuplicates(same).select("row"))
    return out.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of ``PASSAGE`` bytes that repeat; a character that loses a byte goes, and so does a text that loses all.

    n_chars follows the text.
    """
    rows = docs.select("doc_id", "text", _row(docs).alias("row"))
    out = remove_repeated_bytes(rows, window=PASSAGE, carry=("text", "row"))
    left = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")("kept")
    cut = F.size("removed") > 0
    out = out.select("row", cut.alias("cut"), F.when(cut, left).otherwise(F.col("text")).alias("left")).where("not cut or length(left) > 0")
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with size, source_size, target and the copies taken."""
    return mixed_rows(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
]

#: Classifier, alignment and tilts have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    shelf = Shelf(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return docs
