"""From raw documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it
again as the next stage's docs. All but the last return the columns of docs, which may have any further names: what a stage
adds on the way has names that docs has not. Rows with null ids and repeated rows go through every stage like others; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, fresh, table, with_row_id
from lodestone.llm.op1_decontaminate import decontaminate
from lodestone.llm.op2_simhash import simhash_near_dedup
from lodestone.llm.op3_mix import mix_sources
from lodestone.llm.op4_lines import line_dedup
from lodestone.llm.op7_quality import quality_filter


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number, written down so that it stays the same for every reader, and the number's column."""
    row = fresh(docs, "row")
    return cut(with_row_id(docs, row)), row


def _recounted(docs: DataFrame, changed: Column) -> Column:
    """n_chars, following the text where that has changed."""
    return F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go, and from the others the lines that too many documents of their source hold."""
    if "n_chars" not in docs.columns:
        return quality_filter(docs)
    before = fresh(docs, "before")
    out = quality_filter(docs.withColumn(before, F.xxhash64("text")))
    return out.withColumn("n_chars", _recounted(docs, F.xxhash64("text") != F.col(before))).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for one document each; n_chars follows the text. Documents left without a line stay, empty."""
    kept = line_dedup(docs.select("doc_id", "text"), changed_only=True).where("n_dropped > 0")
    own, row, text = (fresh(docs, x) for x in ("own", "row", "kept"))
    kept = kept.select(F.col("doc_id").alias(own), F.col("row_hash").alias(row), F.col("kept_text").alias(text)).dropDuplicates([own, row])
    out = docs.join(kept, (F.xxhash64("doc_id", "text") == F.col(row)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    changed = F.col(row).isNotNull()
    out = out.withColumn("text", F.when(changed, F.col(text)).otherwise(F.col("text")))
    return (out.withColumn("n_chars", _recounted(docs, changed)) if "n_chars" in docs.columns else out).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    rows, row = _numbered(docs)
    found = simhash_near_dedup(rows.select(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("key"), "text"), "key")
    kept = found.where("key = component_id").select(F.col("key.row").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


ADDED = ("size", "source_size", "target", "copies", "taken")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies (how often each is taken) and taken (words); a
    column of docs of such a name is left out."""
    rows, row = _numbered(docs)
    own = fresh(rows, "own")
    mix = mix_sources(rows.select("doc_id", "source", "text", row), row_col=row).where("copies > 0").select(F.col("rid").alias(own), *ADDED)
    theirs = [c for c in docs.columns if c.lower() not in ADDED]
    return rows.select(row, *theirs).join(mix, F.col(row) == F.col(own)).select(*theirs, *ADDED)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture)]
#: Greedy string tiling and near copies are beyond SQL; tests/llm/test_pipeline.py compares each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
