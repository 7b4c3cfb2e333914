"""Documents -> packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``docs`` (further columns of the input ride along).  A stage
decides by document id.  A row without a doc_id is known by its text, so its
copies share one fate; rows that repeat a doc_id share one fate too, and the
near-duplicate stage leaves one of them (the smallest by all its columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equitally.llm.common import importable, read, write_table
from equitally.llm.decontaminate import contaminated
from equitally.llm.lines import drop_boilerplate, page_key
from equitally.llm.packing import crc32_column, pack
from equitally.llm.quality import classify
from equitally.llm.simhash import near_duplicates

#: Text in a block of the quality stage: a quarter of what the operator takes
#: alone, as Python workers of other stages are still there.  It changes no result.
QUALITY_BLOCK = 8_000_000
#: Keys of rows without a doc_id lie at and above this.
NO_ID = 1 << 62


def key() -> Column:
    from_text = F.xxhash64(F.lit("no id"), "text").bitwiseAND(NO_ID - 1).bitwiseOR(NO_ID)
    return F.coalesce(F.col("doc_id").cast("long"), from_text)


def identified(docs: DataFrame) -> DataFrame:
    importable(docs.sparkSession)
    return docs.select(key().alias("doc_id"), "text", "lang", "source")


def without(docs: DataFrame, ids: DataFrame, keep: bool = False) -> DataFrame:
    """``docs`` less the documents of ``ids`` (doc_id), or those alone."""
    lost = ids.select(F.col("doc_id").alias("__lost")).distinct()
    return docs.withColumn("__key", key()).join(lost, F.col("__key") == F.col("__lost"), "left_semi" if keep else "left_anti").drop("__key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents and those without text go."""
    judged = classify(identified(docs), read(spark, sf_dir, "labels"), block_bytes=QUALITY_BLOCK)
    return without(docs, write_table(judged.where("not keep").select("doc_id"), "pipeline-rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text.  Near-duplicates count as
    one page, or a group of them would lose all the lines that it shares."""
    importable(spark)
    texts = docs.where("text is not null").select(page_key("text").alias("doc_id"), "text")
    groups = write_table(near_duplicates(texts).where("doc_id <> component_id").distinct()
                         .select(F.col("doc_id").alias("page"), F.col("component_id").alias("group")), "pipeline-pages")
    cut = drop_boilerplate(docs, counts=("__lines", "__dropped"), groups=groups)
    n_chars = F.when(F.col("__dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    found = write_table(near_duplicates(identified(docs)), "pipeline-near")
    kept = without(docs, found.where("doc_id <> component_id"))
    several = write_table(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-several")
    one = without(kept, several, keep=True).withColumn("__key", key()).groupBy("__key") \
        .agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return without(kept, several).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(identified(docs), read(spark, sf_dir, "benchmark"))
    return without(docs, write_table(found.select("doc_id"), "pipeline-contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document that is left."""
    importable(spark)
    return pack(docs).select("doc_id", "start", "length", crc32_column().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the model nor the packing; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
