"""Readers of the lake: bronze pages, probes, run metadata, artifacts, gold tables of an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake import schemas


def page_table(spark: SparkSession, path: str) -> DataFrame:
    """Bronze pages with their fixed schema."""
    return spark.read.schema(schemas.PAGE_RAW).parquet(path)


def endpoint_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENDPOINT_RAW).parquet(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per small JSON file (RUM exports, suppression lists): path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_path"), F.col("value").alias("raw"))


def suppression_files(spark: SparkSession, path: str) -> DataFrame:
    """Suppressions from files that hold an array or an object with a suppressions array."""
    item = "array<struct<id:string,findingId:string,urlPattern:string,reason:string,owner:string,expiresAt:string>>"
    raw = whole_files(spark, path)
    text = F.trim("raw")
    rows = F.when(text.startswith("["), F.from_json(text, item)).otherwise(
        F.from_json(text, f"struct<suppressions:{item}>")["suppressions"]
    )
    return raw.select("source_path", F.explode(rows).alias("s")).select(
        "source_path", F.col("s.id").alias("suppression_id"), F.col("s.findingId").alias("rule_id"),
        F.col("s.urlPattern").alias("url_pattern"), F.col("s.reason").alias("reason"), F.col("s.expiresAt").alias("expires_at"),
    )


def audit_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run metadata of every site below a root, whatever the folder depth."""
    return spark.read.schema(schemas.AUDIT_RUN).option("recursiveFileLookup", "true").json(root)


def gold(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A gold table; the run is a partition, so reading one run prunes the others."""
    df = spark.read.parquet(path)
    return df.filter(F.col("run_id") == run_id) if run_id is not None else df


def previous_run(runs: DataFrame) -> DataFrame:
    """The run before the latest of each site, from the run index: at most two rows per site are ranked."""
    w = W.partitionBy("site_id").orderBy(F.col("completed_at").desc(), F.col("run_id").desc())
    return runs.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").filter("rn = 2").drop("rn")


def artifact_files(spark: SparkSession, path: str) -> DataFrame:
    """Report artifacts as written files: path, bytes, sha256. Reports are small files by contract."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def artifact_manifest(artifacts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Manifest of artifact texts that an export profile selects. ``profiles``: profile, suffix (a small list)."""
    rows = artifacts.select(
        "*", F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1).alias("suffix"), F.octet_length("content").alias("bytes"),
        F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"),
    )
    return rows.join(profiles, "suffix").drop("content", "suffix")
