"""Writers: JSONL, quoted CSV, partitioned gold tables, the run index and the append-only ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def quoted_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, header in each file."""
    df.write.mode("overwrite").option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def gold(df: DataFrame, path: str, *, files_per_run: int | None = None) -> None:
    """Gold table partitioned by run; writing a run replaces that run and leaves the others. Rows of a site lie together because files are range-clustered by site.

    A site may be a third of the table, so it is clustered by (run, site, a hash of the whole row's order key)
    and may span many files."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c in ("rule_id", "ord", "url", "page_id")]), F.lit(64)) if any(
        c in df.columns for c in ("rule_id", "ord", "url", "page_id")
    ) else F.lit(0)
    cols = ["run_id", "site_id", spread]
    placed = df.repartitionByRange(files_per_run, *cols) if files_per_run else df.repartitionByRange(*cols)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def upsert_runs(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """Run index where an incoming run replaces the one with its scan id: latest completion wins, and the indexed run stays
    where both completed at the same time. Max combined map-side."""
    rows = index.withColumn("_indexed", F.lit(True)).unionByName(incoming.withColumn("_indexed", F.lit(False)))
    others = [c for c in index.columns if c not in ("scan_id", "completed_at")]
    best = rows.groupBy("scan_id").agg(F.max(F.struct("completed_at", "_indexed", *others)).alias("r"))
    return best.select("scan_id", *[F.col(f"r.{c}").alias(c) for c in ("completed_at", *others)])


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
