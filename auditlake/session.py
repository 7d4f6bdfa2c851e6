"""Session defaults and the places where jobs may cut lineage or keep stream state."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "auditlake", master: str | None = None) -> SparkSession:
    """A session with the settings every job relies on; cluster submitters may override all of them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. On a local master, where driver and executors are one machine, a fresh
    temporary folder stands in for a missing setting; on a cluster its absence is an error, since executors would write
    to disks that nobody else reads."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if conf:
        if current is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="auditlake-ckpt-")
        spark.sparkContext.setCheckpointDir(made)
        return made
    return os.path.dirname(current.rstrip("/"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder, so a lost executor never loses the frontier."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table several consumers read (silver snapshots, site roll-ups) and reads it back.

    Parsing happens once, lineage ends at files in the shared folder, and the reader's size is known to the
    planner, so small roll-ups are broadcast by size and large ones are not."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
