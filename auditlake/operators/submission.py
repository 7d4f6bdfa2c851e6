"""Checked batches of URLs for a submission interface; sending them is not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls as u
from auditlake.operators.ranking import ranked


def submission_batches(urls: DataFrame, *, batch_size: int = 10_000, buckets: int = 4096) -> DataFrame:
    """Distinct URLs on their approved host, numbered into batches; a giant host is numbered bucket by bucket."""
    rows = (
        urls.select("approved_host", u.normalize_url(F.col("url")).alias("url"))
        .filter(u.hostname(F.col("url")) == F.col("approved_host"))
        .distinct()
    )
    placed = ranked(rows, ["approved_host"], F.pmod(F.xxhash64("url"), F.lit(buckets)), [F.col("url")], "position")
    return placed.select("approved_host", "url", F.floor((F.col("position") - 1) / batch_size).alias("batch"))


def valid_key(key: Column) -> Column:
    """Shape of a submission key."""
    return key.rlike("^[A-Za-z0-9-]{8,128}$")
