"""Structured Streaming twins of the batch jobs: RUM percentiles, latest run per target, visit sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlake.operators.ranking import nearest_ranks, top_k

#: Size of the sketches of values: exact up to so many samples, a rank is off by 0.13 percent beyond.
SKETCH_K = 4096
#: Rows that the values of one site, metric and hour are kept in.
VALUE_PARTS = 8


def event_stream(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream; new files are picked up by later triggers."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def hourly_vitals(events: DataFrame, *, late: str = "2 hours", window: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """p75 and sample count per site, metric and hour. The percentile is a mergeable sketch: its state is bounded
    by the accuracy, and it is exact while a group holds fewer values than that."""
    return (
        events.withWatermark("ts", late)
        .groupBy("site_id", "metric", F.window("ts", window))
        .agg(F.count("*").alias("samples"), F.percentile_approx("value", 0.75, accuracy).alias("p75"))
        .select("site_id", "metric", F.col("window.start").alias("hour"), "samples", "p75")
    )


def hourly_sketches(events: DataFrame, *, late: str = "2 hours", window: str = "1 hour", dims: tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """One KLL sketch of the values per site, metric, hour and ``dims`` (a release, a device): samples, sketch.

    Sketches merge, so :func:`vitals_of` answers for days, sites or releases without the events. A group takes at most some
    tens of kilobytes; its values are exact until there are more than ``k``, then a rank is off by :func:`rank_error`."""
    kept = events.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return (
        kept.withWatermark("ts", late)
        .groupBy("site_id", "metric", *dims, F.window("ts", window))
        .agg(F.count("*").alias("samples"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
        .select("site_id", "metric", *dims, F.col("window.start").alias("hour"), "samples", "sketch")
    )


def vitals_of(sketches: DataFrame, keys: list, percentiles: dict[str, float], *, k: int = SKETCH_K) -> DataFrame:
    """Samples and percentiles per ``keys`` (columns or expressions of stored sketches). Sketches merge map-side first, so a
    group of a third of all sketches sends one sketch per task."""
    merged = sketches.groupBy(*keys).agg(F.sum("samples").alias("samples"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    picked = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in percentiles.items()]
    return merged.select("*", *picked).drop("sketch")


def hourly_values(events: DataFrame, *, late: str = "2 hours", window: str = "1 hour", dims: tuple[str, ...] = (), parts: int = VALUE_PARTS) -> DataFrame:
    """All values per site, metric, hour and ``dims``, for percentiles that must be exact over any roll-up: samples, values.

    A value takes eight bytes in the state instead of a row, and the values of a busy hour are spread over ``parts`` rows."""
    kept = events.filter(F.col("value").isNull() | ~F.isnan("value"))
    return (
        kept.withWatermark("ts", late)
        .groupBy("site_id", "metric", *dims, F.window("ts", window), F.pmod(F.xxhash64("value"), F.lit(parts)).alias("part"))
        .agg(F.count("*").alias("samples"), F.collect_list("value").alias("values"))
        .select("site_id", "metric", *dims, F.col("window.start").alias("hour"), "samples", "values")
    )


def exact_vitals_of(hours: DataFrame, keys: dict[str, Column | str], percentiles: dict[str, float]) -> DataFrame:
    """Samples and nearest-rank percentiles per ``keys`` (name and column or expression) of stored hourly values. Values are
    counted map-side and ranked by bucket, so no task holds a whole group."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in keys.items()]
    samples = hours.groupBy(*named).agg(F.sum("samples").alias("samples"))
    values = hours.select(*named, F.explode("values").alias("value"))
    same = [samples[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranks = nearest_ranks(values, list(keys), "value", percentiles).withColumnsRenamed({k: f"_{k}" for k in keys})
    return samples.join(ranks, same, "left").select(*keys, "samples", *percentiles)


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the samples by which a rank may be off, with 99 percent confidence, as the sketch library states it."""
    return 2.296 / k**0.9021


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Visit sessions per user with their errors."""
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap))
        .agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
        .select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n_events", "n_errors")
    )


def run_to_parquet(df: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there, then stops; exactly-once through the checkpoint and the sink's own log."""
    query: StreamingQuery = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _firsts(rows: DataFrame) -> DataFrame:
    """Latest two runs of every target with the number of its runs, from rows that each stand for ``n_runs`` runs."""
    order = [F.col("completed_at").desc(), F.col("scan_id").desc()]
    counts = rows.groupBy("target_url").agg(F.sum("n_runs").alias("n_runs"))
    return top_k(rows.drop("n_runs"), ["target_url"], order, 2).join(counts, "target_url").withColumn(
        "n_runs", F.when(F.col("rank") == 1, F.col("n_runs")).otherwise(F.lit(0))
    )


def _batches(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind below ``out``. A folder is finished when its _SUCCESS file is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("-")[1]) for f in found or [])


def _state(spark: SparkSession, out: str, until: int | None = None) -> list[str]:
    """The last base and the batches after it: all that a read needs."""
    upto = lambda n: until is None or n <= until
    bases = [n for n in _batches(spark, out, "base") if upto(n)]
    after = bases[-1] if bases else -1
    paths = [f"{out}/base-{after}"] if bases else []
    return paths + [f"{out}/batch-{n}" for n in _batches(spark, out, "batch") if upto(n) and n > after]


def _drop_before(spark: SparkSession, out: str, kept: int) -> None:
    """Removes what bases from ``kept`` on have taken in; readers of the base before the last still find their files."""
    for kind, bound in (("base", kept), ("batch", kept + 1)):
        for n in _batches(spark, out, kind):
            if n < bound:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}-{n}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest_runs(runs: DataFrame, out: str, checkpoint: str, *, compact_every: int = 8) -> None:
    """Keeps the latest two runs of every target and the number of its runs.

    Each micro-batch writes its own latest two under its own folder; writing a batch again overwrites that folder, so a retry
    changes nothing. Every ``compact_every`` batches the last base and the batches since become a new base, so a read opens
    ``compact_every`` folders at most, however long the stream has run, and files of older bases go. A base that is finished
    is never written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bases = _batches(spark, out, "base")
        if bases and bases[-1] >= batch_id:
            return
        _firsts(batch.withColumn("n_runs", F.lit(1).cast("long"))).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")
        if (batch_id + 1) % compact_every == 0:
            rows = spark.read.parquet(*_state(spark, out, batch_id)).drop("rank")
            _firsts(rows).write.mode("overwrite").parquet(f"{out}/base-{batch_id}")
            if bases:
                _drop_before(spark, out, bases[-1])

    runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest_runs(spark: SparkSession, out: str) -> DataFrame:
    """Latest and previous run per target over all batches, with the run count."""
    two = _firsts(spark.read.parquet(*_state(spark, out)).drop("rank"))
    pick = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    latest = two.groupBy("target_url").agg(
        pick(1, "scan_id").alias("latest_scan"), pick(1, "score").alias("latest_score"), pick(2, "score").alias("previous_score"),
        F.sum("n_runs").alias("runs"),
    )
    return latest.withColumn("score_delta", F.col("latest_score") - F.col("previous_score"))
