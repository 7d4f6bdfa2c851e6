"""Streams over several triggers: late rows, restarts, repeated batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from auditlake.streaming import jobs

EVENTS = "site_id string, metric string, value double, ts timestamp"
T0 = datetime(2024, 1, 1, 10)


def put(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_state_survives_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    hour = lambda h, v: ("s", "LCP", float(v), T0 + timedelta(hours=h))
    run = lambda: jobs.run_to_parquet(jobs.hourly_vitals(jobs.event_stream(spark, src, "*.parquet", EVENTS)), out, state)
    put(spark, src, [hour(0, v) for v in (1, 2, 3, 4)] + [hour(1.5, 9)])
    run()
    put(spark, src, [hour(0.5, 100), hour(4, 5)])
    run()
    put(spark, src, [hour(0.9, 1000), hour(9, 6)])
    run()
    got = {r.hour: (r.samples, r.p75) for r in spark.read.parquet(out).collect()}
    assert got[T0] == (5, 4.0)
    assert got[T0 + timedelta(hours=1)] == (1, 9.0) and got[T0 + timedelta(hours=4)] == (1, 5.0)
    assert T0 + timedelta(hours=9) not in got


def test_latest_runs_over_batches(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "target_url string, scan_id string, completed_at timestamp, score long"
    run = lambda: jobs.latest_runs(jobs.event_stream(spark, src, "*.parquet", schema), out, state)
    put(spark, src, [("a", f"s{i}", T0 + timedelta(days=i), i) for i in range(5)], schema)
    run()
    put(spark, src, [("a", "s9", T0 + timedelta(days=9), 50), ("b", "t1", T0, 7), ("a", "old", T0 - timedelta(days=9), 1)], schema)
    run()
    rows = {r.target_url: r for r in jobs.read_latest_runs(spark, out).collect()}
    assert (rows["a"].latest_scan, rows["a"].latest_score, rows["a"].previous_score, rows["a"].runs) == ("s9", 50, 4, 7)
    assert (rows["b"].latest_score, rows["b"].previous_score, rows["b"].runs) == (7, None, 1)


def test_session_gap(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "user_id long, event_type string, ts timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    put(spark, src, [(1, "view", at(0)), (1, "error", at(20)), (1, "view", at(49)), (1, "view", at(90)), (2, "view", at(600))], schema)
    jobs.run_to_parquet(jobs.sessions(jobs.event_stream(spark, src, "*.parquet", schema)), out, state)
    got = sorted((r.user_id, r.started, r.n_events, r.n_errors) for r in spark.read.parquet(out).select("user_id", "started", "n_events", F.col("n_errors")).collect())
    assert got == [(1, at(0), 3, 1), (1, at(90), 1, 0)]


def test_compaction_bounds_what_a_read_opens(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "target_url string, scan_id string, completed_at timestamp, score long"
    everything = []
    for i in range(9):
        rows = [("a", f"s{i}", T0 + timedelta(days=i * 7 % 5, hours=i), i), (f"t{i % 2}", f"u{i}", T0 - timedelta(days=i), 10 * i)]
        everything += rows
        put(spark, src, rows, schema)
        jobs.latest_runs(jobs.event_stream(spark, src, "*.parquet", schema), out, state, compact_every=2)
        assert len(jobs._state(spark, out)) <= 2
    assert len(jobs._batches(spark, out, "base")) <= 2 and len(jobs._batches(spark, out, "batch")) <= 5
    got = {r.target_url: (r.latest_scan, r.latest_score, r.previous_score, r.runs) for r in jobs.read_latest_runs(spark, out).collect()}
    for target in ("a", "t0", "t1"):
        mine = sorted((r for r in everything if r[0] == target), key=lambda r: (r[2], r[1]), reverse=True)
        assert got[target] == (mine[0][1], mine[0][3], mine[1][3], len(mine))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The stream's own log forgets the last batch, as after a driver lost between the write and the commit."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "target_url string, scan_id string, completed_at timestamp, score long"
    run = lambda: jobs.latest_runs(jobs.event_stream(spark, src, "*.parquet", schema), out, state, compact_every=2)
    for i in range(3):
        put(spark, src, [("a", f"s{i}", T0 + timedelta(days=i), i)], schema)
        run()
        want = jobs.read_latest_runs(spark, out).collect()
        for name in (str(i), f".{i}.crc"):
            (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
        run()
        assert jobs.read_latest_runs(spark, out).collect() == want and want[0].runs == i + 1


def test_sketches_roll_up(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = EVENTS + ", release string"
    value = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, float("nan")).otherwise((F.col("id") * 7919 % 200_003).cast("double"))
    rows = spark.range(200_000).select(
        F.lit("s").alias("site_id"), F.lit("LCP").alias("metric"), value.alias("value"),
        F.timestamp_seconds(F.col("id") % 172_800 + 1_704_067_200).alias("ts"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("release"),
    )
    rows.write.parquet(src)
    put(spark, src, [("s", "LCP", 1.0, T0 + timedelta(days=9), "r0")], schema)
    jobs.run_to_parquet(jobs.hourly_sketches(jobs.event_stream(spark, src, "*.parquet", schema), dims=("release",), k=200), out, state)
    kept = [(r.release, r.value) for r in rows.filter("value is not null and not isnan(value)").collect()]
    stored = spark.read.parquet(out)
    assert stored.count() == 48 * 3
    for keys, groups in ((["release"], ("r0", "r1", "r2")), (["site_id"], ("s",))):
        for r in jobs.vitals_of(stored, keys, {"p50": 0.5, "p95": 0.95}, k=200).collect():
            values = sorted(v for release, v in kept if keys == ["site_id"] or release == r.release)
            assert r[0] in groups and r.samples == len(values)
            for name, p in (("p50", 0.5), ("p95", 0.95)):
                rank = sum(v <= r[name] for v in values) / len(values)
                # Twice the bound of one sketch leaves room for merging.
                assert abs(rank - p) <= 2 * jobs.rank_error(200)


def test_hourly_values_roll_up_exactly(spark, tmp_path):
    """Far more samples per group than a sketch keeps; late rows go, null values count as samples only."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    n = 60_000
    rows = spark.range(n).select(
        F.lit("s").alias("site_id"), F.when(F.col("id") % 3 > 0, "LCP").otherwise("INP").alias("metric"),
        F.when(F.col("id") % 101 > 0, (F.col("id") * 7919 % 60_013) / 7).alias("value"), F.timestamp_seconds(F.col("id") % 172_800 + 1_704_067_200).alias("ts"),
    )
    rows.write.parquet(src)
    put(spark, src, [("s", "CLS", None, T0 - timedelta(days=1))])
    run = lambda: jobs.run_to_parquet(jobs.hourly_values(jobs.event_stream(spark, src, "*.parquet", EVENTS)), out, state)
    put(spark, src, [("s", "LCP", 1.0, T0 + timedelta(days=9))])
    run()
    put(spark, src, [("s", "LCP", 1e9, T0)])
    run()
    kept = [(r.metric, r.value) for r in rows.collect()]
    wanted = {"p50": 0.5, "p75": 0.75, "p95": 0.95}
    got = {r.name: r for r in jobs.exact_vitals_of(spark.read.parquet(out), {"name": "metric"}, wanted).collect()}
    assert set(got) == {"LCP", "INP", "CLS"} and got["CLS"].samples == 1 and got["CLS"].p75 is None
    for metric in ("LCP", "INP"):
        values = sorted(v for m, v in kept if m == metric and v is not None)
        assert got[metric].samples == sum(m == metric for m, _ in kept)
        for name, p in wanted.items():
            assert got[metric][name] == values[-(-len(values) * int(p * 100) // 100) - 1]
