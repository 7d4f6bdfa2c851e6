"""The run index under upserts."""

from datetime import datetime

from auditlake.sources import sinks

SCHEMA = "scan_id string, completed_at timestamp, score long"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_an_indexed_run_stays_unless_the_incoming_one_is_later(spark):
    index = spark.createDataFrame([("tie", T0, 5), ("tie-high", T0, 50), ("older", T1, 6), ("newer", T0, 7), ("kept", T0, 8)], SCHEMA)
    incoming = spark.createDataFrame([("tie", T0, 9), ("tie-high", T0, 1), ("older", T0, 99), ("newer", T1, 1), ("added", T0, 2)], SCHEMA)
    out = sinks.upsert_runs(index, incoming)
    assert out.columns == ["scan_id", "completed_at", "score"]
    assert {tuple(r) for r in out.collect()} == {
        ("tie", T0, 5), ("tie-high", T0, 50), ("older", T1, 6), ("newer", T1, 1), ("kept", T0, 8), ("added", T0, 2),
    }
