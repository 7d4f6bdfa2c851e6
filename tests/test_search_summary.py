"""Search rows in one line per site, and names that a later definition of the same module would hide."""

import ast
from pathlib import Path

from auditlake.operators import fielddata as fd
from auditlake.plans import all_queries  # noqa: F401
from auditlake.plans.registry import QUERIES


def test_search_summary_weighs_positions_by_impressions(spark):
    rows = spark.createDataFrame(
        [("s", 1, 30, 2), ("s", 2, 10, 4), ("t", None, 0, 9), ("u", 1, 8, None)], "site_id string, clicks long, impressions long, position long"
    )
    assert {tuple(r) for r in fd.search_summary(rows, ["site_id"]).collect()} == {("s", 3, 40, 0.075, 2.5), ("t", None, 0, None, None), ("u", 1, 8, 0.125, None)}


def test_f13_sums_line_items(spark, tmp_path):
    spark.createDataFrame(
        [(7, 1, 1, 2, 30.0, 0.01), (7, 2, 2, 1, 10.0, 0.03), (8, 1, 3, 4, 5.0, 0.0)],
        "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_discount double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["F13_search_totals"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in out} == {("https://s7.example", 3, 40, 0.075, 2.5), ("https://s8.example", 4, 5, 0.8, 1.0)}


def test_no_module_defines_a_name_twice():
    for path in (Path(__file__).parent.parent / "auditlake").rglob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path
