"""Gold tables of runs, committed together.

Layout below a root: ``data/commit=<id>/table=<name>/*.parquet`` and one small file per finished commit in ``commits``.
A commit's rows are written by several jobs; nobody sees them before its file is there, so a job that fails half-way leaves
nothing to read. A run (site_id, run_id) belongs to the last commit that names it, with all its tables: rows of an earlier commit
don't come through, even where the later one has none. A commit has rows of the runs that it names only. Site and run are never null."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.session import materialise

RUN = ["site_id", "run_id"]
RUNS = "run"
MANIFEST = "commit string, schemas map<string,string>"


def new_commit() -> str:
    """Id of a commit; later ids sort behind earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _body(schema: StructType) -> StructType:
    return StructType([f for f in schema if f.name not in RUN])


def placed(rows: DataFrame) -> DataFrame:
    """Rows as the store lays them. The rebalance puts a site's run into files of the advisory size: small ones share a task, a
    hot one spreads over many. Rows lie by run and site inside a file, so a reader of one skips most pages."""
    return rows.hint("rebalance", *RUN).sortWithinPartitions("run_id", "site_id")


def add(root: str, commit: str, tables: dict[str, DataFrame], *, lying: Iterable[str] = ()) -> None:
    """Writes tables (each with site_id and run_id) into an open commit, every one into its folder.

    Tables named in ``lying`` are written by the tasks that have their rows, without an exchange or a sort: for rows that are
    placed already, or derived from placed ones. A folder has no folders of runs, so a task writes one file however many runs it
    has."""
    for name, df in tables.items():
        rows = df.select(*RUN, F.struct(*[F.col(f.name) for f in _body(df.schema)] or [F.lit(True).alias("here")]).alias(name))
        rows = rows if name in lying else placed(rows)
        rows.write.mode("append").parquet(f"{root}/data/commit={commit}/table={name}")


def finish(root: str, commit: str, runs: DataFrame, schemas: dict[str, StructType]) -> None:
    """Makes a commit visible: its runs are written beside its tables, then one file names it."""
    add(root, commit, {RUNS: runs.select(*RUN).distinct()})
    row = [(commit, {name: _body(schema).json() for name, schema in schemas.items()})]
    runs.sparkSession.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/commits")


def commit_tables(root: str, runs: DataFrame, tables: dict[str, DataFrame], *, lying: Iterable[str] = ()) -> str:
    """All tables of the given runs as one commit."""
    commit = new_commit()
    add(root, commit, tables, lying=lying)
    finish(root, commit, runs, {name: df.schema for name, df in tables.items()})
    return commit


def _read(spark: SparkSession, root: str, name: str, body: StructType, commits: list[str]) -> DataFrame:
    body = body if len(body) else StructType().add("here", "boolean")
    schema = StructType().add("site_id", "string").add("run_id", "string").add(name, body).add("commit", "string")
    paths = [f"{root}/data/commit={c}/table={name}" for c in commits]
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths)


def written(spark: SparkSession, root: str, commit: str, name: str, schema: StructType) -> DataFrame:
    """A table of a commit that is still open, for the tables that are derived from it."""
    rows = _read(spark, root, name, _body(schema), [commit])
    return rows.select(*[F.col(f.name) if f.name in RUN else F.col(name)[f.name].alias(f.name) for f in schema])


def commits(spark: SparkSession, root: str) -> list:
    """Finished commits in order, one short row each."""
    return spark.read.schema(MANIFEST).json(f"{root}/commits").orderBy("commit").collect()


def _standing(spark: SparkSession, root: str, done: list) -> tuple[DataFrame, DataFrame | None] | None:
    """Which rows stand: the (commit, run_id) whose runs all belong to the commit still, and the runs that stand of those which
    belong to it in part (None where there are none). None where all rows stand.

    Both come from the names of the runs, never from table rows, and are written first, so the planner knows their size."""
    if len(done) < 2:
        return None
    last = F.max("commit").over(W.partitionBy(*RUN))
    named = _read(spark, root, RUNS, StructType(), [c.commit for c in done]).select(*RUN, "commit", (last == F.col("commit")).alias("stands"))
    states = named.groupBy("commit", "run_id").agg(F.bool_and("stands").alias("whole"), F.bool_or("stands").alias("some"))
    states = materialise(states, "gold-states")
    if states.filter("NOT whole").isEmpty():
        return None
    parts = states.filter("some AND NOT whole").select("commit", "run_id")
    runs = None if parts.isEmpty() else materialise(named.filter("stands").join(parts, ["commit", "run_id"], "left_semi").drop("stands"), "gold-runs")
    return states.filter("whole").select("commit", "run_id"), runs


def tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Gold tables over all committed runs. Columns are those of the last commit that has the table; older files lack new columns
    and give nulls. A filter on run_id or site_id skips pages.

    Rows of commits whose runs with the same run_id were replaced together, or not at all, are told by a few (commit, run_id)
    and stay in their tasks. Only where some sites of a run_id were replaced are rows joined with the runs that stand."""
    done, out = commits(spark, root), {}
    standing = _standing(spark, root, done)
    for name in names:
        having = [c for c in done if name in c.schemas]
        if not having:
            raise ValueError(f"no commit below {root} has a table {name}")
        body = StructType.fromJson(json.loads(having[-1].schemas[name]))
        rows = _read(spark, root, name, body, [c.commit for c in having])
        if standing is not None:
            whole, runs = standing
            kept = rows.join(whole, ["commit", "run_id"], "left_semi")
            rows = kept if runs is None else kept.unionByName(rows.join(runs, [*RUN, "commit"], "left_semi"))
        out[name] = rows.select(*RUN, *[F.col(name)[f.name].alias(f.name) for f in body])
    return out


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the gold :func:`tables`."""
    return tables(spark, root, [name])[name]
