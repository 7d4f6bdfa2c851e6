"""Short keys for grouping findings: rule texts that are those of the catalogue travel as one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.numeric import lookup, rank_case

#: Columns that :func:`coded` leaves in place of the given ones.
KEY = ["_code", "_own"]
_ENUMS = {
    "severity": dims.SEVERITIES, "fix_class": ["safe_auto_fix", "approval_required", "manual_strategy", "not_applicable"],
    "effort": ["small", "medium", "large"], "risk": ["low", "medium", "high"], "status": ["open", "warning", "passed", "not_applicable"],
}
_BASE = 8


def _texts(column: str) -> Column:
    return F.array(*[F.lit(r[column]) for r in dims.EMITTED])


def coded(findings: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces ``columns`` (rule_id, and texts or enums of a rule) by ``_code``, or by ``_own`` in rows whose texts aren't
    those of the catalogue: exactly one of them is set, and equal values give equal keys."""
    c = F.col
    texts, enums = [x for x in columns if x != "rule_id" and x not in _ENUMS], [x for x in columns if x in _ENUMS]
    known, code = c("_place").isNotNull(), c("_place")
    for x in texts:
        known = known & (c(x) == F.get(_texts(x), c("_place")))
    for x in enums:
        known, code = known & c(x).isin(_ENUMS[x]), code * _BASE + rank_case(c(x), _ENUMS[x])
    placed = findings.withColumn("_place", lookup(c("rule_id"), {r["rule_id"]: i for i, r in enumerate(dims.EMITTED)}))
    keyed = placed.withColumn("_code", F.when(known, code))
    return keyed.withColumn("_own", F.when(c("_code").isNull(), F.struct(*columns))).drop("_place", *columns)


def decoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of :func:`coded` again."""
    c, rest, back = F.col, F.col("_code"), {}
    for x in reversed([x for x in columns if x in _ENUMS]):
        back[x] = F.get(F.array(*[F.lit(v) for v in _ENUMS[x]]), rest % _BASE)
        rest = F.floor(rest / _BASE).cast("int")
    for x in columns:
        if x not in _ENUMS:
            back[x] = F.get(_texts(x), rest)
    return rows.withColumns({x: F.coalesce(back[x], c("_own")[x]) for x in columns}).drop(*KEY)


def short_url(url: Column, site: Column) -> Column:
    """A URL below its site without the site, any other one marked; :func:`long_url` gives it back."""
    rest = F.substring(url, F.length(site) + 1, F.length(url))
    return F.when(url.startswith(site), F.concat(F.lit("/"), rest)).otherwise(F.concat(F.lit("u"), url))


def long_url(short: Column, site: Column) -> Column:
    rest = F.substring(short, F.lit(2), F.length(short))
    return F.when(short.startswith("/"), F.concat(site, rest)).otherwise(rest)
