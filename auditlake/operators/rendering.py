"""Raw against rendered page facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARED = {"title": "title", "meta_description": "metaDescription", "canonical": "canonical", "h1": "h1"}
WORD_DIFF = 25


def _changed(raw: str, rendered: str, columns: list[str]) -> Column:
    tests = [
        F.when(~F.col(f"{raw}.{c}").eqNullSafe(F.col(f"{rendered}.{c}")), F.lit(label))
        for c, label in COMPARED.items()
        if c in columns
    ]
    words = F.when(
        F.abs(F.col(f"{raw}.word_count") - F.col(f"{rendered}.word_count")) > WORD_DIFF, F.lit("wordCount")
    )
    return F.array_compact(F.array(*tests, words))


def render_diff(raw: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that differ between the raw and the rendered page, and the risk flag."""
    joined = raw.alias("a").join(rendered.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    out = joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], _changed("a", "b", rendered.columns).alias("changed"))
    return out.withColumn("hydration_risk", F.size("changed") > 0)


def render_diff_report(raw: DataFrame, rendered: DataFrame, keys: list[str], *, render_always: bool) -> DataFrame:
    """Per page the diff where it was rendered, else the guess from raw text: almost no words and no internal link."""
    joined = raw.alias("a").join(rendered.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "left")
    seen = F.col(f"b.{keys[0]}").isNotNull()
    guess = (F.col("a.word_count") < 30) & (F.size("a.internal_links") == 0)
    return joined.select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.when(seen, "rendered").otherwise("raw_only").alias("basis"),
        F.when(seen, F.size(_changed("a", "b", rendered.columns)) > 0)
        .otherwise(F.lit(True) if render_always else guess)
        .alias("hydration_risk"),
    )


def raw_fallback(raw: DataFrame, rendered: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A failed render takes the raw value of each field."""
    joined = raw.alias("a").join(rendered.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return joined.select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        *[F.when(F.col("b.failed"), F.col(f"a.{f}")).otherwise(F.col(f"b.{f}")).alias(f) for f in fields],
    )
