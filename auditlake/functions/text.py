"""Slugs and other small text shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word edge in the ASCII sense, which this JVM's own \\b does not have.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with its word edges taken in the ASCII sense."""
    return pattern.replace(r"\b", EDGE)


def slugify(text: Column) -> Column:
    """Lower-case, everything but letters and digits becomes one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def site_slug(text: Column, limit: int = 80) -> Column:
    """Slug of a site name; common Latin accents are folded first."""
    folded = F.translate(F.lower(text), "áàâäéèêëíîïóôöúûüçñ", "aaaaeeeeiiiooouuucn")
    return F.substring(slugify(folded), 1, limit)
