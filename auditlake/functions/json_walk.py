"""Walks over arbitrary nested JSON: the one thing column expressions cannot express.

Each is an Arrow-batched function over text; the recursion is a few lines per document."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Executors need no copy of the package for these few helpers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
STRINGS = ArrayType(StringType())

# Words that mark a tool as changing state.
MUTATING_TERMS = [
    "create",
    "update",
    "delete",
    "remove",
    "write",
    "mutate",
    "checkout",
    "payment",
    "purchase",
    "refund",
    "cancel",
    "send",
]


def walk(node) -> Iterator[dict]:
    """Every object of a document, outer before inner, in document order."""
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield item
            stack.extend(reversed(list(item.values())))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def _reject(constant):
    raise ValueError(constant)


def _load(text):
    try:
        return json.loads(text, parse_constant=_reject)
    except (TypeError, ValueError):
        return None


def _types(texts) -> list[str] | None:
    if texts is None:
        return None
    found: dict[str, None] = {}
    for text in texts:
        for obj in walk(_load(text)):
            value = obj.get("@type")
            for entry in value if isinstance(value, list) else [value]:
                if isinstance(entry, str):
                    found[entry] = None
    return list(found)


def _risky(text) -> list[str] | None:
    if text is None:
        return None
    found: dict[str, None] = {}
    for obj in walk(_load(text)):
        name = next((obj[k] for k in ("name", "id", "title") if isinstance(obj.get(k), str)), None)
        about = next((obj[k] for k in ("description", "summary") if isinstance(obj.get(k), str)), "")
        if name and any(term in f"{name} {about}".lower() for term in MUTATING_TERMS):
            found[name] = None
    return list(found)


@F.pandas_udf(STRINGS)
def json_types(blocks: pd.Series) -> pd.Series:
    """Distinct "@type" values at any depth over an array of JSON texts."""
    return blocks.map(_types)


@F.pandas_udf(STRINGS)
def risky_tool_names(texts: pd.Series) -> pd.Series:
    """Distinct names of described tools whose text mentions a state change."""
    return texts.map(_risky)


@F.pandas_udf(STRINGS)
def json_keys(texts: pd.Series) -> pd.Series:
    """Distinct object keys at any depth of one JSON text; key tests then stay column expressions."""
    return texts.map(lambda t: None if t is None else list(dict.fromkeys(k for o in walk(_load(t)) for k in o)))
