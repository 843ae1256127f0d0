"""JSON of strangers: keys that could change a prototype are dropped or found, at any depth.

Built-in functions read JSON of a known shape or its top level; the walk over
any shape is a small Arrow-batched helper, with a stack of its own, so that
nothing but the JSON reader bounds the depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Keys that are dropped.
DANGEROUS = ("__proto__", "constructor", "prototype", "__defineGetter__", "__defineSetter__", "__lookupGetter__", "__lookupSetter__")


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse(text: str | None):
    """(read, value); numbers that JSON does not have, broken texts and nulls are not read."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def _containers(value) -> Iterator:
    """The value and all objects and arrays in it; what is changed before the next step is seen changed."""
    stack = [value]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in (node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()) if isinstance(x, (dict, list))]


def cleaned(value):
    """``value`` without dangerous keys."""
    for node in _containers(value):
        if isinstance(node, dict):
            for key in DANGEROUS:
                node.pop(key, None)
    return value


def _clean_text(text: str | None) -> str | None:
    read, value = parse(text)
    return json.dumps(cleaned(value), ensure_ascii=False, separators=(",", ":")) if read else None


def _has(text: str | None) -> bool | None:
    read, value = parse(text)
    return any(isinstance(n, dict) and any(k in n for k in DANGEROUS) for n in _containers(value)) if read else None


@F.pandas_udf(StringType())
def safe_json(text: pd.Series) -> pd.Series:
    """The JSON without dangerous keys, in compact form; null where it cannot be read."""
    return text.map(_clean_text)


@F.pandas_udf(BooleanType())
def has_dangerous_keys(text: pd.Series) -> pd.Series:
    """Whether a dangerous key stands anywhere in the JSON; null where it cannot be read."""
    return text.map(_has).astype("object")


def safe_json_strict(text: Column, context: str) -> Column:
    """As :func:`safe_json`, but a text that cannot be read ends the job with an error that names ``context``."""
    out = safe_json(text)
    return F.when(text.isNotNull() & out.isNull(), F.raise_error(F.lit(f"JSON cannot be read in {context}")).cast("string")).otherwise(out)


def known_keys(config: Column, known: tuple[str, ...]) -> Column:
    """A map without the keys that a configuration does not know."""
    return F.map_filter(config, lambda k, _: k.isin(*known))
