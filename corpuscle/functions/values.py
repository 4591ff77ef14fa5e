"""Functions on JSON texts, arrays, vectors and times. JSON that can't be read is an empty array, never an error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def json_array(text) -> Column:
    """Strings of a JSON array; empty where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def topics(names, n: int = 5) -> Column:
    """The first ``n`` of an array, trimmed and in lower case, without those of under two characters."""
    return F.filter(F.transform(F.slice(names, 1, n), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 2)


def without(names, name) -> Column:
    return F.array_remove(names, name)


def any_contains(names, part: str) -> Column:
    """Whether some element holds ``part``, in any case."""
    return F.exists(names, lambda x: F.contains(F.lower(x), F.lit(part.lower())))


def json_object(**fields) -> Column:
    """A JSON object of the columns given; nulls stay out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def rfc3339(text) -> Column:
    """The moment an external listing's time states, in UTC; null if it states none."""
    return F.try_to_timestamp(text)


def drifted(cached, listed) -> Column:
    """Whether the other side is newer, or nothing is known here."""
    return cached.isNull() | F.coalesce(listed > cached, F.lit(False))


def alive(created, now, seconds) -> Column:
    """Whether something that lives ``seconds`` still does."""
    return F.unix_timestamp(now) - F.unix_timestamp(created) <= seconds


def link_seconds(asked) -> Column:
    """How long a signed link lives: a minute to an hour."""
    return F.greatest(F.lit(60), F.least(F.lit(3600), asked))


@F.pandas_udf(BinaryType())
def vector_bytes(vector: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats."""
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def bytes_vector(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))
