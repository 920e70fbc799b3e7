"""Options, schemas and checks of the vector index."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine")
CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("node_id", T.LongType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Config:
    """M: edges a node (twice on layer 0); ef_*: beam widths; the rest routes filtered searches."""

    M: int = 16
    ef_construction: int = 100
    ef_search: int = 50
    metric: str = "l2"
    heuristic: bool = True
    keep_pruned_connections: bool = True
    seed: int = 42
    filter_fallback_threshold: int = 2000

    def __post_init__(self):
        if self.M < 2:
            raise ValueError("M must be 2 or more")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")

    @property
    def m_L(self) -> float:
        return 1 / math.log(self.M)


def check_filter(spec: Mapping | None) -> dict:
    """A filter names fields and the scalar that each must equal; nothing named filters nothing.  All that is wrong is said at once."""
    given = {} if spec is None else spec
    if not isinstance(given, Mapping):
        raise ValueError(f"filter: pairs of field and value are wanted, not {type(spec).__name__}")
    wrong = [f"{k!r} is no field name" for k in given if not isinstance(k, str) or k.isspace() or not k]
    wrong += [f"{k!r} = {v!r} is no scalar" for k, v in given.items() if not isinstance(v, str | float | int)]
    if wrong:
        raise ValueError("filter: " + "; ".join(wrong))
    return dict(given)


def tagged(value) -> str | None:
    """A metadata value as text that keeps its kind: equal numbers and booleans are equal, and never equal a string."""
    if isinstance(value, (bool, int, float)):
        return f"n:{float(value)!r}"
    return f"s:{value}" if isinstance(value, str) else None


def dim_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has another dimension, or a null or non-finite component."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vectors.where(F.col("embedding").isNull() | (F.size("embedding") != dim) | F.coalesce(bad, F.lit(True)))
