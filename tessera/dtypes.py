"""NumPy element types and the Spark types that hold them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK_TYPES = {
    "bool": "boolean",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float16": "float",
    "float32": "float",
    "float64": "double",
}
FROM_SPARK = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def spark_type(dtype) -> str:
    try:
        return SPARK_TYPES[np.dtype(dtype).name]
    except KeyError:
        raise TypeError(f"arrays of {dtype} are not supported") from None


def from_spark(name: str) -> np.dtype:
    return np.dtype("uint64" if name.startswith("decimal") else FROM_SPARK[name])


def to_type(column: Column, dtype) -> Column:
    """A column of numbers that are known to fit, in the Spark type of ``dtype``."""
    return column.cast(spark_type(dtype))


def zero(dtype) -> object:
    return np.zeros(1, dtype)[0]


def literal(value, dtype) -> Column:
    """``value`` (None: masked) as a column of the Spark type of ``dtype``."""
    if value is None:
        return F.lit(None).cast(spark_type(dtype))
    kind = np.dtype(dtype).kind
    if kind == "b":
        return F.lit(bool(value))
    if kind in "iu":
        return F.lit(str(int(value))).cast(spark_type(dtype))
    return F.lit(float(value)).cast(spark_type(dtype))
