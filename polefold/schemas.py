"""Schemas of the engine's long-format tables, and the check made on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "angle": "a int, theta double, subset int, fitted boolean",
    "coef": "k int, p int, v double",
    "data": "a int, y int, j int, b double",
    "radon": "a int, y int, p int, w double",
    "sino": "a int, y int, k int, v double",
    "pf": "a int, k int, j int, v double",
    "orientation": "k int, qx double, qy double, qz double, qw double, sigma double",
    "symop": "g int, qx double, qy double, qz double, qw double",
    "reflection": "h int, k int, l int, mult int, d double, q double, two_theta double, f2 double, intensity double",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[name])


def assert_schema(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it has the table's columns with castable types; raises otherwise."""
    have = dict(df.dtypes)
    for field in schema(name):
        if field.name not in have:
            raise ValueError(f"{name}: column {field.name} is missing")
        kind = field.dataType.simpleString()
        if have[field.name] != kind and not (kind == "double" and have[field.name] in ("float", "int", "bigint", "double")) and not (kind == "int" and have[field.name] in ("int", "bigint")):
            raise ValueError(f"{name}.{field.name}: {have[field.name]} is not {kind}")
    return df
