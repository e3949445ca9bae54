"""Schemas from DDL without a session, so that modules can be imported anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType, "int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


def data_type(text: str) -> T.DataType:
    text = text.strip()
    if text in _SIMPLE:
        return _SIMPLE[text]()
    kind, _, inner = text.partition("<")
    inner = inner.rpartition(">")[0]
    if kind == "array":
        return T.ArrayType(data_type(inner))
    if kind == "map":
        return T.MapType(*(data_type(p) for p in _split(inner)))
    if kind == "struct":
        return struct(inner)
    raise ValueError(f"no type: {text}")


def struct(text: str) -> T.StructType:
    """Fields as `name type` or `name: type`."""
    out = T.StructType()
    for part in _split(text):
        name, _, kind = part.partition(" ")
        out = out.add(name.rstrip(":"), data_type(kind))
    return out
