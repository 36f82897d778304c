"""The loan table's column contract as a Spark schema.

71 columns, parsed once on the driver. Flags ride on ``StructField.metadata``
so that operators ask the schema, never a column position.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as C

_SPARK_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "FLOAT": T.DoubleType(),
    "DECIMAL(18,2)": T.DecimalType(18, 2),
}


def _field(line: str) -> T.StructField:
    name, sql_type, role, *flags = line.split()
    meta = {
        "role": role,
        "binary": "binary" in flags,
        "clip": "noclip" not in flags,
        "scale": "noscale" not in flags,
    }
    if "sentinel" in flags:
        meta["sentinel"] = C.NEVER
    if "unit" in flags:
        meta["clip_bounds"] = [0.0, 1.0]
    if sql_type.startswith("VARCHAR"):
        dtype: T.DataType = T.StringType()
    else:
        dtype = _SPARK_TYPES[sql_type]
    return T.StructField(name, dtype, "null" in flags, meta)


SCHEMA = T.StructType([_field(ln) for ln in C.CONTRACT_COLUMNS.strip().splitlines()])
_BY_NAME = {f.name: f for f in SCHEMA}

FEATURES = [f.name for f in SCHEMA if f.metadata["role"] == "feature"]
META = [f.name for f in SCHEMA if f.metadata["role"] != "feature"]
BINARY = {f.name for f in SCHEMA if f.metadata["binary"]}
NO_CLIP = {f.name for f in SCHEMA if not f.metadata["clip"]}
NO_SCALE = {f.name for f in SCHEMA if not f.metadata["scale"]}
CLIP_BOUNDS = {f.name: tuple(f.metadata["clip_bounds"]) for f in SCHEMA
               if "clip_bounds" in f.metadata}
SENTINELS = {f.name: f.metadata["sentinel"] for f in SCHEMA if "sentinel" in f.metadata}
REQUIRED = [f.name for f in SCHEMA if not f.nullable]


def flag(name: str, key: str, default):
    """A contract flag of a column; columns outside the contract get the default."""
    f = _BY_NAME.get(name)
    return default if f is None else f.metadata.get(key, default)


def in_contract_order(columns) -> list[str]:
    """Feature columns of a frame in contract order; unknown ones last, by name."""
    pos = {n: i for i, n in enumerate(FEATURES)}
    feats = [c for c in columns if c not in META]
    return sorted(feats, key=lambda c: (pos.get(c, len(pos)), c))


def schema_for(columns) -> T.StructType:
    """The contract's sub-schema for the given columns, in the given order."""
    return T.StructType([_BY_NAME[c] for c in columns])


def fingerprint(columns) -> str:
    """What a stored snapshot depends on: names, order, types, roles, sentinels."""
    parts = []
    for c in columns:
        f = _BY_NAME.get(c)
        if f is None:
            parts.append(f"{c}:?")
        else:
            parts.append(f"{c}:{f.dataType.simpleString()}:{f.metadata['role']}:"
                         f"{f.nullable}:{f.metadata.get('sentinel')}")
    return "|".join(parts)
