"""Records with optional, possibly nested fields, resolved when the plan is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def paths(df: DataFrame) -> list[str]:
    """Names of all fields that are no structs, nested ones with dots, in their order."""
    return flatten(df).columns


def optional(df: DataFrame, path: str, kind: str = "string") -> Column:
    """The field as ``kind`` (null where it can't be one), or null where the records have no such field. A column literally named with dots comes first."""
    if path in df.columns:
        return F.col(f"`{path}`").try_cast(kind)
    return F.col(path).try_cast(kind) if has(df, path) else F.lit(None).cast(kind)


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Nested structs as columns with dotted names; arrays and timestamps stay; maps become JSON."""
    out: list[Column] = []

    def walk(kind: T.StructType, path: str, column: Column | None) -> None:
        for f in kind.fields:
            name = f"{path}.{f.name}" if path else f.name
            here = F.col(f"`{f.name}`") if column is None else column[f.name]
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, name, here)
            elif isinstance(f.dataType, T.MapType):
                out.append(F.to_json(here).alias(name))
            else:
                out.append(here.alias(name))

    walk(df.schema, prefix, None)
    return df.select(*out)


def leaves(df: DataFrame) -> DataFrame:
    """One row (seq) for each scalar leaf of the records, as text; nulls and empty texts are left out."""
    flat = flatten(df)
    parts = []
    for f in flat.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            parts.append(F.coalesce(F.transform(c, lambda x, inner=inner: F.to_json(x) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")), F.array().cast("array<string>")))
        else:
            parts.append(F.array(c.cast("string")))
    return flat.select(F.explode(F.concat(*parts)).alias("text")).where("text IS NOT NULL AND text <> ''")
