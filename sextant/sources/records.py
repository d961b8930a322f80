"""JSON records with tagged values, as a source and as a sink, through Spark's JSON functions.

A record is {"id": ..., "vector": [...]?, "attrs": {key: {"Str": ...} | "Null" | ...}}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import VALUE

#: Wire tag and the kind and slot of the value.
TAGS = {"Str": ("str", "s"), "Int": ("int", "i"), "Float": ("float", "f"), "Bool": ("bool", "b"), "List": ("list", "l"), "DateTime": ("dt", "i")}
_WIRE = "struct<Str:string,Int:bigint,Float:double,Bool:boolean,List:array<string>,DateTime:bigint>"


def _value(raw: Column) -> Column:
    w = F.from_json(raw, _WIRE)
    kind = F.when(raw == "Null", "null")
    for tag, (name, _) in TAGS.items():
        kind = kind.when(w[tag].isNotNull(), name)
    slots = {"s": w["Str"], "i": F.coalesce(w["Int"], w["DateTime"]), "b": w["Bool"], "l": w["List"], "f": w["Float"]}
    return F.struct(F.coalesce(kind, F.raise_error(F.concat(F.lit("not a tagged value: "), raw))).alias("t"), *[slots[f.name].alias(f.name) for f in VALUE.fields[1:]])


def parse(lines: Column) -> Column:
    """A struct (id, vector, attrs) of a JSON record."""
    r = F.from_json(lines, "struct<id:string,vector:array<float>,attrs:map<string,string>>")
    return F.struct(r["id"].alias("id"), r["vector"].alias("vector"), F.transform_values(r["attrs"], lambda k, v: _value(v)).alias("attrs"))


def read_json(spark: SparkSession, path: str, collection: str) -> DataFrame:
    """Records of a JSON-lines file or folder."""
    return spark.read.text(path).where("value <> ''").select(F.lit(collection).alias("collection"), parse(F.col("value")).alias("r")).select("collection", "r.*")


def _wire(v: Column) -> Column:
    out = F.when(v["t"] == "null", F.lit('"Null"'))
    for tag, (kind, slot) in TAGS.items():
        out = out.when(v["t"] == kind, F.to_json(F.struct(v[slot].alias(tag))))
    return out


def to_json(df: DataFrame) -> DataFrame:
    """One column ``value`` with a JSON record per row of (id, vector?, attrs)."""
    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), _wire(e["value"])))
    vector = F.when(F.col("vector").isNotNull(), F.concat(F.lit(',"vector":'), F.to_json("vector"))).otherwise("") if "vector" in df.columns else F.lit("")
    head = F.to_json(F.struct("id"))
    return df.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), vector, F.lit(',"attrs":{'), F.array_join(pairs, ","), F.lit("}}")).alias("value"))
