"""Listing by metadata and aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.partitions import materialize
from ..functions.filters import Predicate, bind, compile_filter, millis
from .search import SearchOptions, project, scoped

GROUPS = 10_000
MISSING, NULL = "\0missing", "\0null"


def base_order(df: DataFrame) -> list[Column]:
    """Records with a row by row, then the others by collection and id."""
    return [*([F.asc_nulls_last("row")] if "row" in df.columns else []), F.col("collection"), F.col("id")]


def list_records(df: DataFrame, where: Predicate | None = None, scope: list[str] | None = None, order_by: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Records that pass the filter, in base order or by an attribute; score is 0.

    With ``order_by``, records without the attribute (or with NaN) come last,
    also when descending, in base order; so do ties.
    """
    rows = scoped(df, scope).where(compile_filter(where, bind(df)))
    keys = base_order(df)
    if order_by is not None:
        if order_by not in df.columns or isinstance(df.schema[order_by].dataType, T.ArrayType):
            keys = keys  # nothing is comparable: all records are in the trailing bucket
        else:
            c = F.col(order_by)
            numeric = isinstance(df.schema[order_by].dataType, T.FractionalType)
            last = F.coalesce(F.isnan(c), F.lit(True)) if numeric else c.isNull()
            value = F.when(~last, c)
            keys = [last, value.desc() if descending else value.asc(), *keys]
    page = rows.withColumn("score", F.lit(0.0)).orderBy(*keys).offset(offset).limit(limit)
    return project(page, SearchOptions(include=include, exclude=exclude))


def list_tagged(df: DataFrame, order_by: str, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Listing of records with a map of tagged values, by an attribute of mixed types.

    The first record in base order whose value can be compared (not null, list or
    NaN) fixes the type; values of other types come last, in base order.
    """
    v = F.try_element_at("attrs", F.lit(order_by))
    ok = F.coalesce(v["t"].isin("str", "int", "bool", "dt") | ((v["t"] == "float") & ~F.isnan(v["f"])), F.lit(False))
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([F.col("row").isNull(), F.col("row"), F.col("collection"), F.col("id")])])
    kind = df.where(ok).agg(F.min_by(v["t"], place)).first()[0]
    slot = {"str": "s", "int": "i", "bool": "b", "dt": "i", "float": "f"}.get(kind)
    keys = base_order(df)
    if slot:
        same = ok & (v["t"] == kind)
        value = F.when(same, v[slot])
        keys = [~F.coalesce(same, F.lit(False)), value.desc() if descending else value.asc(), *keys]
    return df.orderBy(*keys).offset(offset).limit(limit)


def group_key(df: DataFrame, key: str) -> Column:
    """The group's name: its value as a string, so 0.0 and -0.0 differ; a marker where the attribute is absent."""
    c = F.col(key)
    if isinstance(df.schema[key].dataType, (T.TimestampType, T.TimestampNTZType)):
        c = millis(c, df.schema[key].dataType)
    if isinstance(df.schema[key].dataType, T.ArrayType):
        c = F.to_json(c)
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def _sums(df: DataFrame, fields: list[str]) -> list[Column]:
    """Totals: exact for integers (a double beyond 64 bits), double as soon as a double adds; 0 without an addend."""
    out = []
    for f in fields:
        t = df.schema[f].dataType
        if isinstance(t, T.IntegralType):
            out.append(F.coalesce(F.sum(F.col(f).cast("decimal(38,0)")), F.lit(0)).cast("double").alias(f"sum_{f}"))
        elif isinstance(t, T.FractionalType):
            out.append(F.coalesce(F.sum(f), F.lit(0.0)).alias(f"sum_{f}"))
        else:
            out.append(F.lit(0.0).alias(f"sum_{f}"))
    return out


def aggregate(df: DataFrame, where: Predicate | None = None, scope: list[str] | None = None, sums: list[str] = (), group_by: str | None = None) -> DataFrame:
    """count and sums over the records that pass the filter; with ``group_by`` one row per group beside the total.

    Columns: grp (NULL in the total), present (whether the group's records have the
    attribute), n, sum_<field>..., groups_truncated. The total comes from the same
    pass (grouping sets). Groups are ordered by n descending and name; 10 000 are
    kept, and groups_truncated says whether there are more.
    """
    rows = scoped(df, scope).where(compile_filter(where, bind(df)))
    totals = [F.count(F.lit(1)).alias("n"), *_sums(df, list(sums))]
    if group_by is None:
        return rows.agg(*totals)
    keyed = rows.withColumn("grp", group_key(df, group_by))
    out = materialize(keyed.rollup("grp").agg(F.grouping("grp").alias("is_total"), *totals))
    # One group more than is kept shows whether there are more; only those go to one task.
    top = out.where("is_total = 0").orderBy(F.desc("n"), "grp").limit(GROUPS + 1)
    top = top.withColumn("rn", F.row_number().over(Window.partitionBy("is_total").orderBy(F.desc("n"), "grp")))
    some = top.unionByName(out.where("is_total = 1").withColumn("rn", F.lit(0)))
    more = some.withColumn("groups_truncated", F.max("rn").over(Window.partitionBy(F.lit(0))) > GROUPS)
    kept = more.where(F.col("rn") <= GROUPS)
    present = F.when(F.col("is_total") == 0, F.col("grp") != MISSING)
    shown = F.when(F.col("grp") != MISSING, F.col("grp"))
    return kept.select(F.col("is_total").cast("boolean").alias("is_total"), shown.alias("grp"), present.alias("present"), "n", *[f"sum_{f}" for f in sums], F.coalesce("groups_truncated", F.lit(False)).alias("groups_truncated"))


def footprint(df: DataFrame, dimension: int) -> DataFrame:
    """rows (with a vector), docs, dimension and vector bytes of the live records."""
    return df.agg(F.count("vector").alias("rows"), F.count(F.lit(1)).alias("docs"), F.lit(dimension).alias("dimension"), (F.count("vector") * dimension * 4).alias("vector_bytes"))
