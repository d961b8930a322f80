"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.partitions import checkpoint_folder, materialize, spread  # noqa: F401

#: Prefix of working columns, so that columns of the input may have any other name.
TMP = "__sx_"
#: Rows that a rank group should hold at most, on average (see ``with_rank``).
RANK_GROUP_ROWS = 500
#: Ranges of a key whose sizes one task sums up.
RANK_RANGES = 1 << 14
#: Characters of text that one vectorised step works on at most (longer texts go alone).
CHUNK_CHARS = 2_000_000


def arrow_map(
    df: DataFrame,
    fields: list[tuple[str, T.DataType]],
    fn: Callable[..., Iterable[list]],
    keep: list[str] = (),
) -> DataFrame:
    """``mapInArrow`` with a helper's contract that is easy to test without Spark.

    ``fn`` gets one batch's columns (other than ``keep``) as Python lists and
    returns one list per field; the columns named in ``keep`` pass through
    unchanged, as Arrow data, before the new fields.
    """
    keep = list(keep)
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(out)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = [batch.column(i).cast(arrow.field(i).type) for i in range(width)]
            made = fn(*[batch.column(i).to_pylist() for i in range(width, batch.num_columns)])
            cols = [pa.array(v, type=arrow.field(width + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(kept + cols, schema=arrow)

    return df.mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def with_rank(df: DataFrame, keys: list[str], by: Column, ties: list[Column], name: str, rows: int) -> DataFrame:
    """Add ``name``: each row's 0-based rank in its key group, in the order of ``by`` then ``ties``.

    A plain window would bring a hot key's rows to one task. Here the signed
    64-bit ``by`` (a hash, so evenly spread) is cut into ranges of about
    ``RANK_GROUP_ROWS`` rows of the whole table; rows are numbered within (key,
    range) and the small table of range sizes gives each range its start.
    """
    cut, h, start = TMP + "cut", TMP + "h", TMP + "start"
    parts = max(1, -(-rows // RANK_GROUP_ROWS))
    df = df.withColumn(h, by)
    # h / 2^64 + 1/2 is in [0, 1]; monotone, so ranges follow the order of h.
    df = df.withColumn(cut, F.least(F.lit(parts - 1), F.floor((F.col(h) / F.lit(2.0**64) + 0.5) * parts)).cast("int"))
    sizes = df.groupBy(*keys, cut).agg(F.count(F.lit(1)).alias(TMP + "n"))

    def before(*by: str):
        return Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)

    def sums(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn(start, F.coalesce(F.sum(TMP + "n").over(before(*by)), F.lit(0))).drop(TMP + "n")

    if parts <= RANK_RANGES:
        starts = sums(sizes, *keys)
    else:  # a hot key has too many ranges for one task: sums of spans of ranges first
        span, base = TMP + "span", TMP + "base"
        sizes = sizes.withColumn(span, F.floor(F.col(cut) / RANK_RANGES))
        spans = sizes.groupBy(*keys, span).agg(F.sum(TMP + "n").alias(TMP + "n")).withColumn(cut, F.col(span))
        spans = sums(spans, *keys).withColumnRenamed(start, base).drop(cut)
        starts = sums(sizes, *keys, span).join(spans, [*keys, span]).withColumn(start, F.col(start) + F.col(base)).drop(span, base)
    on = [*keys, cut]
    numbered = df.withColumn(TMP + "at", F.row_number().over(Window.partitionBy(*on).orderBy(h, *ties)))
    return numbered.join(starts, on).withColumn(name, F.col(start) + F.col(TMP + "at") - 1).drop(cut, h, start, TMP + "at")


def unique_rows(df: DataFrame) -> list[Column]:
    """Columns that order rows of the documents schema, to break ties between repeated ids."""
    return [F.col(c) for c in ("doc_id", "source", "lang", "n_chars") if c in df.columns]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
