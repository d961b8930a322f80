"""A versioned store of collections: immutable Parquet batches of operations, published by manifests.

Every write appends one batch directory and then publishes a manifest that lists
it; a batch without a manifest does not exist, so writes are all or nothing. The
next manifest's file is created exclusively, so of two writers one fails. The
state at a version is a fold over the operations its manifest lists. Paths are
Hadoop URIs; nothing is read or written except through Spark and its file system.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.filters import ATTRS, VALUE, DateTime, Predicate, bind, compile_filter, kind_of, to_attrs

#: Attributes that the store itself keeps.
CREATED, UPDATED, EXPIRES, COUNT, ACCESSED = "mem_created_at", "mem_updated_at", "mem_expires_at", "mem_access_count", "mem_last_accessed"

OPS = T.StructType(
    [T.StructField(n, t) for n, t in (("op", T.StringType()), ("collection", T.StringType()), ("id", T.StringType()), ("vector", T.ArrayType(T.FloatType())), ("attrs", ATTRS), ("meta", T.StringType()), ("at", T.LongType()), ("extend", T.LongType()))]
)
STORED = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ord", T.LongType()), *OPS.fields])
FULL = ("upsert", "delete")


class Conflict(RuntimeError):
    """Another writer published this version first."""


def value(v) -> Column:
    """A literal tagged value."""
    kind = kind_of(v)
    slot = {"str": "s", "int": "i", "bool": "b", "list": "l", "float": "f", "dt": "i"}.get(kind)
    raw = v.ms if isinstance(v, DateTime) else list(v) if kind == "list" else v
    return F.struct(F.lit(kind).alias("t"), *[(F.lit(raw) if f.name == slot else F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]])


class Files:
    """The few file operations that a store needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.root = jvm, root.rstrip("/")
        self.fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist yet: whole under another name, then renamed without overwriting, so that it is never seen half written."""
        if self.fs.exists(self.path(name)):
            raise Conflict(name)
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/")
        out = self.fs.create(self.path(aside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            done = self.fs.rename(self.path(aside), self.path(name)) if not self.fs.exists(self.path(name)) else False
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            done = False
        if not done:
            self.fs.delete(self.path(aside), False)
            raise Conflict(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """A handle at one version. Writes move the handle on; ``refresh`` follows other writers; ``at`` reads the past."""

    def __init__(self, spark: SparkSession, root: str, dimension: int | None = None, distance: str = "cosine", read_only: bool = False, max_vector_bytes: int | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.read_only, self.max_vector_bytes = read_only, max_vector_bytes
        versions = self.versions()
        if versions:
            self._load(versions[-1])
            if dimension is not None and (self.dimension, self.distance) != (dimension, distance):
                raise ValueError(f"the store has {self.dimension} dimensions and {self.distance} distance")
        else:
            if dimension is None or distance not in V.METRICS:
                raise ValueError("a new store needs a dimension and a distance")
            self.manifest = {"version": 0, "dimension": dimension, "distance": distance, "batches": [], "streams": {}, "profile": {}, "floor": 0, "next": 1}
            self.files.create("versions/000000000000.json", json.dumps(self.manifest))
        self._grouped = False

    # --- versions ---------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names("versions") if n.endswith(".json") and not n.startswith("."))

    def _load(self, version: int) -> None:
        self.manifest = json.loads(self.files.read(f"versions/{version:012d}.json"))

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def dimension(self) -> int:
        return self.manifest["dimension"]

    @property
    def distance(self) -> str:
        return self.manifest["distance"]

    def refresh(self) -> bool:
        """Adopt the newest published version; whether there was a newer one."""
        newest = self.versions()[-1]
        if newest == self.version:
            return False
        self._load(newest)
        return True

    def at(self, version: int) -> Store:
        """A read-only handle at a past version that compaction has not dropped."""
        newest = json.loads(self.files.read(f"versions/{self.versions()[-1]:012d}.json"))
        if version not in self.versions() or version < newest["floor"]:
            raise LookupError(f"no version {version}")
        other = Store(self.spark, self.root, read_only=True)
        other._load(version)
        return other

    def _publish(self, batches: list[dict], **changes) -> None:
        new = {**self.manifest, **changes, "batches": batches}
        if self._grouped:
            self.manifest = new
            return
        new["version"] += 1
        self.files.create(f"versions/{new['version']:012d}.json", json.dumps(new))
        self.manifest = new

    @contextmanager
    def group(self):
        """Writes inside are published together, as one version, when the block ends; none of them if it fails."""
        before, self._grouped = self.manifest, True
        try:
            yield self
        except BaseException:
            self.manifest = before
            raise
        finally:
            self._grouped = False
        if self.manifest != before:
            self._publish(self.manifest["batches"])

    def _write(self, ops: DataFrame) -> dict:
        """Write one batch; what the manifest says of it."""
        if self.read_only:
            raise PermissionError("this handle only reads")
        name, number = f"ops/{uuid.uuid4().hex}", self.manifest["next"]
        self.manifest = {**self.manifest, "next": number + 1}
        stored = ops.select(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("ord"), *[F.col(f.name).cast(f.dataType) for f in OPS])
        stored.write.parquet(f"{self.root}/{name}")
        return {"path": name, **self._sums(name)}

    def _sums(self, name: str) -> dict:
        got = self.spark.read.schema(STORED).parquet(f"{self.root}/{name}").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count("vector").alias("v"), F.sum(F.xxhash64("ord", "collection", "id", "at", "vector", "meta", F.to_json("attrs")).cast("decimal(38,0)")).alias("h")).collect()
        return {"kinds": {r["op"]: r["n"] for r in got}, "vectors": sum(r["v"] for r in got), "hash": str(sum(int(r["h"]) for r in got))}

    def append(self, ops: DataFrame, **changes) -> dict:
        """Publish operations as one batch."""
        made = self._write(ops)
        self._publish([*self.manifest["batches"], made], **changes)
        return made

    def _single(self, op: str, collection: str, meta: str | None = None) -> None:
        self.append(self.spark.range(1).select(*[F.lit({"op": op, "collection": collection, "meta": meta}.get(f.name)).cast(f.dataType).alias(f.name) for f in OPS]))

    def ops(self, *kinds: str) -> DataFrame:
        """Operations of this version with ``seq``; of some kinds, only from the batches that have them."""
        paths = [f"{self.root}/{b['path']}" for b in self.manifest["batches"] if not kinds or any(k in b["kinds"] for k in kinds)]
        df = self.spark.read.schema(STORED).parquet(*paths) if paths else self.spark.createDataFrame([], STORED)
        df = df.where(F.col("op").isin(*kinds)) if kinds else df
        return df.withColumn("seq", F.struct("batch", "ord"))

    def _has(self, kind: str) -> bool:
        return any(kind in b["kinds"] for b in self.manifest["batches"])

    def _since_drop(self, ops: DataFrame) -> DataFrame:
        """Without what a later drop of the collection hides."""
        if not self._has("drop"):
            return ops
        drops = self.ops("drop").groupBy("collection").agg(F.max("seq").alias("dropped"))
        return ops.join(drops, "collection", "left").where(F.col("dropped").isNull() | (F.col("seq") > F.col("dropped"))).drop("dropped")

    # --- state ------------------------------------------------------------------------------------------------

    def records(self, scope: list[str] | None = None, only: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
        """Live records: collection, id, row (NULL without a vector), vector, attrs; of the attributes ``only`` some, or those ``without`` some.

        The last upsert or delete of a key counts, found with one shuffle by key;
        reinforcements after it are folded in where the version has any.
        Attributes that aren't asked for don't move.
        """
        full = self._since_drop(self.ops(*FULL))

        def asked(attrs: Column, own: tuple[str, ...] = ()) -> Column:
            """Of a map what was asked for, and the store's ``own``."""
            attrs = attrs if only is None else F.map_filter(attrs, lambda k, v: k.isin([*only, *own]))
            return F.map_filter(attrs, lambda k, v: ~k.isin([x for x in without if x not in own])) if without else attrs

        full = full.withColumn("attrs", asked(F.col("attrs"), (COUNT, ACCESSED, EXPIRES)))  # reinforcements are folded into these
        if scope is not None:
            full = full.where(F.col("collection").isin(scope))
        last = full.withColumn("rn", F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.desc("seq")))).where("rn = 1 and op = 'upsert'").drop("rn")
        if self._has("reinforce"):
            last = self._reinforced(last)
        return last.select("collection", "id", F.when(F.col("vector").isNotNull(), F.col("seq")).alias("row"), "vector", asked(F.coalesce("attrs", F.create_map().cast(ATTRS))).alias("attrs"))

    def _reinforced(self, last: DataFrame) -> DataFrame:
        patches = self.ops("reinforce").select("collection", "id", F.col("seq").alias("pseq"), F.col("at").alias("pat"), F.col("extend").alias("pext"))
        after = patches.join(last.select("collection", "id", "seq"), ["collection", "id"]).where("pseq > seq")
        folded = after.groupBy("collection", "id").agg(F.count(F.lit(1)).alias("times"), F.max_by("pat", "pseq").alias("pat"), F.max(F.col("pat") + F.col("pext")).alias("until"))
        both = last.join(folded, ["collection", "id"], "left")
        old, expires = F.try_element_at("attrs", F.lit(COUNT)), F.try_element_at("attrs", F.lit(EXPIRES))
        top = F.lit((1 << 63) - 1)
        base = F.when(old["t"] == "int", old["i"]).otherwise(F.lit(0).cast("long"))
        count = F.when(base > top - F.col("times"), top).otherwise(base + F.col("times"))

        def tag(kind: str, c: Column) -> Column:
            return F.struct(F.lit(kind).alias("t"), *[(c if f.name == "i" else F.lit(None)).cast(f.dataType).alias(f.name) for f in VALUE.fields[1:]])

        moved = F.when((expires["t"] == "dt") & F.col("until").isNotNull(), tag("dt", F.greatest(expires["i"], F.col("until")))).otherwise(expires)
        patch = F.array(F.struct(F.lit(COUNT).alias("k"), tag("int", count).alias("v")), F.struct(F.lit(ACCESSED).alias("k"), tag("dt", F.col("pat")).alias("v")), F.struct(F.lit(EXPIRES).alias("k"), moved.alias("v")))
        kept = F.map_filter(F.coalesce("attrs", F.create_map().cast(ATTRS)), lambda k, v: ~k.isin(COUNT, ACCESSED, EXPIRES))
        patched = F.map_concat(kept, F.map_from_entries(F.filter(patch, lambda e: e["v"].isNotNull())))
        return both.withColumn("attrs", F.when(F.col("times").isNotNull(), patched).otherwise(F.col("attrs")))

    def get(self, collection: str, id: str) -> DataFrame:
        return self.records([collection]).where(F.col("id") == id)

    # --- writes -----------------------------------------------------------------------------------------------

    def upsert(self, df: DataFrame, collection: str | None = None, **changes) -> int:
        """Insert or replace records (id, and any of collection, vector, attrs or attribute columns); the last of a key wins.

        Attributes are replaced as a whole. A vector of another length fails the
        whole batch. Cosine stores keep unit vectors.
        """
        if self.max_vector_bytes is not None:
            rows = sum(b["vectors"] for b in self.manifest["batches"]) + df.count()
            if rows * self.dimension * 4 > self.max_vector_bytes:
                raise MemoryError("the store's vectors would exceed max_vector_bytes")
        coll = F.lit(collection) if collection is not None else F.col("collection")
        vector = F.col("vector").cast("array<float>") if "vector" in df.columns else F.lit(None).cast("array<float>")
        right = F.size(vector) == self.dimension
        checked = F.when(vector.isNull() | right, vector).otherwise(F.raise_error(F.lit(f"a vector does not have {self.dimension} dimensions")).cast("array<float>"))
        if self.distance == "cosine":
            checked = F.when(vector.isNotNull(), V.normalize(checked))
        rest = [c for c in df.columns if c not in ("collection", "id", "row", "vector", "attrs")]
        attrs = F.col("attrs") if "attrs" in df.columns else to_attrs(df, rest)
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
        ops = df.select(F.lit("upsert").alias("op"), coll.alias("collection"), F.col("id").cast("string").alias("id"), checked.alias("vector"), attrs.alias("attrs"), none["meta"], none["at"], none["extend"])
        return self.append(ops, **changes)["kinds"].get("upsert", 0)

    def _delete(self, keys: DataFrame) -> int:
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
        ops = keys.select(F.lit("delete").alias("op"), "collection", "id", *[none[c] for c in ("vector", "attrs", "meta", "at", "extend")])
        made = self._write(ops)
        n = made["kinds"].get("delete", 0)
        if n:
            self._publish([*self.manifest["batches"], made])
        return n

    def delete(self, collection: str, ids: list[str]) -> int:
        """Delete by id; missing ids are passed over. How many were deleted."""
        return self._delete(self.records([collection]).where(F.col("id").isin(ids)))

    def delete_where(self, where: Predicate, scope: list[str] | None = None) -> int:
        """Delete what passes the filter in some or all collections, as one batch."""
        live = self.records(scope)
        return self._delete(live.where(compile_filter(where, bind(live))))

    def sweep_expired(self, now: int) -> int:
        """Delete what has expired by ``now`` (ms), then compact if there was any."""
        from ..functions.filters import Le

        n = self.delete_where(Le(EXPIRES, DateTime(now)))
        if n:
            self.compact()
        return n

    def reinforce(self, collection: str, ids: list[str] | DataFrame, now: int, extend: int | None = None) -> None:
        """Count an access of records, note its time, and move an expiry they have to ``now`` + ``extend`` at least."""
        df = self.spark.createDataFrame([(i,) for i in ids], "id string") if isinstance(ids, list) else ids.select("id")
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
        self.append(df.select(F.lit("reinforce").alias("op"), F.lit(collection).alias("collection"), "id", none["vector"], none["attrs"], none["meta"], F.lit(now).cast("long").alias("at"), F.lit(extend).cast("long").alias("extend")))

    def create_collection(self, name: str) -> None:
        if name not in self.collections():
            self._single("create", name)

    def drop_collection(self, name: str) -> None:
        self._single("drop", name)

    def collections(self) -> list[str]:
        """Names of collections that were created or written to since their last drop, sorted."""
        seen = self._since_drop(self.ops("create", "upsert", "meta", "fts", "findex").select("collection", "seq"))
        return sorted(r["collection"] for r in seen.select("collection").distinct().collect())

    def _latest(self, op: str, collection: str):
        rows = self._since_drop(self.ops(op).where(F.col("collection") == collection))
        got = rows.agg(F.max_by("meta", "seq")).first()[0]
        return json.loads(got) if got else None

    def set_meta(self, collection: str, meta: dict[str, str]) -> None:
        self._single("meta", collection, json.dumps(meta))

    def meta(self, collection: str) -> dict[str, str]:
        return self._latest("meta", collection) or {}

    def set_fts_schema(self, collection: str, fields: list[dict]) -> None:
        """Declare searchable fields, as FieldSchema arguments; declaring again replaces the declaration."""
        from ..operators.fts import FieldSchema

        if len({f["field"] for f in fields}) != len([FieldSchema(f["field"], f.get("k1", 1.2), f.get("b", 0.75)) for f in fields]):
            raise ValueError("a field is declared twice")
        self._single("fts", collection, json.dumps(fields))

    def fts_schema(self, collection: str) -> list[dict]:
        return self._latest("fts", collection) or []

    def set_filter_index(self, collection: str, fields: list[dict]) -> None:
        """Declare filter-index fields, as FilterField arguments; an empty list drops the index."""
        from ..operators.findex import FilterField

        if len({FilterField(**f).field for f in fields}) != len(fields):
            raise ValueError("a field is declared twice")
        self._single("findex", collection, json.dumps(fields))

    def filter_index(self, collection: str) -> list[dict]:
        return self._latest("findex", collection) or []

    def configure(self, **profile) -> None:
        """Advisory defaults for openers, kept in the manifest."""
        self._publish(self.manifest["batches"], profile={**self.manifest["profile"], **profile})

    # --- derived tables ---------------------------------------------------------------------------------------

    def persist(self, kind: str, table: DataFrame, partition_by: str | None = None) -> None:
        """Keep a table that is derived from this version's records, such as an index."""
        writer = table.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/derived/{kind}/{self.version:012d}")

    def persisted(self, kind: str) -> DataFrame | None:
        """The kept table of this very version; None if there is none."""
        name = f"{self.version:012d}"
        if name not in self.files.names(f"derived/{kind}") or "_SUCCESS" not in self.files.names(f"derived/{kind}/{name}"):
            return None
        return self.spark.read.parquet(f"{self.root}/derived/{kind}/{name}")

    # --- maintenance ------------------------------------------------------------------------------------------

    def compact(self) -> None:
        """Rewrite the live records and declarations as one batch in (collection, id) order; older versions can't be read any more."""
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in OPS}
        live = self.records().orderBy("collection", "id").select(F.lit("upsert").alias("op"), "collection", "id", "vector", "attrs", none["meta"], none["at"], none["extend"])
        kinds = [k for k in ("create", "meta", "fts", "findex") if self._has(k)]
        batches = [self._write(live)]
        if kinds:
            said = self._since_drop(self.ops(*kinds)).withColumn("rn", F.row_number().over(Window.partitionBy("op", "collection").orderBy(F.desc("seq")))).where("rn = 1")
            batches.append(self._write(said.select(*OPS.names)))
        self._publish(batches, floor=self.version + 1)

    def vacuum(self) -> int:
        """Delete batch folders and manifests that versions from the floor on don't need; how many batches went."""
        keep = [v for v in self.versions() if v >= self.manifest["floor"]]
        used = {b["path"] for v in keep for b in json.loads(self.files.read(f"versions/{v:012d}.json"))["batches"]}
        gone = [f"ops/{n}" for n in self.files.names("ops") if f"ops/{n}" not in used]
        for name in gone:
            self.files.delete(name)
        for v in set(self.versions()) - set(keep):
            self.files.delete(f"versions/{v:012d}.json")
        return len(gone)

    def verify(self) -> list[str]:
        """Batches whose rows or hashes are not what the manifest says; none is good."""
        bad = []
        for b in self.manifest["batches"]:
            try:
                ok = self._sums(b["path"]) == {k: b[k] for k in ("kinds", "vectors", "hash")}
            except PySparkException:  # missing and damaged files are what this looks for
                ok = False
            if not ok:
                bad.append(b["path"])
        return bad

    def backup(self, target: str) -> Store:
        """Copy this version's batches to another root, as a store of its own."""
        copy = Store(self.spark, target, self.dimension, self.distance)
        for b in self.manifest["batches"]:
            self.spark.read.schema(STORED).parquet(f"{self.root}/{b['path']}").write.parquet(f"{copy.root}/{b['path']}")
        copy._publish(self.manifest["batches"], profile=self.manifest["profile"])
        return copy

    def footprint(self) -> dict:
        """rows ever written with a vector, dead ones among them, live docs, dimension and vector bytes."""
        live = self.records().agg(F.count(F.lit(1)).alias("docs"), F.count("vector").alias("rows")).first()
        written = sum(b["vectors"] for b in self.manifest["batches"])
        return {"rows": written, "dead_rows": written - live["rows"], "docs": live["docs"], "dimension": self.dimension, "vector_bytes": written * self.dimension * 4, "version": self.version}

