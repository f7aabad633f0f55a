"""Tables of Parquet folders under a commit log (SNK-6..8, STR-M1..3).

A batch writes its rows, dealt to a bounded number of buckets, into folders of
its own; one small file then names the folders that make up each bucket of
each set of rows. Readers take the folders of the last commit, so a batch that
was killed half-way leaves nothing that is read, a repeated one writes over
its own folders, and one that is committed already is skipped. Replaced
buckets are written anew (copy on write): reading costs rows, not updates.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


def _widened(old: dict | None, new: T.StructType) -> T.StructType:
    """The columns of both; a column keeps its type."""
    if old is None:
        return new
    held = T.StructType.fromJson(old)
    for f in new.fields:
        if f.name in held.names and held[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {held[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([*held.fields, *[f for f in new.fields if f.name not in held.names]])


class SnapshotTable:
    """Sets of rows by name; ``state()`` is what the last commit says."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where = self._at(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def state(self) -> dict:
        done = [n for n in self._names(f"{self.path}/_commits") if n.isdigit()]
        if not done:
            return {"version": 0, "batch": None, "meta": {}, "sets": {}, "schemas": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{done[-1]}", wholetext=True).first()[0])

    def write(self, name: str, rows: DataFrame, batch: str) -> dict:
        """Write ``rows``, which have a bucket column, for a coming commit: {bucket: [folder]}."""
        folder = f"{self.path}/{name}/{batch}"
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        return {n.split("=", 1)[1]: [f"{name}/{batch}/{n}"] for n in self._names(folder) if n.startswith(f"{BUCKET}=")}

    def commit(self, state: dict, batch: str, schemas: dict[str, T.StructType], append: dict | None = None, replace: dict | None = None, meta: dict | None = None) -> None:
        """Make folders part of their sets: appended to their buckets, or in place of what those held."""
        sets = {name: dict(buckets) for name, buckets in state["sets"].items()}
        for name, buckets in (append or {}).items():
            own = sets.setdefault(name, {})
            for b, folders in buckets.items():
                own[b] = [*own.get(b, []), *folders]
        for name, buckets in (replace or {}).items():
            sets.setdefault(name, {}).update(buckets)
        version = state["version"] + 1
        schemas = {k: _widened(state["schemas"].get(k), v) for k, v in schemas.items()}
        new = {"version": version, "batch": batch, "meta": {**state["meta"], **(meta or {})}, "sets": sets, "schemas": {**state["schemas"], **{k: json.loads(v.json()) for k, v in schemas.items()}}}
        draft, final = self._at(f"{self.path}/_commits/.{version:09d}-{batch}"), self._at(f"{self.path}/_commits/{version:09d}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")

    def read(self, state: dict, name: str, buckets: Iterable | None = None) -> DataFrame | None:
        """The rows of a set, of some buckets only; None if the set was never written."""
        if name not in state["schemas"]:
            return None
        schema = T.StructType.fromJson(state["schemas"][name])
        held = state["sets"].get(name, {})
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        folders = [f"{self.path}/{f}" for b in wanted for f in held[b]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def buckets_of(self, rows: DataFrame) -> list:
        """The buckets that rows fall into; no more than there are buckets."""
        return [r[0] for r in rows.select(BUCKET).distinct().collect()]


def hash_bucket(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class KeyedTable:
    """SNK-8: the latest row per key. An upsert writes the buckets of its keys anew and no others."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.table, self.keys, self.buckets = SnapshotTable(spark, path), keys, buckets

    def upsert(self, rows: DataFrame, batch: str) -> None:
        state = self.table.state()
        if state["meta"].get("last") == batch:
            return  # committed before a restart
        dealt = rows.withColumn(BUCKET, hash_bucket(self.keys, self.buckets))
        old = self.table.read(state, "rows", self.table.buckets_of(dealt))
        if old is not None:
            kept = old.join(rows.select(*self.keys), self.keys, "left_anti").withColumn(BUCKET, hash_bucket(self.keys, self.buckets))
            dealt = dealt.unionByName(kept, allowMissingColumns=True)
        folders = self.table.write("rows", dealt, batch)
        self.table.commit(state, batch, {"rows": dealt.drop(BUCKET).schema}, replace={"rows": folders}, meta={"last": batch})

    def read(self) -> DataFrame | None:
        return self.table.read(self.table.state(), "rows")


class PredictionLog:
    """SNK-6: served predictions, appended with the time they were made and their JSON snapshots.

    A prediction is stored once, under its id; rows without one (tickers that
    could not be served) are not. Readers see one commit, with null in rows
    that are older than a column.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.log = KeyLog(spark, path, key="prediction_id", buckets=64)

    def append(self, predictions: DataFrame, features: DataFrame, created_at: Column, batch: str) -> None:
        """Store new predictions with ``created_at``, ``prediction_json`` and ``features_json`` (the ticker's row of ``features``)."""
        served = predictions.filter(F.col("prediction_id").isNotNull())
        snapshot = F.to_json(F.struct(*[F.col(c) for c in sorted(predictions.columns)]))
        rows = served.withColumn("created_at", created_at.cast("timestamp")).withColumn("prediction_json", snapshot)
        inputs = features.select("ticker", F.to_json(F.struct(*[F.col(c) for c in sorted(features.columns)])).alias("features_json"))
        rows = rows.join(inputs.dropDuplicates(["ticker"]), "ticker", "left")
        self.log.append(self.log.unseen(rows.dropDuplicates(["prediction_id"])), batch)

    def read(self) -> DataFrame | None:
        return self.log.read()


FILTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("_word", T.IntegerType()), T.StructField("_bits", T.LongType())])


class KeyLog:
    """JOIN-9, STR-M1: an append-only log whose keys are looked up without reading all of it.

    Rows are dealt to buckets by a hash of their key. Beside each bucket stands
    a filter: 64-bit words, in one of which a key sets four bits. A run reads
    the filter words of its own buckets, then the keys of only those buckets in
    which one of its keys may stand. Filters that many keys have filled let
    more buckets be read; the result stays exact.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "dedupe_key", buckets: int = 256, words: int = 4096, most_folders: int = 16):
        self.table, self.key, self.buckets, self.words, self.most_folders = SnapshotTable(spark, path), key, buckets, words, most_folders

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, hash_bucket([self.key], self.buckets))

    def _probes(self, keys: DataFrame) -> DataFrame:
        """Bucket, word and bits of each key."""
        h = F.xxhash64(self.key, F.lit(1))
        one = F.lit(1).cast("long")
        bits = None
        for shift in (0, 6, 12, 18):
            bit = F.call_function("shiftleft", one, F.pmod(F.shiftright(h, shift), F.lit(64)).cast("int"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
        return self._dealt(keys.select(self.key)).withColumn("_word", F.pmod(F.shiftrightunsigned(h, 24), F.lit(self.words)).cast("int")).withColumn("_bits", bits)

    def _filter(self, state: dict, buckets: Iterable) -> DataFrame | None:
        words = self.table.read(state, "filter", buckets)
        return None if words is None else words.withColumnRenamed("bucket", BUCKET)

    def possible_buckets(self, state: dict, keys: DataFrame) -> list[int]:
        """Buckets in which one of the keys may stand."""
        probes = self._probes(keys)
        words = self._filter(state, self.table.buckets_of(probes))
        if words is None:
            return []
        held = words.groupBy(BUCKET, "_word").agg(F.bit_or("_bits").alias("_held"))
        return self.table.buckets_of(probes.join(held, [BUCKET, "_word"]).filter(F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits")))

    def stored_keys(self, state: dict, buckets: Iterable[int]) -> DataFrame | None:
        rows = self.table.read(state, "rows", buckets)
        return None if rows is None else rows.select(self.key)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not in the log."""
        state = self.table.state()
        near = self.possible_buckets(state, rows)
        return rows.join(self.stored_keys(state, near), self.key, "left_anti") if near else rows

    def append(self, rows: DataFrame, batch: str, meta: dict | None = None) -> None:
        """Add rows with new keys, and their filter words, in one commit."""
        state = self.table.state()
        if state["meta"].get("last") == batch:
            return
        added = self.table.write("rows", self._dealt(rows), batch)
        stored = self.table.read({"sets": {"rows": added}, "schemas": {"rows": json.loads(rows.schema.json())}}, "rows")
        words = self._probes(stored).groupBy(BUCKET, "_word").agg(F.bit_or("_bits").alias("_bits"))
        full = [b for b, folders in state["sets"].get("filter", {}).items() if b in added and len(folders) >= self.most_folders]
        if full:
            # buckets whose filter stands in many folders get one of all of them
            words = words.unionByName(self._filter(state, full)).groupBy(BUCKET, "_word").agg(F.bit_or("_bits").alias("_bits"))
        filters = self.table.write("filter", words.withColumn("bucket", F.col(BUCKET)), batch)
        more = {b: f for b, f in filters.items() if b not in full}
        whole = {b: f for b, f in filters.items() if b in full}
        self.table.commit(state, batch, {"rows": rows.schema, "filter": FILTER}, append={"rows": added, "filter": more}, replace={"filter": whole}, meta={**(meta or {}), "last": batch})

    def read(self) -> DataFrame | None:
        return self.table.read(self.table.state(), "rows")
