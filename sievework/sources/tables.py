"""Keyed stores as versioned Parquet: registry, chunk collections, aliases, caches with expiry."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def merge(old: DataFrame | None, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Upsert: the last write of a key wins; `order` decides among several new rows of a key."""
    newest = new if order is None else new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_r = 1").drop("_r")
    if old is None:
        return newest
    return old.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def replace_documents(old: DataFrame | None, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Chunks after an ingest: all chunks of touched documents go, so that an edit leaves nothing behind."""
    return new if old is None else old.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by_doc(chunks: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, int]:
    """The chunks without the documents' ones, and how many went."""
    gone = chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").count()
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti"), gone


class Conflict(RuntimeError):
    """Another writer committed first."""


class Collections:
    """Versioned tables below a folder, named by aliases.

    A version is a list of folders. What an alias stands for is in its newest pointer file, `_alias_{alias}.{number}`: a commit writes
    a temporary file and renames it to the next number, which fails if somebody else took it. So readers see the old version
    or the new one and never none, an append adds one folder without touching the others, and pointers of the last `keep`
    versions stay for readers that still hold them; older ones go, and with them the folders that no pointer names.
    """

    #: Folders of one version before an append gathers them into one.
    MOST_PARTS = 32

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)

    # --- files, through Hadoop's file systems ---

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        fs, root = self._fs(), self._path("x").getParent()
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _pointers(self, alias: str) -> list[int]:
        found = (re.fullmatch(rf"_alias_{re.escape(alias)}\.(\d+)", n) for n in self._names())
        return sorted(int(m[1]) for m in found if m)

    def _load(self, alias: str, number: int) -> list[str]:
        stream = self._fs().open(self._path(f"_alias_{alias}.{number:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, alias: str, parts: list[str], after: int) -> None:
        """Makes parts what alias stands for, as the version after number `after`; Conflict if there is one already."""
        jvm = self.spark.sparkContext._jvm
        temporary = f"_tmp_{uuid.uuid4().hex}"
        stream = self._fs().create(self._path(temporary), False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("x").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(temporary), self._path(f"_alias_{alias}.{after + 1:012d}"), none)
        except Exception as e:
            self.remove(temporary)
            if "AlreadyExists" in str(e) or "exist" in str(e).lower():
                raise Conflict(f"{alias}: version {after + 1} was committed by another writer") from e
            raise
        self._retain(alias)

    def _retain(self, alias: str) -> None:
        """Removes pointers before the last `keep`, and this alias's folders that no pointer names."""
        numbers = self._pointers(alias)
        for n in numbers[: -self.keep]:
            self.remove(f"_alias_{alias}.{n:012d}")
        used = {p for n in numbers[-self.keep :] for p in self._load(alias, n)}
        newest = max((self._version(alias, p) for p in used), default=0)
        for name in self.list():
            # A folder above the newest committed one may be a version that is being built.
            if name not in used and 0 < self._version(alias, name) < newest:
                self.remove(name)

    @staticmethod
    def _version(alias: str, name: str) -> int:
        m = re.fullmatch(rf"{re.escape(alias)}_v(\d+)", name)
        return int(m[1]) if m else 0

    # --- names and reads ---

    def list(self) -> list[str]:
        return [n for n in self._names() if not n.startswith("_")]

    def parts(self, alias: str) -> list[str]:
        """The folders that an alias stands for now; none if it isn't known."""
        for _ in range(3):  # a pointer may be retired between listing and reading
            numbers = self._pointers(alias)
            try:
                return self._load(alias, numbers[-1]) if numbers else []
            except Exception:
                if self._pointers(alias) == numbers:
                    raise
        raise RuntimeError(f"{alias} changes too often to be read")

    def target(self, alias: str) -> str | None:
        """The (first) folder of an alias."""
        return next(iter(self.parts(alias)), None)

    def resolve(self, name: str) -> str:
        """An alias's target; any other name stands for itself."""
        return self.target(name) or name

    def read(self, name: str) -> DataFrame:
        """A version's rows; columns that an appended part lacks are null there."""
        parts = self.parts(name) or [name]
        reader = self.spark.read if len(parts) == 1 else self.spark.read.option("mergeSchema", "true")
        return reader.parquet(*(f"{self.root}/{p}" for p in parts))

    def count(self, name: str) -> int:
        return self.read(name).count()

    # --- writes ---

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None, new: bool = False) -> None:
        """rows as a folder; with `new` a folder of that name that another writer made meanwhile is a Conflict."""
        writer = rows.write.mode("error" if new else "overwrite")
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if new and "PATH_ALREADY_EXISTS" in str(e):
                raise Conflict(f"{name} was written by another writer") from e
            raise

    def switch(self, alias: str, *targets: str) -> None:
        self._commit(alias, list(targets), max(self._pointers(alias), default=0))

    def next_version(self, alias: str) -> str:
        return f"{alias}_v{max((self._version(alias, n) for n in self.list()), default=0) + 1}"

    def reindex(self, alias: str, build, validate=None) -> str:
        """Blue/green: build the next version, validate it, then switch; a failure leaves the alias as it was."""
        after = max(self._pointers(alias), default=0)
        name = self.next_version(alias)
        self.write(name, build(), new=True)
        if validate is not None and not validate(self.read(name)):
            raise ValueError(f"{name} isn't valid")
        self._commit(alias, [name], after)
        return name

    def append(self, alias: str, rows: DataFrame) -> str:
        """Adds rows as a folder of its own; what is there isn't rewritten, but for gathering many small parts into one now and then."""
        after = max(self._pointers(alias), default=0)
        old = self.parts(alias)
        name = self.next_version(alias)
        if len(old) >= self.MOST_PARTS:
            self.write(name, self.read(alias).unionByName(rows, allowMissingColumns=True), new=True)
            self._commit(alias, [name], after)
        else:
            self.write(name, rows, new=True)
            self._commit(alias, [*old, name], after)
        return name

    def rollback(self, alias: str, to: str) -> None:
        """Makes a kept version the alias's again."""
        if to not in self.list():
            raise ValueError(f"{to} isn't there any more")
        self.switch(alias, to)


def live(entries: DataFrame, now: Column) -> DataFrame:
    """Cache entries that haven't expired; a null or zero time to live never does."""
    return entries.where(F.coalesce(F.col("ttl_s"), F.lit(0)).eqNullSafe(0) | (F.col("stored_at") + F.col("ttl_s") > now))


def cache_key(namespace: str, version: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{namespace}:{version}:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def delete_namespace(entries: DataFrame, namespace: str) -> DataFrame:
    return entries.where(~F.col("key").startswith(f"{namespace}:"))


class CacheStore:
    """Keyed values with expiry, a collection below a folder: reads see live entries, a write replaces its keys.

    Keys are namespace:version:hash, so a new version of a model or prompt misses, and a namespace can go as a whole.
    """

    SCHEMA = "key string, value string, stored_at double, ttl_s int"

    def __init__(self, spark: SparkSession, root: str, name: str = "cache", keep: int = 2):
        self.store, self.name, self.spark = Collections(spark, root, keep), name, spark

    def entries(self) -> DataFrame:
        return self.store.read(self.name) if self.store.target(self.name) else self.spark.createDataFrame([], self.SCHEMA)

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """keys(key, ...) with value, null where there is no live entry."""
        return keys.join(live(self.entries(), now).select("key", "value"), "key", "left")

    def set(self, rows: DataFrame, now: Column, ttl_s: int | None = None) -> None:
        """Stores rows(key, value); dead entries go at the same time."""
        new = rows.select("key", "value", now.cast("double").alias("stored_at"), F.lit(ttl_s).cast("int").alias("ttl_s")).dropDuplicates(["key"])
        old = live(self.entries(), now)
        self.store.reindex(self.name, lambda: merge(old, new, "key"))

    def delete_namespace(self, namespace: str) -> int:
        """Removes a namespace's entries and says how many there were."""
        old = self.entries()
        left = delete_namespace(old, namespace)
        gone = old.count() - left.count()
        if gone:
            self.store.reindex(self.name, lambda: left)
        return gone
