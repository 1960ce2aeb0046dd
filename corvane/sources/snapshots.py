"""Versioned tables without a table format (SNK-1..9): Parquet segments and a log of manifests.

A version is a manifest `_log/00000001.json`, `_log/00000002.json`, ...: a list of segments, each with a folder
of rows, a folder of deleted keys, or both. Keys deleted by a segment delete rows of the segments before it. A change
writes a segment of the changed rows only; the last segments are merged when the one before them is not over
four times their size, so that there are logarithmically many and a row is rewritten that often. Manifests
are created under a name that must not exist yet: a reader sees the old version or the new one, of two writers
one starts over from the other's version, and a failed write leaves nothing but folders to purge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROWTH = 4  # a segment is at least so many times the size of all behind it

Segment = dict


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _write_text(self, name: str, text: str, *, new: bool = False) -> bool:
        """Write a small file in one step; with `new`, only if there is none of that name."""
        temporary = self._fs.makeQualified(self._path(f".{uuid.uuid4().hex}"))
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._fs.makeQualified(self._path(name))
        self._fs.mkdirs(target.getParent())
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 0 if new else 1)
        if not new:
            options[0] = kind.OVERWRITE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temporary, target, options)
        except Py4JJavaError as e:
            self._fs.delete(temporary, False)
            if new and self._fs.exists(target):
                return False
            raise e
        return True

    def _read_text(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder) if folder else self._jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[str]:
        return [n for n in self._names("_log") if n.endswith(".json") and not n.startswith(".")]

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def exists(self) -> bool:
        return self.current() is not None

    def segments(self, version: str | None = None) -> list[Segment]:
        version = version or self.current()
        return json.loads(self._read_text(f"_log/{version}"))["segments"] if version else []

    def _fold(self, segments: list[Segment]) -> DataFrame | None:
        """The rows of the segments that no later segment deletes."""
        load = lambda name, k: self.spark.read.parquet(f"{self.root}/{name}").withColumn("seq__", F.lit(k))
        kept = [load(s["data"], k) for k, s in enumerate(segments) if s["data"]]
        if not kept:
            return None
        rows = reduce(DataFrame.unionByName, kept)
        gone = [load(s["delete"], k) for k, s in enumerate(segments) if s["delete"] and k]
        if gone:
            key = gone[0].columns[0]
            last = reduce(DataFrame.union, gone).groupBy(F.col(key).alias("key__")).agg(F.max("seq__").alias("until__"))
            rows = rows.join(last, (rows[key] == last["key__"]) & (rows["seq__"] < last["until__"]), "left_anti")
        return rows.drop("seq__")

    def read(self, columns: list[str] | None = None, *, version: str | None = None) -> DataFrame:
        """SRC-6, SRC-7: the current version, or a named one; columns are pruned in the scan."""
        segments = self.segments(version)
        if not segments:
            raise FileNotFoundError(f"no snapshot in {self.root}")
        df = self._fold(segments)
        return df.select(*columns) if columns else df

    def _write(self, df: DataFrame, *, files: int | None = None, partition_by: list[str] | None = None) -> tuple[str, int]:
        name = f"s-{uuid.uuid4().hex}"
        writer = (df.coalesce(files) if files else df).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}")
        return name, self.spark.read.parquet(f"{self.root}/{name}").count()  # from footers

    def _merged(self, segments: list[Segment]) -> list[Segment]:
        """The segments, their tail merged where it has grown too long."""
        at, size = len(segments) - 1, segments[-1]["rows"]
        while at and segments[at - 1]["rows"] <= GROWTH * size:
            at -= 1
            size += segments[at]["rows"]
        tail = segments[at:]
        if len(tail) < 2:
            return segments
        rows, gone = self._fold(tail), [s["delete"] for s in tail if s["delete"]]
        data, n = self._write(rows) if rows is not None else (None, 0)
        delete, k = None, 0
        if at and gone:
            delete, k = self._write(reduce(DataFrame.union, [self.spark.read.parquet(f"{self.root}/{g}") for g in gone]).distinct())
        return [*segments[:at], {"data": data, "delete": delete, "rows": n + k}]

    def _commit(self, change: Callable[[list[Segment]], list[Segment]]) -> str:
        while True:
            now = self.current()
            name = f"{int(now[:8]) + 1 if now else 1:08d}.json"
            if self._write_text(f"_log/{name}", json.dumps({"segments": self._merged(change(self.segments(now)))}), new=True):
                return name

    def overwrite(self, df: DataFrame, *, partition_by: list[str] | None = None, files: int | None = None) -> str:
        """SNK-2: a new version of these rows alone; `files` compacts it (SNK-6)."""
        data, n = self._write(df, files=files, partition_by=partition_by)
        return self._commit(lambda _: [{"data": data, "delete": None, "rows": n}])

    def append(self, df: DataFrame) -> str:
        """SNK-1."""
        data, n = self._write(df)
        return self._commit(lambda old: [*old, {"data": data, "delete": None, "rows": n}])

    def upsert(self, new: DataFrame, *, key: str = "file", touched: DataFrame | None = None) -> str:
        """SNK-4: new rows in place of all old rows of their keys; `touched` adds keys that have no new rows any more."""
        data, n = self._write(new)
        keys = self.spark.read.parquet(f"{self.root}/{data}").select(key)
        delete, k = self._write((keys if touched is None else keys.union(touched.select(key))).distinct())
        return self._commit(lambda old: [*old, {"data": data, "delete": delete if old else None, "rows": n + k}])

    def delete(self, keys: DataFrame, *, key: str = "file") -> str:
        """SNK-3: any number of keys in one new version; no predicate text is built, so any name is safe."""
        delete, k = self._write(keys.select(key).distinct())
        return self._commit(lambda old: [*old, {"data": None, "delete": delete, "rows": k}])

    def prune(self, current_files: DataFrame, *, key: str = "file") -> str:
        """SNK-5: without the rows whose file is gone."""
        gone = self.read([key]).distinct().join(current_files.select(key).distinct(), key, "left_anti")
        return self.delete(gone, key=key)

    def compact(self, *, files: int | None = None) -> str:
        """SNK-6: one segment without deleted rows."""
        return self.overwrite(self.read(), files=files)

    def purge(self, keep: int = 0) -> int:
        """SNK-6: delete all versions but the current one and the `keep` before it."""
        names = self.versions()
        gone = names[: max(0, len(names) - 1 - keep)]
        needed = {f for v in names[len(gone) :] for s in self.segments(v) for f in (s["data"], s["delete"])}
        for v in gone:
            self._fs.delete(self._path(f"_log/{v}"), False)
        for folder in self._names(""):
            if folder.startswith("s-") and folder not in needed:
                self._fs.delete(self._path(folder), True)
        return len(gone)

    def mark_ready(self, signature: str) -> str:
        """SNK-7: a marker of the generation that a full run completed."""
        name = f"READY.{signature}_{self.current().removesuffix('.json')}"
        self._write_text(name, signature)
        return name

    def count(self) -> int:
        """SNK-11."""
        return self.read().count()


def signature(**constants) -> str:
    """FLT-8: sixteen hexadecimal digits of an algorithm's constants."""
    import hashlib

    return hashlib.sha256("|".join(f"{k}={constants[k]}" for k in sorted(constants)).encode()).hexdigest()[:16]


def check_signature(df: DataFrame, expected: str, column: str = "indexing_signature") -> None:
    """FLT-8: an error if rows of another algorithm are in the table."""
    other = df.where(F.col(column) != expected).select(column).limit(1).collect()
    if other:
        raise ValueError(f"the table was built with {other[0][0]}, not {expected}: rebuild it")


def append_log(df: DataFrame, path: str) -> None:
    """SNK-9: query log rows as JSON lines; a day is a folder, so old ones rotate by deletion."""
    df.withColumn("day", F.date_format(F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()), "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def rotate_log(spark: SparkSession, path: str, keep: int) -> int:
    """SNK-9: delete all but the latest `keep` days."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    days = sorted((s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("day=")), key=lambda p: p.getName())
    gone = days[: max(0, len(days) - keep)]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def save_state(df: DataFrame, path: str, *, as_json: bool = False) -> None:
    """SNK-8."""
    (df.write.mode("overwrite").json if as_json else df.write.mode("overwrite").parquet)(path)


def read_settings(path: str) -> dict:
    """SRC-8, SRC-9: a small JSON settings file, read anew at each call; keys that begin with an underscore are remarks."""
    with open(path, encoding="utf-8") as f:
        return {k: v for k, v in json.load(f).items() if not k.startswith("_")}
