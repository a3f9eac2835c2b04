"""The engine's tables on disk: folders of Parquet with snapshots.

A table is ``root/name/v<N>``; a write goes to the next N and is seen when its
``_SUCCESS`` is there, so readers are never in its way. Logs and per-scan tables
are appended as further parts of the current snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorlake.operators import caches
from mirrorlake.sources.schemas import TABLES

BY_SCAN = ("files", "groups", "suggestions", "actions", "dir_cache")


class Store:
    """Tables of :data:`mirrorlake.sources.schemas.TABLES` below a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str) -> tuple[object, object]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(v[1:]) for v in found if v[:1] == "v" and v[1:].isdigit() and fs.exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame:
        """The current snapshot; an empty table if there is none yet."""
        made = self._versions(name)
        if not made:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{made[-1]}")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

    def append(self, name: str, rows: DataFrame) -> None:
        made = self._versions(name)
        self._shaped(name, rows).write.mode("append").parquet(f"{self.root}/{name}/v{made[-1] if made else 1}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new snapshot; the one before it stays for whoever reads it, older ones go."""
        made = self._versions(name)
        self._shaped(name, rows).write.parquet(f"{self.root}/{name}/v{made[-1] + 1 if made else 1}")
        for old in made[:-1]:
            fs, p = self._fs(f"{self.root}/{name}/v{old}")
            fs.delete(p, True)

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1

    def set_states(self, states: Mapping[int, str]) -> None:
        """Append changes of files' states; :meth:`files` shows the latest."""
        if states:
            seq = (self.read("status_log").agg(F.max("seq")).first()[0] or 0) + 1
            self.append("status_log", self.spark.createDataFrame([(i, s, seq) for i, s in states.items()], TABLES["status_log"]))

    def files(self, scan_id: int | None = None) -> DataFrame:
        rows = self.read("files") if scan_id is None else self.read("files").filter(F.col("scan_id") == scan_id)
        return caches.current_status(rows, self.read("status_log"))

    def prune(self, keep: int = 3, existing: DataFrame | None = None) -> dict[str, int]:
        """Drop all but the latest scans, and with ``existing`` (path) cache entries of other paths. Returns what went."""
        report = caches.prune_report(self.read("scans"), self.read("files"), self.read("groups"), keep).first().asDict()
        gone = caches.prune_plan(self.read("scans"), keep).filter("doomed").select("id")
        ids = [r.id for r in gone.collect()]  # one id a scan
        report["cache"] = 0
        if ids:
            stay = lambda name, key: self.read(name).filter(~F.col(key).isin(ids))
            members = self.read("group_members").join(self.read("groups").filter(F.col("scan_id").isin(ids)).select(F.col("id").alias("group_id")), "group_id", "left_anti")
            self.replace("group_members", members)
            for name in ("groups", "suggestions", "files", "dir_cache"):
                self.replace(name, stay(name, "scan_id"))
            self.replace("scans", stay("scans", "id"))
        if existing is not None:
            lost = caches.stale(self.read("hash_cache"), existing)
            report["cache"] = lost.count()
            self.replace("verify_cache", caches.invalidate_verified(self.read("verify_cache"), lost))
            self.replace("hash_cache", caches.invalidate(self.read("hash_cache"), lost))
        return report

    def compact(self) -> None:
        """Rewrite the logs as their latest rows, in fewer files."""
        self.replace("hash_cache", caches.hash_upsert(self.read("hash_cache")))
        self.replace("dir_cache", caches.dir_upsert(self.read("dir_cache")))
        self.replace("verify_cache", caches.verify_upsert(self.read("verify_cache")))
