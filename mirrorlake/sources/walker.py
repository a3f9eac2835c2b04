"""A folder tree as a table, read by Spark's Python data source API.

Folders are listed on the driver from the root on until there are some dozens of
branches, each of which is a task, so a tree of one folder below the root is shared
out as well. Only the catalogue is read here; :func:`hashed` adds signatures, on the
executors.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mirrorlake.functions.signatures import EDGE
from mirrorlake.operators import exact
from mirrorlake.options import ScanOptions

#: Branches that a tree is parted into, as far as it has so many folders.
BRANCHES = 64
SCHEMA = "path string, parent string, name string, ext string, size long, mtime double, dev long, inode long, nlink long"


def resolved(path: str, roots: tuple[str, ...]) -> str:
    """The real path, which must be one of the roots that exist or lie below one; without roots anything goes."""
    real = os.path.realpath(path)
    if roots and not any(real == r or real.startswith(r.rstrip("/") + "/") for r in available_roots(roots)):
        raise PermissionError(f"{path} lies outside the roots")
    return real


def available_roots(roots: tuple[str, ...]) -> list[str]:
    """Real paths of the roots that are folders, each once, in order."""
    return list(dict.fromkeys(os.path.realpath(r) for r in roots if os.path.isdir(r)))


class _Branch(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Walk(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.dirs = set(options.get("excludedirs", "").split("\n"))
        globs = [g for g in options.get("excludeglobs", "").split("\n") if g]
        self.globs = "|".join(fnmatch.translate(g) for g in globs)
        self.least, self.most = int(options.get("minsize", 0)), int(options.get("maxsize", 0))
        self.follow = options.get("followsymlinks", "false").lower() == "true"
        self.folders = options.get("folders", "false").lower() == "true"

    def _entries(self, path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            return []

    def _subfolder(self, e: os.DirEntry) -> bool:
        try:
            return (self.follow or not e.is_symlink()) and e.is_dir(follow_symlinks=self.follow) and e.name not in self.dirs
        except OSError:
            return False

    def partitions(self) -> list[InputPartition]:
        alone, todo, seen = [], [self.root], set()
        while todo and len(todo) < BRANCHES and len(alone) < 4 * BRANCHES:
            here = todo.pop(0)
            try:
                st = os.stat(here)
            except OSError:
                continue
            if (st.st_dev, st.st_ino) in seen:
                continue
            seen.add((st.st_dev, st.st_ino))
            alone.append(_Branch(here, False))
            todo += [e.path for e in self._entries(here) if self._subfolder(e)]
        return [*alone, *(_Branch(p, True) for p in todo)]

    def files(self, here: str) -> Iterator[tuple]:
        """The rows of a folder's own files."""
        return self.read(_Branch(here, False))

    def read(self, partition: _Branch) -> Iterator[tuple]:
        bad = re.compile(self.globs).match if self.globs else lambda name: None
        todo, seen = [partition.path], set()
        while todo:
            here = todo.pop()
            try:
                st = os.stat(here)
            except OSError:
                continue
            if (st.st_dev, st.st_ino) in seen:
                continue
            seen.add((st.st_dev, st.st_ino))
            if self.folders:
                yield here, os.path.dirname(here), os.path.basename(here), "", 0, st.st_mtime, st.st_dev, st.st_ino, st.st_nlink
            for e in self._entries(here):
                try:
                    if e.is_symlink() and not self.follow:
                        continue
                    if e.is_dir(follow_symlinks=self.follow):
                        if partition.deep and self._subfolder(e):
                            todo.append(e.path)
                        continue
                    if self.folders or not e.is_file(follow_symlinks=self.follow) or bad(e.name):
                        continue
                    s = e.stat(follow_symlinks=self.follow)
                except OSError:
                    continue
                if s.st_size >= self.least and not (self.most and s.st_size > self.most):
                    yield e.path, here, e.name, os.path.splitext(e.name)[1].lower(), s.st_size, s.st_mtime, s.st_dev, s.st_ino, s.st_nlink


class TreeSource(DataSource):
    """Format ``tree``: options path, excludeDirs, excludeGlobs (one a line), minSize, maxSize, followSymlinks, folders."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Walk({k.lower(): v for k, v in self.options.items()})


def _options(o: ScanOptions, folders: bool) -> dict[str, str]:
    d = asdict(o)
    return {"excludeDirs": "\n".join(d["exclude_dirs"]), "excludeGlobs": "\n".join(d["exclude_globs"]), "minSize": str(o.min_size), "maxSize": str(o.max_size), "followSymlinks": str(o.follow_symlinks).lower(), "folders": str(folders).lower()}


def _read(spark: SparkSession, root: str, o: ScanOptions, folders: bool) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(**_options(o, folders)).load(resolved(root, o.roots))


def _reached(spark: SparkSession, root: str, o: ScanOptions) -> DataFrame:
    """Folders, each by its least path: by links one can be reached from several branches."""
    rows = _read(spark, root, o, True).dropDuplicates(["path"])
    return rows.groupBy("dev", "inode").agg(F.min("path").alias("path"), F.max("mtime").alias("mtime")) if o.follow_symlinks else rows


def tree(spark: SparkSession, root: str, o: ScanOptions | None = None) -> DataFrame:
    """The catalogue of a folder tree: files the options admit, each path once, hard links of one file as one.

    ``id`` is a hash of the path, so it stays the same from scan to scan.
    """
    o = o or ScanOptions()
    rows = _read(spark, root, o, False).dropDuplicates(["path"])
    if o.follow_symlinks:
        rows = rows.join(_reached(spark, root, o).select(F.col("path").alias("parent")), "parent", "left_semi")
    return _identified(rows)


def _identified(rows: DataFrame) -> DataFrame:
    return exact.collapse_hardlinks(rows).withColumn("id", F.shiftrightunsigned(F.xxhash64("path"), 2))


def listing(dirs: DataFrame, o: ScanOptions | None = None) -> DataFrame:
    """What :func:`tree` has of the files that lie in the folders (path) themselves; no others are looked at."""
    walk = _Walk({k.lower(): v for k, v in (_options(o or ScanOptions(), False) | {"path": ""}).items()})
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for here in b["path"]:
                if rows := list(walk.files(here)):
                    yield pd.DataFrame(rows, columns=names)

    return _identified(dirs.select("path").distinct().mapInPandas(run, SCHEMA))


def existing(paths: DataFrame) -> DataFrame:
    """Those of the (path) that are there, as the executors see it."""
    there = F.pandas_udf(lambda s: s.map(os.path.lexists), "boolean")
    return paths.select("path").distinct().filter(there("path"))


def folders(spark: SparkSession, root: str, o: ScanOptions | None = None) -> DataFrame:
    """(path, mtime) of all folders of the tree."""
    return _reached(spark, root, o or ScanOptions()).select("path", "mtime")


def hashed(files: DataFrame, kind: str, most: int = 0) -> DataFrame:
    """``files`` with ``kind`` (quick, md5, strong or fuzzy) of each file, read in pieces where it lies; null if unreadable.

    Executors must see the paths. Whole files are never held in memory, but for
    the part that a fuzzy signature is made of.
    """

    def run(paths: pd.Series, sizes: pd.Series) -> pd.Series:
        import hashlib

        from mirrorlake.functions import ctph

        def one(path: str, size: int) -> str | None:
            try:
                with open(path, "rb") as f:
                    if kind == "quick":
                        h = hashlib.md5(str(size).encode() + f.read(EDGE))
                        if size > 2 * EDGE:
                            f.seek(-EDGE, os.SEEK_END)
                            h.update(f.read(EDGE))
                        return h.hexdigest()
                    if kind == "fuzzy":
                        return ctph.signature(f.read(most or -1), size, most)
                    h = hashlib.md5() if kind == "md5" else hashlib.sha512()
                    while piece := f.read(1 << 20):
                        h.update(piece)
                    return h.hexdigest()
            except OSError:
                return None

        return pd.Series([one(p, int(s)) for p, s in zip(paths, sizes, strict=True)], dtype=object)

    made = F.pandas_udf(run, "string")(F.col("path"), F.col("size"))
    known = F.col(kind) if kind in files.columns else F.lit(None).cast("string")
    return files.withColumn(kind, F.coalesce(known, made))
