"""Runs of a tag as versions that become visible at once.

A writer puts the tables of a run under a folder that nobody reads, then writes a manifest beside the
visible ones and renames it to the next version's name: the rename is the commit. Readers take the
newest manifest, so they see a whole run or none of it, and never one that a killed writer left. Two
writers of one tag get two versions, whichever renames first; the other takes the next number.

    root/TAG/data-ID/NAME/...      tables (Parquet)
    root/TAG/versions/00000001     manifest: a line for each table, NAME<tab>folder

All access goes through Spark's file system, so a root may be any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.boosting import Stages


class RunStore:
    def __init__(self, spark: SparkSession, root: str, tag: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{tag}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, oldest first."""
        folder = self._path(f"{self.base}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def begin(self) -> Run:
        return Run(self, f"data-{uuid.uuid4().hex}")

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table of a version (the newest)."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no version {version or ''} under {self.base}")
        text = self._read(f"{self.base}/versions/{version or known[-1]:08d}")
        return {name: f"{self.base}/{folder}" for name, folder in (line.split("\t") for line in text.splitlines())}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.tables(version)[name])

    def load_scaler(self, version: int | None = None) -> DataFrame:
        """The one row of limits that summaries.scale and unscale take."""
        return self.read("scaler", version)

    def load_stages(self, name: str = "model", version: int | None = None) -> Stages:
        return Stages.load(self.spark, self.tables(version)[name])

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, lines: list[str]) -> int:
        folder = f"{self.base}/versions"
        self._fs.mkdirs(self._path(folder))
        draft = f"{self.base}/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        while True:
            version = max(self.versions(), default=0) + 1
            if self._renamed(draft, f"{folder}/{version:08d}"):
                return version

    def _renamed(self, source: str, target: str) -> bool:
        """False if the target is there already: a rename never replaces a version."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self.spark._jsc.hadoopConfiguration())
        none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(source), self._path(target), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise


class Run:
    """Tables of a run that is being written; nothing of it is visible before commit()."""

    def __init__(self, store: RunStore, folder: str):
        self.store, self.folder, self.lines = store, folder, []

    def _add(self, name: str) -> str:
        if not name or "\t" in name or "\n" in name or "/" in name:
            raise ValueError(f"bad table name {name!r}")
        self.lines.append(f"{name}\t{self.folder}/{name}")
        return f"{self.store.base}/{self.folder}/{name}"

    def save(self, name: str, df: DataFrame) -> Run:
        df.write.parquet(self._add(name))
        return self

    def save_scaler(self, params: DataFrame) -> Run:
        """params: the row of summaries.scaler_fit."""
        return self.save("scaler", params)

    def save_stages(self, model: Stages, name: str = "model") -> Run:
        model.save(self.store.spark, self._add(name))
        return self

    def commit(self) -> int:
        """Makes the run visible; returns its version."""
        return self.store._commit(self.lines)
