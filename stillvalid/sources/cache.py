"""Tables kept across sessions in a shared folder, found again by what they were made from.

A table's place is a digest of its recipe (stream parameters, the query over the source) and of the source's
files (path, length, time of change), so another parameter or a changed source is another place and nothing is
ever updated. A table is written under a name of its own and appears under its final name by one rename, with a
manifest; of two sessions that build the same table, the second one to finish uses the first one's. Any store
that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import write_parquet

#: Part of every key: tables of another layout are not found.
LAYOUT = 1
MANIFEST = "_MANIFEST.json"


class TableCache:
    """Published tables under ``root``; ``built`` and ``reused`` name what this object has made and found."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.built: list[str] = []
        self.reused: list[str] = []
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    # -- keys --------------------------------------------------------------------------------
    def snapshot(self, source: DataFrame) -> list[tuple[str, int, int]]:
        """(path, length, time of change) of every file the source reads."""
        files = sorted(source.inputFiles())
        if not files:
            raise ValueError("the source reads no files: it has no state that a later session could compare")
        wanted, out = set(files), []
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            for status in self._fs(folder).listStatus(self._path(folder)):
                name = f"{folder}/{status.getPath().getName()}"
                if name in wanted:
                    out.append((name, int(status.getLen()), int(status.getModificationTime())))
        return out

    def key(self, source: DataFrame, recipe: str) -> str:
        """Digest of the recipe, the source's query and its files."""
        # Column numbers differ from session to session.
        plan = re.sub(r"#\d+L?", "", source._jdf.queryExecution().analyzed().toString())
        parts = [LAYOUT, recipe, plan, self.snapshot(source)]
        return hashlib.sha256(json.dumps(parts).encode()).hexdigest()

    # -- publishing --------------------------------------------------------------------------
    def _manifest(self, folder: str) -> dict | None:
        fs, at = self._fs(folder), self._path(f"{folder}/{MANIFEST}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folder(self, key: str, label: str, write: Callable[[str], dict | None]) -> tuple[str, dict]:
        """Folder and manifest of a published table; ``write`` fills a new one if there is none."""
        place = f"{self.root}/{key}/{label}"
        found = self._manifest(place)
        if found is not None:
            self._fs(place).setTimes(self._path(f"{place}/{MANIFEST}"), int(time.time() * 1000), -1)
            self.reused.append(label)
            return place, found
        own = f"{self.root}/{key}/.{label}-{uuid.uuid4().hex}"
        manifest = {"label": label, "key": key, "made": time.time(), **(write(own) or {})}
        fs = self._fs(own)
        fs.mkdirs(self._path(own))
        out = fs.create(self._path(f"{own}/{MANIFEST}"))
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._renamed(own, place):
            fs.delete(self._path(own), True)
            self.reused.append(label)
            return place, self._manifest(place) or manifest
        self.built.append(label)
        return place, manifest

    def _renamed(self, own: str, place: str) -> bool:
        """Move a folder to its final name; False if that exists already."""
        package = self._jvm.org.apache.hadoop.fs
        context = package.FileContext.getFileContext(self._path(own).toUri(), self._conf) if ":" in own else (
            package.FileContext.getFileContext(self._fs(own).getUri(), self._conf))
        none = self.spark.sparkContext._gateway.new_array(getattr(package, "Options$Rename"), 0)
        try:
            context.rename(self._path(own), self._path(place), none)
            return True
        except Exception:
            if self._manifest(place) is None:
                raise
            return False

    def table(self, key: str, label: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The published table of this label, made on first use in any session."""
        def write(path: str) -> dict:
            df = make()
            write_parquet(df, path, partition_by=partition_by)
            return {"schema": df.schema.json(), "partition_by": list(partition_by)}

        place, manifest = self.folder(key, label, write)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(manifest["schema"]))).parquet(place)

    # -- upkeep ------------------------------------------------------------------------------
    def entries(self) -> list[dict]:
        """Key, labels and last use (seconds since 1970) of everything published."""
        fs, root, out = self._fs(self.root), self._path(self.root), []
        for at in fs.listStatus(root) if fs.exists(root) else ():
            used, labels = 0.0, []
            for sub in fs.listStatus(at.getPath()):
                mark = self._path(f"{sub.getPath()}/{MANIFEST}")
                if not sub.getPath().getName().startswith(".") and fs.exists(mark):
                    labels.append(sub.getPath().getName())
                    used = max(used, fs.getFileStatus(mark).getModificationTime() / 1000)
            out.append({"key": at.getPath().getName(), "labels": sorted(labels), "used": used})
        return out

    def evict(self, unused_for: float) -> list[str]:
        """Delete the tables of keys that no session has used for so many seconds; their keys."""
        gone = [e["key"] for e in self.entries() if e["labels"] and time.time() - e["used"] >= unused_for]
        for key in gone:
            self._fs(self.root).delete(self._path(f"{self.root}/{key}"), True)
        return gone
