"""Versioned Parquet tables and published snapshots: data first, pointer last."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

KEPT, MOST_PARTS = 3, 16
#: Columns of a staged version that say how each row got there; readers do not see them.
TRACE = ("_action", "_withdrawn")


class Busy(RuntimeError):
    """Another writer holds the table."""


class Table:
    """Versions of a table; CURRENT says which is visible, so readers never see a half-written one.

    A version is a list of parts.  Part ``v<N>`` was written with version N and may have lost partitions since then, which are
    named in small tables beside it.  So a batch that only adds rows or replaces partitions writes these rows and not the table;
    what rewrites rows anywhere writes a version of one part.  After MOST_PARTS parts a version is written whole again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)

    def _state(self) -> dict:
        return json.loads(self.files.read(f"{self.root}/CURRENT") or '{"version": 0, "parts": []}')

    @property
    def version(self) -> int:
        return self._state()["version"]

    def _frame(self, parts: list[dict], fresh: str | None = None) -> DataFrame:
        """The rows of some parts; with ``fresh``, rows of other parts carry no trace of how they once got there."""
        found = []
        for p in parts:
            df = self.spark.read.parquet(f"{self.root}/{p['path']}")
            if fresh is not None and p["path"] != fresh:
                df = df.drop(*TRACE).withColumn("_action", F.lit("untouched"))
            for g in p["gone"]:
                gone = F.broadcast(self.spark.read.parquet(f"{self.root}/{g}"))  # one row per replaced partition
                same = [df[c].eqNullSafe(gone[c]) for c in gone.columns]
                df = df.join(gone, reduce(lambda a, b: a & b, same), "left_anti")
            found.append(df if fresh is not None else df.drop(*TRACE))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def read(self) -> DataFrame:
        parts = self._state()["parts"]
        if not parts:
            raise FileNotFoundError(self.root)
        return self._frame(parts)

    def stage(self, df: DataFrame) -> tuple[dict, DataFrame]:
        """Writes the next version whole without making it visible; gives it and its rows as written, traces included."""
        n = self.version + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{n}")
        state = {"version": n, "parts": [{"path": f"v{n}", "gone": []}]}
        return state, self._frame(state["parts"], f"v{n}")

    @property
    def many_parts(self) -> bool:
        return len(self._state()["parts"]) >= MOST_PARTS

    def stage_more(self, rows: DataFrame, gone: DataFrame | None = None) -> tuple[dict, DataFrame]:
        """As ``stage``, for a version that adds ``rows`` to the visible one after its partitions in ``gone`` are taken out."""
        now = self._state()
        n = now["version"] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/v{n}")
        lost = []
        if gone is not None:
            gone.distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v{n}.gone")
            lost = [f"v{n}.gone"]
        parts = [{"path": p["path"], "gone": p["gone"] + lost} for p in now["parts"]]
        state = {"version": n, "parts": [*parts, {"path": f"v{n}", "gone": []}]}
        return state, self._frame(state["parts"], f"v{n}")

    def release(self, state: dict) -> int:
        """Makes a staged version the visible one; a crash before that leaves the old version current."""
        n, text = state["version"], json.dumps(state)
        self.files.write(f"{self.root}/v{n}.json", text)
        self.files.write(f"{self.root}/CURRENT", text)
        names = self.files.names(self.root)
        versions = [x for x in names if x.endswith(".json")]
        kept = [x for x in versions if n - KEPT < int(x[1:-5]) <= n]
        used = {"CURRENT", "LEASE", *kept}
        for x in kept:
            for p in json.loads(self.files.read(f"{self.root}/{x}") or text)["parts"]:
                used |= {p["path"], *p["gone"]}
        for x in names:
            if x not in used and x.startswith("v"):
                self.files.delete(f"{self.root}/{x}")
        return n

    def commit(self, df: DataFrame) -> int:
        return self.release(self.stage(df)[0])

    @contextlib.contextmanager
    def lease(self, hours: float = 6.0) -> Iterator[None]:
        """Keeps other writers out; one that is older than ``hours`` was left by a crash and is taken over."""
        path, mine = f"{self.root}/LEASE", f"{uuid.uuid4().hex} {time.time()}"
        if not self.files.write(path, mine, new=True):
            held = (self.files.read(path) or "").split()
            if len(held) == 2 and time.time() - float(held[1]) < hours * 3600:
                raise Busy(f"{self.root} is being written")
            self.files.write(path, mine)
            if self.files.read(path) != mine:
                raise Busy(f"{self.root} is being written")
        try:
            yield
        finally:
            if self.files.read(path) == mine:
                self.files.delete(path)


def _hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to sha256 of a folder's data files, hashed in tasks."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return {os.path.basename(r.path): r.digest for r in found.select("path", F.sha2("content", 256).alias("digest")).collect()}


def publish(tables: dict[str, DataFrame], root: str, snapshot: str, headlines: dict | None = None, published_at: str | None = None) -> dict:
    """A snapshot folder with a manifest of hashes; the pointer CURRENT moves when everything is in place."""
    spark = next(iter(tables.values())).sparkSession
    files, digests, folder = Files(spark), {}, f"{root}/{snapshot}"
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        digests[name] = dict(sorted(_hashes(spark, f"{folder}/{name}").items()))
    stamp = published_at or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    manifest = {"snapshot": snapshot, "published_at": stamp, "files": digests, "headlines": headlines or {}}
    files.write(f"{folder}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True, default=str))
    files.write(f"{root}/CURRENT", snapshot)
    old = [s for s in files.names(root) if s != snapshot and files.exists(f"{root}/{s}/manifest.json")]
    old.sort(key=lambda s: files.modified(f"{root}/{s}/manifest.json"))
    for s in old[: max(0, len(old) - KEPT + 1)]:
        files.delete(f"{root}/{s}")
    return manifest


def manifest_of(spark: SparkSession, root: str) -> dict:
    files = Files(spark)
    return json.loads(files.read(f"{root}/{files.read(f'{root}/CURRENT').strip()}/manifest.json"))


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published tables; raises ValueError if a file is not what the manifest says."""
    manifest = manifest_of(spark, root)
    folder = f"{root}/{manifest['snapshot']}"
    for name, parts in manifest["files"].items():
        try:
            same = _hashes(spark, f"{folder}/{name}") == parts
        except Exception as e:  # checksums of the file system may see it first
            raise ValueError(f"{name} cannot be read as it was published") from e
        if not same:
            raise ValueError(f"{name} has changed since it was published")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in manifest["files"]}
