"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE, NOT_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of maximal runs of characters that are not in SPACES; null text gives null."""
    return F.array_remove(F.split(text, SPACE), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a session on one machine gets a temporary one; a cluster's executors could not see that, so there it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return jsc.getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``drop`` removes one that is done with; the rest, which results still read, goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back, with its schema.

        ``batch``: rows that go to a Python worker at a time, where rows may be long; it holds for this write alone.
        """
        self.n += 1
        path, conf, name = f"{self.root}/{self.n}", self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        try:
            if batch:
                conf.set(name, str(batch))
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(name, before)
        if self.n == 1:
            target, files = self._files(self.root)
            files.deleteOnExit(target)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "scratch_path", None)
        if path:
            target, files = self._files(path)
            files.delete(target, True)

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())


def join_skewed(rows: DataFrame, side: DataFrame, keys: list[str], n: str, heavy: int = 1000) -> DataFrame:
    """``rows`` joined with ``side``, whose column ``n`` says how many rows each key has; ``side`` has distinct keys.

    Keys with over 1/``heavy`` of all rows are fewer than ``heavy`` and are broadcast, so no task gets all rows of such a
    key; the others are joined by a shuffle.  Both are read twice: callers pass tables, not plans.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(side.where(F.col(n) * heavy > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(side.where(F.col(n) * heavy <= total), keys)
    return rows.join(hot, keys).unionByName(rest)


def bounded(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; counts no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows
