"""Tables that a multi-step operator writes between its steps.

Every step is written as Parquet in the shared folder that the cluster names in
``spark.checkpoint.dir``. A lost executor then costs the tasks of the step that runs,
never the lineage of earlier ones. Only where that setting is absent and the session runs
in one process (tests) a temporary folder is taken; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="glyphflow-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


class Workspace:
    """Tables of one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes the rows, and returns them as read from the table."""
        self._count += 1
        path = f"{self.root}/t{self._count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            self._delete(table.staged_at)

    def finish(self, df: DataFrame) -> DataFrame:
        """Writes the result beside the run's folder and deletes the folder."""
        path = f"{self.root}-result"
        df.write.parquet(path)
        self._delete(self.root)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, most_bytes: int = 8 << 20) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows prove it small.

    The count comes from Parquet footers. Beyond the bound the table is returned as it
    is, and the join shuffles.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() * row_bytes <= most_bytes else df


def one_partition(df: DataFrame, text: str = "", most: int = 1 << 16, most_bytes: int = 16 << 20) -> DataFrame:
    """A staged table as one partition, if its counted rows and the bytes of its text column prove it small.

    Joins and groups among such tables need no shuffle, so that many small steps do not
    cost a task for each shuffle partition. Beyond the bounds the table is returned as it is.
    """
    from pyspark.sql import functions as F

    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else F.lit(0)
    rows, total = df.agg(F.count("*"), size).first()
    if rows > most or total > most_bytes:
        return df
    out = df.coalesce(1)
    out.staged_at = df.staged_at
    out.is_one = True
    return out
