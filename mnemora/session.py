"""What a session needs from its surroundings: the package on its workers, and a shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_lasting: list[str] = []


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if they see that folder.

    On a cluster whose executors don't, ship the package (--py-files) as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a temporary folder is made if everything runs on this machine (master
    local); on a cluster each executor would write to its own disk, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A path in the shared folder that nothing else uses; `clean` removes what is written there, if it is lasting only when told."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (_lasting if lasting else _written).append(path)
    return path


def stored(df: DataFrame, label: str = "step", temporary: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts long plans, outlives executors.

    Its path is added to `temporary`, for `remove` once nothing reads the table any more.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    if temporary is not None:
        temporary.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt by columns to several tasks a core: a table of few bytes is read by one task, however long its rows then take."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def dealt(rows: DataFrame, *by: str, total: int = 0, most: int = 1_500_000) -> DataFrame:
    """rows dealt by columns to spark.sql.shuffle.partitions tasks, four a core at least, whatever their bytes.

    Where the number is not given, Spark puts parts together up to 64 MB as written, which packed keys make millions of rows to sort.
    With the total of rows, a task gets about `most` of them, however many there are.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-total // most)), *by)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        for known in (_written, _lasting):
            if path in known:
                known.remove(path)


def clean(spark: SparkSession, lasting: bool = False) -> None:
    """Deletes every intermediate table that this process has written and that is still there; lasting: indexes too.

    A DataFrame that was returned before may read one of them: call this when no result is needed any more.
    """
    remove(spark, [*_written, *(_lasting if lasting else [])])
