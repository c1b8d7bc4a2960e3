"""Session helpers: shared checkpoint folder and work paths in it."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Where none is set, a session on one machine gets a temporary folder; on a cluster that is an error,
    because executors could not read what others wrote.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, path: str) -> bool:
    """Whether something was written at a path (any store the session can reach)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def checkpoint(df: DataFrame, eager: bool = True, release: bool = False) -> DataFrame:
    """Cut lineage through the shared checkpoint folder.

    release: let the driver collect its garbage at once, whereupon Spark drops the shuffle files of the jobs that are over; worth it
    behind a large shuffle, whose files would else stay beside those of the next.
    """
    shared_dir(df.sparkSession)
    out = df.select("*").checkpoint(eager)               # a plan of its own: df would hold on to its shuffles
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out
