"""Where intermediate tables go: the folder that the cluster names, never a machine-local one on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where ``spark.checkpoint.dir`` is unset, a temporary one is set on a single
    machine; on a cluster that is an error, as no other machine could read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="embedmesh-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage: a reliable checkpoint, readable after any executor is lost. It keeps the partitioning of df."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame | None) -> None:
    """Deletes the files of a saved table that nothing reads any more (a round of an iteration before the last)."""
    if df is None:
        return
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
