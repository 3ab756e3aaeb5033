"""Tables between two steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this application's own if all of Spark runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/driftmerge-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write df there and read it back: its lineage ends here, so a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = fresh(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete what stage() wrote for these tables; only for ones that nothing reads any more, not even lazily."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
