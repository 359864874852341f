"""Tables that a plan is cut at, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROW_GROUP_BYTES = 8 << 20  # what a task holds of a table before it writes it out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder of this run, on one machine alone."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` once as Parquet (with the writer's ``options``) in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation. Row groups have about ROW_GROUP_BYTES.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"parquet.block.size": ROW_GROUP_BYTES} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quire_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
