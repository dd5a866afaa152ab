"""Where jobs of this subpackage cut lineage: the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds between collections on the driver.
COLLECT_EVERY = 2.0
_collected = [0.0]
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session. Without one, a job on a cluster ends here: tables in machine-local folders would be
    scattered. Local masters get a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-checkpoint"
    return folder.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names like ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * i for i in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so that nothing before it runs again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # Shuffle files of finished steps go when the driver's JVM collects the plans that made them.
    if time.monotonic() > _collected[0] + COLLECT_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Rows go to Python in batches of about ``size`` bytes, for the rest of the session and unless it has a bound of its own. A
    batch is held several times on each side, and 10 000 texts, Spark's bound, may have any size."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(size))


def discard(df: DataFrame) -> None:
    """Delete the files of a table from :func:`written` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("quire-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
