"""Tables written to the shared folder, where a plan is to be worked out once and read several times."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Bytes of frames that Python gets at once.
BATCH_BYTES = 4 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table under spark.checkpoint.dir, read back: what follows may fork without working it out again.

    Where no folder is set, a temporary one is, if all runs on this machine; else a ValueError is raised.
    """
    sc = df.sparkSession.sparkContext
    base = sc.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glimmer-")
        weakref.finalize(sc, shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(f"file://{base}")
        base = sc.getCheckpointDir()
    path = f"{base}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if re.search(r"/written-[0-9a-f]{32}/[^/]*$", f)}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python rows by BATCH_BYTES at most (and a row), unless it has a lower limit already: 10,000 frames at once, Spark's default, are 80 MB of even the smallest."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
