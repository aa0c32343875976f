"""Where intermediate tables live.

Iterative jobs and tables with several readers are written once to the shared folder named by
``spark.checkpoint.dir`` and read back: that cuts the lineage, survives the loss of executors, and
gives the optimizer real sizes to decide joins on.
"""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_roots:
        root = _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="palisade-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)  # a local session's tables end with it
    return _local_roots[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once; the stored table and its folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return store(df, name)[0]


def free_shuffles(spark: SparkSession) -> None:
    """From now on the session deletes what an action shuffled as soon as that action has ended.

    Spark otherwise keeps it until the driver's JVM happens to collect its garbage, so that the shuffles of all stored steps
    lie on the executors' disks together. An action that is run again on the same DataFrame computes them anew.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more. Only folders below the shared root."""
    if not path.startswith(shared_root(spark) + "/"):
        raise ValueError(f"not a stored table: {path}")
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def together(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Run independent builds at the same time, so that the tail of one job overlaps the next."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(b) for b in builds]]
