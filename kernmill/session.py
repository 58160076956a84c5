"""Session set-up and staging of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "kernmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the engine's defaults; keyword settings override them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


#: A table up to this size is dealt out to all cores before a pass that computes much per row.
SPREAD_BYTES = 256 << 20


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for a pass that computes much per row.

    Only a table of at most ``SPREAD_BYTES`` that lies in fewer splits than there are
    cores is dealt out, so no more than that is ever shuffled for it; larger ones are
    read as they lie.  No result depends on it.
    """
    df = spark.read.parquet(path)
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df


def hashed_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hashed ids, the same whatever the layout.

    The ids are chosen first, from their column alone; the wide columns are read for
    rows up to the last chosen hash only.  Never more than ``rows`` rows, also where many
    share an id.
    """
    h = F.xxhash64(id_col)
    last = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return df.limit(0)
    return df.where(h <= last).orderBy(h, id_col).limit(rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where it may be unset (tests), a local one is made and set;
    a cluster without it is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="kernmill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A full address in the shared folder that nothing uses yet; ``release_staged`` deletes what comes to lie there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    _staged.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder, read it back.

    The table survives the loss of any executor and gives the planner true
    sizes.  ``unstage`` removes it once a later stage has replaced it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._kernmill_path = path
    return out


_staged: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_staged(spark: SparkSession) -> int:
    """Delete every staged table of this process; call it once the results that read them are written."""
    n = len(_staged)
    while _staged:
        _delete(spark, _staged.pop())
    return n


def unstage(df: DataFrame | None) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_kernmill_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    if path in _staged:
        _staged.remove(path)
