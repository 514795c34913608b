"""Session helpers shared by all operators.

Operators never create a session of their own; they take the caller's. What they need besides is a folder that every
executor can reach, for checkpoints and intermediate tables: it comes from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster job brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if str(cores).isdigit():
        settings.setdefault(DEAL, str(cores))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pagemill")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset, which is the case on one machine, a temporary folder
    of this machine is set; a cluster of several machines must configure the setting.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pagemill-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


_SCRATCH: list[str] = []
#: Tables of the catalog over such paths.
TABLES: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the intermediate tables written so far; results that still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    while TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop()}")
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: into how many parts small inputs of costly kernels are dealt. Unset on a cluster, where scans have parts enough.
DEAL = "spark.pagemill.deal"


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, for kernels that cost much per row.

    The plan does not look at the size of the table: its scan is used as it is. A caller that reads one small file on many
    cores, as tests and the benchmark do, asks for rows to be dealt out by the setting ``DEAL``.
    """
    df = table(spark, sf_dir, name)
    parts = spark.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts else df
