"""Sessions, tables and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Setting of a session, unset by default: partitions over which the tables of texts are spread when read, whatever their size.  Meant for one machine whose tables have fewer files than it has cores.
READ_PARTITIONS = "spark.cstloom.readPartitions"
TEXT_TABLES = {"documents", "chunks", "cst_documents"}


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cstloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(READ_PARTITIONS, cores)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.conf.get(READ_PARTITIONS, None)
    return rows.repartition(int(n)) if n and name in TEXT_TABLES else rows


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    A session without a folder gets one only if all its executors run on the
    driver's machine, as in tests; on a cluster the setting is required.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or _own_folder())
    return df.checkpoint(eager=True)


def _own_folder() -> str:
    """A folder for sessions on one machine, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="cstloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
