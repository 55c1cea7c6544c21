"""Session construction and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "phyllo", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI SQL, adaptive execution and Arrow transfer on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map={**defaults, **conf}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary local
    folder is made and set for the rest of the session.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="phyllo-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = "file://" + folder
    spark.sparkContext.setCheckpointDir(made)
    return made


def run_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder; all its scratch tables lie there."""
    return f"{shared_dir(spark)}/phyllo-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application.

    Results are lazy reads of them, so this is for after they are written. What
    a run leaves that ends before is one folder with the application's id.
    """
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor, is columnar and smaller
    than an RDD checkpoint, and can be dropped as soon as no plan reads it.
    ``clean`` deletes those of a whole application.
    """

    def __init__(self, spark: SparkSession, label: str = "scratch"):
        self.spark = spark
        self.root = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        if partitions:
            df = df.coalesce(partitions)
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._phyllo_path = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that are no longer read."""
        for table in tables:
            path = getattr(table, "_phyllo_path", None)
            if path:
                _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)
