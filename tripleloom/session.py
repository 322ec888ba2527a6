"""Session, table access, shared work folder and key de-duplication."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key sets up to this many rows are broadcast after they have been counted.
BROADCAST_KEY_LIMIT = 50_000


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName("tripleloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tripleloom-")
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/tripleloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, f"tripleloom/{file.relative_to(package)}")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where it is unset, as in tests, a temporary folder is made and set; off a local
    master that is an error, since executors could not share it.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tripleloom-")
        atexit.register(shutil.rmtree, configured, True)
        context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the table instead of
    re-running the Python stages before it. The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tripleloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled on both sides.

    Spark else broadcasts a side by an estimate: the bytes of its file, which the driver
    holds unpacked, several joins' at once.
    """
    return df.hint("merge")


def one_row_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key without shuffling the rows whose key is unique.

    Only the keys are aggregated. If the repeated keys are few (counted, at most
    ``BROADCAST_KEY_LIMIT``) they are broadcast and only their rows are shuffled;
    else all rows are de-duplicated by a shuffle. Rows with a null key are kept
    as one row.
    """
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    few = repeated.limit(BROADCAST_KEY_LIMIT + 1).count()
    if few == 0:
        return df
    if few > BROADCAST_KEY_LIMIT:
        return df.dropDuplicates(list(keys))
    marked = F.broadcast(repeated.select(*[F.col(k).alias(f"__{k}") for k in keys]))
    same: Column = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(F.col(f"__{k}"))
    single = df.join(marked, same, "left_anti")
    several = df.join(marked, same, "left_semi").dropDuplicates(list(keys))
    return single.unionByName(several)


def rows_of_keys(df: DataFrame, wanted: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Rows whose ``key`` is (or is not) in ``wanted``, a table of distinct keys.

    The keys are counted; at most ``BROADCAST_KEY_LIMIT`` are broadcast, so that the
    other rows are never shuffled. More are joined by a shuffle.
    """
    how = "left_semi" if present else "left_anti"
    few = wanted.limit(BROADCAST_KEY_LIMIT + 1).count() <= BROADCAST_KEY_LIMIT
    return df.join(F.broadcast(wanted) if few else wanted, key, how)
