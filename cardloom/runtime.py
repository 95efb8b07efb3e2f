"""Session, table and materialisation helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query as soon as it has ended; set for the writes of `materialize` alone.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDER = f"cardloom-{uuid.uuid4().hex}"
_used: set[str] = set()


def get_spark(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cardloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once, so that they can import it on any machine."""
    sc = spark.sparkContext
    if not getattr(sc, "_cardloom_shipped", False):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="cardloom-")) / "cardloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        sc._cardloom_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session in one process, as in tests, may do without: it gets a folder of its own. On a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cardloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path for a table of this run in the shared folder; what is left there is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{_FOLDER}"
    if not _used:
        atexit.register(lambda: [_delete(f) for f in sorted(_used)])
    _used.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def _delete(path: str) -> None:
    try:
        where, inner = fs.FileSystem.from_uri(path)
        where.delete_dir(inner)
    except (OSError, ValueError):  # gone already, or a file system only the cluster knows: its own clean-up is left to it
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage where a result is used several times, without relying on blocks of a single executor: the
    files outlive any executor that is lost.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark), spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cardloom_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_cardloom_path", None):
            _delete(path)
