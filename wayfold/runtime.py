"""Session, table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "wayfold", **conf: str) -> SparkSession:
    """A session with the settings every result here assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    They import it for Arrow functions and need not find it on their own path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # run from an archive that is there already
        return
    folder = Path(tempfile.mkdtemp(prefix="wayfold-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "wayfold.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(folder / "wayfold.zip"))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder; a single file or a folder of part files."""
    ship(spark)
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, as the session names it.

    ``spark.checkpoint.dir`` is honoured as it is.  Only where neither it nor a
    checkpoint folder is set, and only in local mode, a temporary folder of this
    process is used; a cluster without a shared folder is an error, since a
    machine-local folder would not survive the loss of an executor.  What the
    application has put there is deleted when it ends.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
        atexit.register(_delete, sc._jvm, sc.getCheckpointDir())
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.mkdtemp(prefix="wayfold-"))
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own.as_uri())
    return own.as_uri()


def _delete(jvm, folder: str) -> None:
    """Delete a folder of a shared file system; one that is gone, or a JVM that is, is no error."""
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables a query writes and reads; deleted when the application ends."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a table that must be small; beyond ``most`` rows it is an error.

    Used for parameter tables (limits, targets, word lists) only, whose size is
    part of the contract.  One row more than allowed is fetched to tell.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; this table has to be a small one")
    return rows
