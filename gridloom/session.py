"""Session settings for tests and single-machine runs. On a cluster bring your own session."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # the JIT leaves longer methods alone
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers, once for each application; needed where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_sent", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent).as_posix())
    target = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"  # the driver's own; Spark serves it to executors
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    sc._gridloom_sent = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, below the cluster's checkpoint folder.

    Where the session names none, a temporary folder will do on one machine;
    on a cluster executors would each write to their own, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix=f"{name}-") + "/data"
