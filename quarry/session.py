"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python functions import it; once per application.

    Not needed where the package is installed on every machine.
    """
    app = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parent
    if app in _shipped or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="quarry-code-")).resolve() / "quarry.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a local-mode session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []


def scratch_path(spark: SparkSession, ending: str = "") -> str:
    """A fresh path in the shared folder, which ``drop_written`` removes."""
    path = os.path.join(shared_folder(spark), f"quarry-{uuid.uuid4().hex}{ending}")
    _written.append(path)
    return path


def write_out(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several jobs need the same intermediate result: the written table survives lost
    executors, cuts the lineage and gives the optimizer exact sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process; call it once the results built on them are used."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped
