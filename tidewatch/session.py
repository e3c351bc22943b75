"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def session(app: str = "tidewatch", cores: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: The state store that transformWithState asks for.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming(spark: SparkSession) -> SparkSession:
    """spark, with state in RocksDB: what the stateful steps over streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidewatch-")) / "tidewatch.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, Path(root.name) / f.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _sent.add(app)
    return spark


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors reach.

    Without that setting a local session takes the system's temporary folder; on a cluster it fails.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tidewatch-tables"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in a new ``folder``: computed once, cuts the lineage, survives lost executors.

    by: columns by which it lies in folders, so that reads of some values read these alone.
    """
    path = folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
