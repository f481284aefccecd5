"""Session settings and the shared folder that holds written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "flowstream") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="flowstream-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application. Needed wherever it is not installed
    on the executors (or passed with --py-files)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="flowstream-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/flowstream.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_made: dict[str, list[str]] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/flowstream/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables this session wrote; call it when their results are no longer read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        for p in (path, f"{path}-state"):
            target = jvm.org.apache.hadoop.fs.Path(p)
            target.getFileSystem(conf).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and (unlike a row checkpoint)
    later readers still get column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = 200_000) -> DataFrame:
    """Join that broadcasts ``small`` only after counting it; beyond the limit it is a shuffle join
    (where adaptive execution splits skewed keys). ``small`` is written first, so that a side computed from a large
    table is computed once."""
    small = written(small, "side")
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def spread_by(df: DataFrame, keys) -> DataFrame:
    """Hash partitions for Python work on groups. The count is explicit because adaptive execution judges
    partitions by bytes and would merge small groups that are heavy to compute into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
