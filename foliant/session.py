"""Session construction and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "foliant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: AQE with skew handling, UTC, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever their machine and working directory: once per application as an archive
    that executors fetch, and where driver and workers are one machine's processes by the driver's path."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if context.master.startswith("local["):
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    elif context.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="foliant-code-")  # the driver serves it from here, for as long as it runs
        atexit.register(shutil.rmtree, folder, True)
        archive = os.path.join(folder, "foliant.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for at, _, names in os.walk(os.path.join(root, "foliant")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(at, name)
                        out.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where a session names none (tests, a single
    machine) a temporary folder of this process is made and removed at its end.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], True)
    return _OWN_DIRS[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a plan read one costly result: the work is done once, the lineage
    ends at files that outlive any executor, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def share_file(spark: SparkSession, label: str, write: Callable[[str], None]) -> str:
    """A file that ``write`` makes at the path it is given, for Python workers on every machine: in the shared folder, or, where
    that is no mounted one, handed to the executors by Spark. Returns the name that ``local_path`` takes."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getUri().getScheme() == "file":
        at = path.toUri().getPath()
        os.makedirs(os.path.dirname(at), exist_ok=True)
        write(at)
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path.toString())
        return at
    folder = tempfile.mkdtemp(prefix="foliant-file-")
    atexit.register(shutil.rmtree, folder, True)
    write(os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def local_path(name: str) -> str:
    """Where a file of ``share_file`` is on this machine."""
    return name if os.path.isabs(name) else SparkFiles.get(name)


def release(spark: SparkSession) -> int:
    """Delete the tables this session wrote with ``materialize``; results that read them must be saved before."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
