"""Session helpers: one place for the configuration the operators rely on."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def get_spark(app: str = "flowlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one configured for the engine.

    On a cluster the builder picks up the cluster's own master and defaults; the
    settings below only matter when no session exists yet (tests, bench).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOWLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read and
    used as is.  Only a local session without one (tests) gets a fresh folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/flowlens-{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application).

    The archive is written under the shared checkpoint folder and handed to Spark, so that worker
    functions are pickled by reference and module-level caches live as long as the Python worker.
    Its name follows its content and Spark's own list of files says whether the application has it: a second import of
    this module in one application ships nothing twice (Spark refuses one file name from two paths), and changed code
    gets an archive, and by the environment Python workers, of its own.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    content = package_archive()
    name = f"flowlens-{hashlib.sha256(content).hexdigest()[:16]}.zip"
    if not any(path.endswith(f"/{name}") for path in sc.listFiles):
        path = scratch_dir(spark, "package") + f"/{name}"
        jvm = sc._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
        stream.write(content)
        stream.close()
        sc.addPyFile(path)
    sc.environment["FLOWLENS_PACKAGE"] = name
    _SHIPPED.add(sc.applicationId)


def package_archive() -> bytes:
    """This package's modules as a zip archive, the same bytes for the same code; every folder with modules is importable from it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buffer = io.BytesIO()

    def add(full: str, content: bytes) -> None:  # the entry's default time is fixed
        archive.writestr(zipfile.ZipInfo(os.path.relpath(full, root)), content, zipfile.ZIP_DEFLATED)

    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(os.path.join(root, "flowlens"))):
            modules = [name for name in sorted(names) if name.endswith(".py")]
            for name in modules:
                with open(os.path.join(folder, name), "rb") as module:
                    add(os.path.join(folder, name), module.read())
            if modules and "__init__.py" not in modules:  # a folder without it is no package to an importer of archives
                add(os.path.join(folder, "__init__.py"), b"")
    return buffer.getvalue()
