"""Session helpers.

``local_session`` is for tests and the bench only; library code always takes
the caller's ``SparkSession``.  ``shared_dir`` returns a fresh folder under the
cluster's shared ``spark.checkpoint.dir``; only a local-mode session without
that setting gets a private folder (tests).  All of it lies in one folder per
application, deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Cap Arrow batches by bytes: wide vectors (784 doubles = 6 KB a row)
        # then stream in ~2,600-row batches that keep JVM and Python busy at
        # once; narrow rows still stop at the 10,000-record cap.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024))
        .config("spark.driver.memory", "16g")
        # A gang that cannot get its slots should fail fast, not retry 40x15s.
        .config("spark.scheduler.barrier.maxConcurrentTasksCheck.maxFailures", "1")
        .config("spark.scheduler.barrier.maxConcurrentTasksCheck.interval", "1s")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (set one only in local mode)."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder every "
                "executor can reach (HDFS, object store, shared mount)")
        conf = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder path under the shared checkpoint folder."""
    root = f"{checkpoint_root(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_forget, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_ROOTS: set[str] = set()


def _forget(root: str) -> None:
    """Delete an application's intermediate files when its driver ends."""
    from tessera.sources import fs
    try:
        fs.remove(root)
    except OSError:
        pass


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in every Python worker: zip the package
    into the shared folder once per application and ``addPyFile`` it (what
    ``--py-files`` does at submit time)."""
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    from tessera.sources import fs
    target = f"{shared_dir(spark, 'pyfiles')}/tessera.zip"
    fs.ensure_dir(target.rsplit("/", 1)[0])
    with fs.atomic_output(target) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
