"""Session set-up and the shared working folder.

Everything that must survive an executor loss (stores, stream sinks, cut
lineage) lives under ``spark.checkpoint.dir``.  On a cluster that setting
names a shared folder and is only read here (without it, an error); a fresh local folder is made
only when the setting is absent and the master is local (local runs and tests).

Intermediate tables are written by jobs that run while a plan is built (sizes and parameters decide how it goes
on).  They stay for as long as results may read them; ``job_scope`` gives them a folder that goes when the scope ends.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Arrow batches handed to Python carry packed vector blocks; cap them by bytes
# as well as by rows so one batch never holds more than this: a worker keeps several
# forms of a batch at a time, and a core has several workers.
ARROW_MAX_BYTES = 2 << 20


LOCAL_SHUFFLE_PARTITIONS = 8


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "refinespark") -> SparkSession:
    """A session with this library's defaults.  The number of shuffle partitions is set for a local master, or if given; a
    cluster's own setting is left as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = LOCAL_SHUFFLE_PARTITIONS
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_MAX_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # one BLAS thread per Python worker: Spark already runs one task per core
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.driver.memory", os.environ.get("REFINESPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (the ``--py-files`` way).

    Pandas/Arrow stages pickle functions of this package by reference, so the
    workers must import it.  In local mode the package is zipped once per
    application and handed to ``addPyFile``; on a cluster it is deployed
    with the job, so nothing is written on the driver machine.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or not sc.master.startswith("local"):
        # on a cluster the package is deployed with the job (installed or --py-files)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="refinespark-pyfiles-"), "refinespark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def ensure_arrow_limits(spark: SparkSession) -> None:
    """Bound JVM->Python Arrow batches by bytes if nobody has done so; ship the package."""
    ship_package(spark)
    cur = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if cur is None or int(cur) > ARROW_MAX_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_MAX_BYTES))


#: Folder of the innermost ``job_scope``, below the shared folder, and what is written there.
_SCOPE: list[str] = []
_SCOPED = ("tables", "llm")


@contextlib.contextmanager
def job_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written in the scope lie in one folder, which is removed at its end.

    Results that read them must be written (or collected) inside; stores, indexes and stream sinks are not part of it.
    """
    name = f"job-{uuid.uuid4().hex}"
    path = shared_dir(spark, name)
    _SCOPE.append(name)
    try:
        yield path
    finally:
        _SCOPE.remove(name)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """Path under the cluster's ``spark.checkpoint.dir``.

    The setting is read from the session.  Only when it is unset and the master is local (local runs,
    tests) is a new local folder made and registered, so later calls in the
    same session agree on it.
    """
    if _SCOPE and parts and parts[0] in _SCOPED:
        parts = (_SCOPE[-1], *parts)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="refinespark-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # static in some deployments; the context dir below still holds
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(base, "lineage"))
    return os.path.join(base, *parts) if parts else base


def materialise(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Used for intermediates that are read several times (query vectors,
    refine prompts, the vocabulary, the index lists): they are computed once
    - one job, unlike ``checkpoint()``, which recomputes an uncached plan to
    write it - and a lost executor re-reads the written files instead of
    recomputing the work behind them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.parquet(path)
