"""Session helpers: building a local session for tests/bench, reading the
driver tables, and resolving the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session tuned the way a cluster session would be: AQE on,
    skew join on, UTC, no UI. Only for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus * 2
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("revledger")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that is
    always used as is. Only a local-mode session with nothing configured
    (tests) gets a private scratch folder. A cluster session without the
    setting is an error: a machine-local folder would not survive the loss
    of an executor.
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
        raise RuntimeError(
            "spark.checkpoint.dir is not set; configure a shared folder for this cluster"
        )
    scratch = tempfile.mkdtemp(prefix="revledger-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


#: folders made in each open scope, the innermost last
_SCOPES: list[list[str]] = []


def new_table_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the checkpoint folder; it goes with the scope."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def table_scope(spark: SparkSession):
    """Intermediate tables that operators write inside are dropped at the end.
    A result read from them has to be written inside the scope, to a folder
    of the caller's own."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """An action inside drops its shuffle files when it ends, not when the
    driver happens to collect its garbage: for results that are whole by then,
    a written table or a row."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the checkpoint folder as a table and read back. Like
    ``checkpoint()`` it cuts the lineage and survives lost executors, but the
    planner then knows the size of the files; a checkpoint keeps the size
    estimated for its plan, which a loop of joins multiplies every round. What
    was shuffled for the table goes when it is written."""
    path = new_table_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``revledger`` importable in Python workers (pandas UDFs and the
    streaming state handler unpickle functions from it). The package is
    zipped once per driver and handed to ``addPyFile``, which distributes
    it to every executor like ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_revledger_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="revledger-py-"), "revledger.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    sc._revledger_shipped = True


def limit_conf(spark: SparkSession, name: str, default: int) -> int:
    """A size limit, overridable per session with ``spark.revledger.<name>``."""
    value = spark.conf.get(f"spark.revledger.{name}", None)
    return default if value is None else int(value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}
