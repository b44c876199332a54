"""Spark session helpers and the per-user engine session.

The engine keeps no state of its own beyond what the reference keeps per
user: the views ``taxonomy`` and ``host`` and the last successful result
``df_host``.  Everything else is a lazy DataFrame plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hostlens.functions.wkb import register_functions

# Settings every job relies on.  Sizes that depend on the cluster
# (shuffle partitions, maxPartitionBytes) are left to the deployment;
# AQE coalesces small shuffles and splits skewed join partitions at runtime.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # file-path tables (parquet.`/x`) bypass the view layer; the guard
    # relies on them being unresolvable
    "spark.sql.runSQLOnFiles": "false",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; a
    # whole-stage method above that runs interpreted, so Spark should fall
    # back to per-operator code instead (the value Spark's docs suggest)
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_spark(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "hostlens", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Local/test session.  On a cluster the session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**ENGINE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Apply the engine settings to a session we did not build; a setting the
    session refuses to change is skipped with a warning."""
    import warnings

    for k, v in ENGINE_CONF.items():
        try:
            if spark.conf.get(k, None) != v:
                spark.conf.set(k, v)
        except Exception as e:  # e.g. CANNOT_MODIFY_CONFIG in a managed session
            warnings.warn(f"could not set {k}: {e}")


_PRIVATE_CKPT: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read
    (it cannot be changed at runtime).  When nothing is configured, a local
    master gets one private folder per application; any other master is
    refused, since its executors and driver have no folder in common.
    """
    sc = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or _PRIVATE_CKPT.get(sc.applicationId) or sc.getCheckpointDir())
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="hostlens-ckpt-")
    _PRIVATE_CKPT.setdefault(sc.applicationId, configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(spark: SparkSession, rows: int, a_task: int) -> int:
    """Partitions to shuffle ``rows`` rows into: as many as the session says, or
    more, so that a task gets about ``a_task`` rows however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // a_task))


@contextmanager
def shuffled_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What runs inside shuffles into ``partitions`` partitions and merges none of them."""
    inside = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in inside}
    try:
        for k, v in inside.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class EngineSession:
    """Views ``taxonomy``/``host`` plus the last successful result ``df_host``.

    ``df_host`` is per EngineSession (the reference keeps one per process) and
    registered as a temp view.  By default a result is computed once and
    written to the shared folder, so its emptiness test, count, preview and
    every later use read the same rows (a LIMIT without an order could give
    others each time); the previous result's files are removed when it is
    replaced.  With ``materialise=False`` the result stays a lazy plan.
    """

    def __init__(self, spark: SparkSession, host: DataFrame | None = None,
                 taxonomy: DataFrame | None = None, materialise: bool = True,
                 views: tuple[str, ...] = (), functions: tuple[str, ...] = ()):
        """``views`` and ``functions`` are temporary ones, besides the session's
        own, that guarded SQL may name."""
        self.spark = spark
        self.materialise = materialise
        self.views = {"host", "taxonomy", "df_host", *views}
        self.functions = {"ST_X", "ST_Y", *functions}
        self._df_host: DataFrame | None = None
        self._path: str | None = None
        apply_engine_conf(spark)
        register_functions(spark)
        if host is not None:
            host.createOrReplaceTempView("host")
        if taxonomy is not None:
            taxonomy.createOrReplaceTempView("taxonomy")
        self.taxonomy = taxonomy
        self.host = host

    def describe(self, view: str = "host") -> list[tuple[str, str]]:
        """S3: ``DESCRIBE`` a view → (column name, type); reads only the
        schema, no data."""
        return [(f.name, f.dataType.simpleString()) for f in self.spark.table(view).schema.fields]

    @property
    def df_host(self) -> DataFrame | None:
        return self._df_host

    def stage(self, df: DataFrame) -> tuple[DataFrame, str | None]:
        """``df`` as computed rows in the shared folder, and their path."""
        if not self.materialise:
            return df, None
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/results/{uuid.uuid4().hex}"
        names = [f"c{i}" for i in range(len(df.columns))]  # a SELECT may repeat or leave out names
        df.toDF(*names).write.parquet(path)
        return self.spark.read.parquet(path).toDF(*df.columns), path

    def drop(self, path: str | None) -> None:
        if path:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def set_result(self, df: DataFrame, path: str | None = None) -> DataFrame:
        old, self._path = self._path, path
        self._df_host = df
        df.createOrReplaceTempView("df_host")
        self.drop(old)
        return df
