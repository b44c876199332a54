"""Scans: the driver's parquet tables and the domain views built over them.

``register_all(spark, sf_dir)`` is cheap: it only declares lazy plans and
temp views; Catalyst prunes columns and pushes filters into each parquet
scan when a query runs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.wkb import st_point
from hostlens.session import ensure_checkpoint_dir, shuffled_into
from hostlens.sources.standins import STANDIN_VIEWS

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Object-store read settings (the reference allows 60 s per read, 3 tries).
S3A_TIMEOUT_MS = 60_000
S3A_ATTEMPTS = 3


def host_scan(spark: SparkSession, parquet_glob: str, timeout_ms: int = S3A_TIMEOUT_MS,
              attempts: int = S3A_ATTEMPTS, **s3a_options: str) -> DataFrame:
    """S2 for real deployments: ``host`` is one parquet dataset (path or glob,
    e.g. ``s3a://bucket/host/*.parquet``) exposed as the view ``host``.
    Timeouts, retries and other ``fs.s3a.*`` options (endpoint, path-style
    access, credentials provider) go to the session's Hadoop configuration;
    the scan itself is lazy and pruned per query."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.connection.timeout", str(timeout_ms))
    conf.set("fs.s3a.attempts.maximum", str(attempts))
    for k, v in s3a_options.items():
        conf.set(k if k.startswith("fs.s3a.") else f"fs.s3a.{k}", str(v))
    df = spark.read.parquet(parquet_glob)
    df.createOrReplaceTempView("host")
    return df


def build_host(spark: SparkSession, src: DataFrame | None = None) -> DataFrame:
    """The observation table from the registered raw views: the stand-in
    join plus a WKB ``geometry`` (odd lines little endian, even lines big
    endian, so both byte orders occur)."""
    src = spark.table("host_src") if src is None else src
    geometry = st_point(F.col("lon_src"), F.col("lat_src"), F.col("obs_line") % 2 == 1)
    return src.withColumn("geometry", geometry).drop("lon_src", "lat_src")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


LANDING_LAYOUT = "v2-sorted-family-genus"


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], layout: str) -> str:
    """Identity of the input files (path, size and modification time of every
    file below each table's path) and of the layout they are landed in."""
    h = hashlib.sha1(layout.encode())
    for name in tables:
        p, fs = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            st = files.next()
            found.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()};")
        h.update("".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def landed(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """Path of a dataset that ``write`` lands once, in ``<spark.checkpoint.dir>/landed``
    (the shared folder the cluster names).

    It is written to a fresh folder and renamed into place, so concurrent or
    retried jobs never see a partial one."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/landed/{name}"
    dst, fs = _fs(spark, path)
    if not fs.exists(dst):
        tmp = f"{root}/landed/tmp-{uuid.uuid4().hex}"
        write(tmp)
        src, _ = _fs(spark, tmp)
        # renaming onto an existing directory would move tmp inside it, so
        # a job that lost the race drops its copy instead
        if fs.exists(dst) or not fs.rename(src, dst):
            fs.delete(src, True)
    return path


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    return fingerprint(spark, sf_dir, ("lineitem", "part", "supplier", "nation"), LANDING_LAYOUT)


#: rows of host that a task joins and sorts
LANDED_ROWS = 300_000
#: suppliers that are broadcast instead of shuffling every observation once more
MOST_BROADCAST = 500_000


def _write_host(spark: SparkSession, path: str) -> None:
    """The observations, from one shuffle of them if the suppliers are few.  The
    number of partitions goes by the rows, so no task has more to sort on larger input."""
    rows = spark.table("lineitem").count()
    hints = {"supplier": "broadcast"} if spark.table("supplier").count() <= MOST_BROADCAST else {}
    n = max(spark.sparkContext.defaultParallelism, -(-rows // LANDED_ROWS))
    if large := rows > 4 * LANDED_ROWS:
        hints["part"] = "merge"      # a broadcast would leave the rows in partitions as large as the files' blocks
    raw = {name: spark.table(name) for name in hints}
    try:
        for name, hint in hints.items():
            raw[name].hint(hint).createOrReplaceTempView(name)
        src = spark.sql(STANDIN_VIEWS["host_src"])
    finally:
        for name, df in raw.items():
            df.createOrReplaceTempView(name)
    with shuffled_into(spark, n) if large else nullcontext():
        # sorted within files so that row-group min/max statistics let
        # equality and range filters on family/genus skip data
        build_host(spark, src).sortWithinPartitions("VIRUS_FAMILY", "VIRUS_GENUS").write.mode("overwrite") \
            .option("compression", "zstd").parquet(path)


def landed_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``host`` as the reference has it: one stored Parquet dataset, built once
    per input.  Later queries scan it with column pruning and pushed filters."""
    return spark.read.parquet(landed(spark, f"host-{_fingerprint(spark, sf_dir)}", lambda path: _write_host(spark, path)))


def land_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register everything over ``sf_dir``, landing ``host`` if it is not there yet."""
    register_all(spark, sf_dir)
    return spark.table("host")


# Resolved frames per (application, folder, input files): building them lists
# files and reads footers; re-binding the temp views is only catalog work.
_FRAMES: dict[tuple[str, str, str, bool], dict[str, DataFrame]] = {}


def register_all(spark: SparkSession, sf_dir: str, land: bool = True) -> None:
    """Raw tables plus the domain views (host, taxonomy, users, ...)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _fingerprint(spark, sf_dir), land)
    frames = _FRAMES.get(key)
    if frames is None:
        frames = {}
        for name in RAW_TABLES:
            frames[name] = read_table(spark, sf_dir, name)
            frames[name].createOrReplaceTempView(name)
        for name, sql in STANDIN_VIEWS.items():
            frames[name] = spark.sql(sql)
            frames[name].createOrReplaceTempView(name)
        frames["host"] = landed_host(spark, sf_dir) if land else build_host(spark)
        _FRAMES[key] = frames
    for name, df in frames.items():
        df.createOrReplaceTempView(name)

