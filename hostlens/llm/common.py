"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table in the shared folder: (the table, its path).

    For loops: a checkpoint keeps the size estimate of the plan behind it, which
    joins multiply with every round; a table has its real size."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, path: str) -> None:
    """Remove a table made by ``stored`` that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element-wise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; each process remembers up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        super().__init__()
        self._of, self._limit = xxhash.xxh64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        h = self[word] = self._of(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between the ASCII blanks \\x09-\\x0D and \\x20, A-Z lower-cased
    (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8").lower().split() if text else []


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j]
    return mix64(h)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """text and y of at most ``per_class`` labelled training rows of each class,
    those with the least id hashes: a bounded sample, written to the shared
    folder.  Rows without a 0/1 label are left out; of several labels of one
    id the larger counts."""
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & F.coalesce(train, F.lit(False))).groupBy(
        "doc_id").agg(F.max(label).alias("y"))
    picked = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # 2 * per_class rows of two numbers, whatever the input
    return checkpointed(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))


def lowered(text: str) -> Column:
    """Text with A-Z lower-cased and nothing else; null counts as ''."""
    t = F.coalesce(F.col(text), F.lit(""))
    ascii_only = F.octet_length(t) == F.length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


#: keys that hold more than one part in HOT_PARTS of all rows are joined by broadcast
HOT_PARTS = 10_000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join on ``key`` that no hot key can bring into one task.

    ``right`` has each key once and ``weight``, the number of rows of ``left``
    with that key; ``total`` is the number of rows of ``left``.  The weights add
    up to ``total`` at most, so at most HOT_PARTS keys lie above one part in
    HOT_PARTS: those are broadcast, whatever the input, and only the rest shuffles."""
    hot = F.broadcast(right.where(F.col(weight) > total // HOT_PARTS))
    rest = right.where(F.col(weight) <= total // HOT_PARTS)
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(rest, key, "left").select(
        *left.columns, *(c for c in right.columns if c != key)))
