import math
import zlib

import pytest
from pyspark.sql import functions as F

from hostlens.llm import queries
from hostlens.llm.hilbert import hilbert_index, hilbert_shards

from .conftest import AWKWARD, SF


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_and_steps_to_neighbours(spark, dims, bits):
    side = 1 << bits
    df = spark.range(side ** dims)
    cols = [f"c{i}" for i in range(dims)]
    for i, c in enumerate(cols):
        df = df.withColumn(c, (F.floor(F.col("id") / side ** i) % side).cast("int"))
    path = [tuple(r[c] for c in cols) for r in df.withColumn("h", hilbert_index(cols, bits)).orderBy("h").collect()]
    assert sorted(r["h"] for r in df.select(hilbert_index(cols, bits).alias("h")).collect()) == list(range(side ** dims))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def check_shards(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, ())) for i in range(n_shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_query_over_whole_table(spark):
    rows = queries.op10(spark, SF).collect()
    check_shards(rows, 24)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_awkward_rows(awkward):
    rows = hilbert_shards(awkward, 5).collect()
    assert len(rows) == len(AWKWARD)
    check_shards(rows, 5)
    assert all(r["size"] == 8 for r in rows if r["doc_id"] in (3, 4))


def test_carry_keeps_the_columns(awkward):
    out = hilbert_shards(awkward, 3, carry=True)
    assert set(awkward.columns) | {"text_crc32", "curve", "slot"} == set(out.columns)
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r[1]) for r in AWKWARD)


def test_one_common_cell(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    check_shards(hilbert_shards(df, 7).collect(), 7)


def test_empty(no_docs):
    assert hilbert_shards(no_docs).count() == 0


@pytest.mark.parametrize("ids", ["xxhash64(id)", "IF(id % 2 = 0, 9223372036854775807 - id, id - 9223372036854775808)",
                                 "IF(id = 0, 1152921504606846976, id)", "CAST(id AS STRING)", "id * 1.5D"])
def test_any_ids(spark, ids):
    """Ids over the whole range of a long, one far outlier, and ids that are no integers."""
    df = spark.range(2000).selectExpr(f"{ids} AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "'s' AS source")
    rows = hilbert_shards(df, 24).collect()
    check_shards(rows, 24)
    assert len({r["doc_id"] for r in rows}) == 2000
    assert len({r["curve"] for r in rows}) > 6            # no outlier brings all rows into one level


def plain_index(coords, bits):
    """Place on the curve by turning the cube at every level, in plain integers."""
    n = len(coords)
    entry, direction, h = 0, 0, 0
    for i in reversed(range(bits)):
        corner = sum((c >> i & 1) << j for j, c in enumerate(coords)) ^ entry
        turn = (direction + 1) % n
        corner = (corner >> turn | corner << n - turn) & (1 << n) - 1
        w = next(w for w in range(1 << n) if w ^ w >> 1 == corner)
        even = 0 if w == 0 else 2 * ((w - 1) // 2)
        e = even ^ even >> 1
        entry ^= (e << turn | e >> n - turn) & (1 << n) - 1
        ones, x = 0, 0 if w == 0 else w if w & 1 else w - 1
        while x & 1:
            ones, x = ones + 1, x >> 1
        direction = (direction + ones % n + 1) % n
        h = h << n | w
    return h


def test_curve_of_each_row(spark):
    """The curve column against a plain index of the row's own metadata."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    raw = {r["doc_id"]: r for r in docs.collect()}
    seen = {}
    for r in hilbert_shards(docs).collect():
        d = raw[r["doc_id"]]
        x = [zlib.crc32((d[c] or "").encode()) % 32 for c in ("lang", "source")]
        x.append(min(31, math.floor(math.log2(r["size"]) * 1.5)))
        level = next(v for v in range(32) if plain_index([*x, v], 5) == r["curve"])
        seen.setdefault(level, []).append(r["doc_id"])
    assert [i for v in sorted(seen) for i in sorted(seen[v])] == ids           # levels are ranges of the id
    assert max(map(len, seen.values())) <= 2 * len(ids) / 32 + 1
