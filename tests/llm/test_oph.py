import hashlib

import numpy as np
import pytest

from hostlens.llm import oph, queries
from hostlens.llm.common import WordHashes, shingle_hashes

from .conftest import AWKWARD, SF, docs_of, prose


def shingles(text):
    w = text.encode().lower().split()
    return set(zip(*[w[j:] for j in range(5)])) or {tuple(w)}


def expected(rows):
    """doc id -> edited text, by descending id (ids and texts must be known)."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        out[i] = (t, t[:len(t) - cut] + nxt[:cut], nxt)
    return out


def test_edits_and_estimates_over_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, errors = expected(docs), []
    rows = queries.op6(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t, e, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        for got, other in ((r["near_edited"], e), (r["near_next"], nxt)):
            a, b = shingles(t), shingles(other)
            if min(len(a), len(b)) > 40:
                errors.append(got - len(a & b) / len(a | b))
    assert np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.2


def test_estimate_is_unbiased_for_sparse_sets():
    fp, errors = oph.Fingerprinter(), []
    for s in range(300):  # fewer shingles than bins: most bins borrow
        w = prose(s, 40, 10_000).split()
        a, b = " ".join(w), " ".join(w[:30] + prose(s + 1000, 10, 10_000).split())
        x, y = shingles(a), shingles(b)
        errors.append(oph.likeness(fp.codes(a), fp.codes(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02


def test_pack_round_trip():
    codes = np.random.default_rng(1).integers(0, 1 << oph.BITS, oph.BINS).astype(np.uint8)
    assert (oph.unpack(oph.pack(codes)) == codes).all() and oph.unpack(oph.pack(None)) is None


def test_awkward_rows(spark, awkward, no_docs):
    rows = oph.fingerprint_edits(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[3] == by_text[4] == by_text[5] == {""}
    assert oph.fingerprint_edits(no_docs).count() == 0
    one = oph.fingerprint_edits(docs_of(spark, [(5, "x y z")])).first()
    assert one["near_next"] == 1.0
    assert sorted(map(str, by_text[1])) == sorted({r["fingerprint"] for r in oph.fingerprint(awkward).collect() if r["doc_id"] == 1})


@pytest.mark.parametrize("ids", ["xxhash64(id)", "IF(id = 0, 9223372036854775807, IF(id = 1, -9223372036854775807, id))", "IF(id = 0, 1152921504606846976, id)"])
def test_any_64_bit_id(spark, ids):
    rows = [(r["i"], prose(r["id"], 12, 300)) for r in spark.range(120).selectExpr("id", f"{ids} AS i").collect()]
    want = expected(rows)
    got = oph.fingerprint_edits(docs_of(spark, rows)).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == {i: hashlib.sha256(e.encode()).hexdigest() for i, (_, e, _) in want.items()}


def test_against_plain_bins():
    """Bins, densification and packing by plain loops."""
    fp = oph.Fingerprinter()
    orders = oph._orders(oph.BINS)
    for s in range(12):
        text = prose(s, 4 + 17 * s, 500)
        words = text.split()
        least = {}
        hashes = [int(h) for h in shingle_hashes(WordHashes().of([w.encode() for w in words]), oph.SHINGLE)]
        for h in hashes:
            b = h >> 56
            least[b] = min(least.get(b, h), h)
        codes = []
        for b in range(oph.BINS):
            source = b if b in least else min(least, key=lambda t: orders[b][t])
            codes.append(least[source] % (1 << oph.BITS))
        assert fp.codes(text).tolist() == codes
        assert oph.pack(fp.codes(text)) == "".join(f"{codes[i + 1]:x}{codes[i]:x}" for i in range(0, oph.BINS, 2)) or oph.unpack(oph.pack(fp.codes(text))).tolist() == codes
