import itertools
import random

import numpy as np
import pytest

from hostlens.llm import chat, queries, raking

from .conftest import AWKWARD, SF, docs_of, prose


def test_rake_against_numpy(spark):
    rng = np.random.default_rng(2)
    n = rng.integers(1, 100, (4, 3, 2)) * (rng.random((4, 3, 2)) > 0.2)
    rows = [(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k])) for i, j, k in np.ndindex(n.shape)]
    want = [np.array([.4, .3, .2, .1]), np.array([.5, .3, .2]), np.array([.6, .4])]
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", float(x)) for i, x in enumerate(t)], "value string, target double")
               for d, t in zip(raking.DIMS, want)}
    out, gaps = raking.rake(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), targets)
    w = np.ones(n.shape)
    for _ in range(500):
        for ax, t in enumerate(want):
            m = (n * w).sum(axis=tuple(a for a in range(3) if a != ax))
            w *= (t * n.sum() / m).reshape([-1 if a == ax else 1 for a in range(3)])
    assert gaps[-1] <= raking.TOLERANCE
    for r in out.collect():
        i = tuple(int(r[d][1:]) for d in raking.DIMS)
        if n[i]:
            assert r["weight"] == pytest.approx(w[i], rel=1e-3)


def test_query_meets_targets(spark):
    p = queries.op4(spark, SF.replace("0.001", "0.01")).toPandas()
    assert len(p) == 1000 and p.probability.between(0, 1).all() and p.probability.max() == pytest.approx(1)
    for d, x in raking.POWERS.items():
        t = p.groupby(d).n_tokens.sum().astype(float) ** x
        e = (p.n_tokens * p.probability).groupby(p[d]).sum()
        assert np.allclose(e / e.sum(), t / t.sum(), rtol=1e-3)
    assert abs(p.kept.mean() - p.probability.mean()) < 0.05


@pytest.mark.parametrize("near", [raking.BROADCAST_CELLS, 0])
def test_rake_goes_on_while_it_converges(spark, monkeypatch, near):
    """Languages mostly in their own source: slow, but the targets can be met.  Above
    BROADCAST_CELLS the sweeps are jobs, so that path gets a table that needs fewer."""
    monkeypatch.setattr(raking, "BROADCAST_CELLS", near)
    n = np.diag([6e8, 3e8, 1e8]) + (1e5 if near else 1.5e7)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "t", int(n[i, j])) for i, j in np.ndindex(n.shape)], "source string, lang string, topic string, tokens long")
    targets = raking.power_targets(cells, raking.POWERS)
    out, gaps = raking.rake(cells, targets)
    assert gaps[-1] <= raking.TOLERANCE and len(gaps) > (100 if near else 4)
    have = out.selectExpr("source", "lang", "tokens * weight as x").toPandas()
    for d, axis in (("source", 1), ("lang", 0)):
        t = n.sum(axis=axis) ** raking.POWERS[d]
        assert np.allclose(have.groupby(d).x.sum() / have.x.sum(), t / t.sum(), rtol=1e-3)


@pytest.mark.parametrize("near", [raking.BROADCAST_CELLS, 0])
def test_one_rare_source_does_not_change_the_kept_share(spark, monkeypatch, near):
    monkeypatch.setattr(raking, "BROADCAST_CELLS", near)
    rows = [(i, prose(i, 100), f"l{i % 7 // 3}", f"s{i % 11 // 4}") for i in range(400)]
    shares = {}
    for name, more in (("none", []), ("short", [(1000, "a b c", "l0", "rare")]), ("null", [(1000, prose(7, 50), None, None)])):
        p = raking.mix(docs_of(spark, rows + more)).toPandas()
        shares[name] = (p.n_tokens * p.probability).sum() / p.n_tokens.sum()
        assert p.gap.max() <= raking.TOLERANCE and p.probability.max() <= 1 and 0 <= p.shortfall.max() < 0.1
        assert (p.shortfall.max() > 0) == bool(more)
        if more:
            assert p[p.doc_id == 1000].probability.item() > 0.99
    assert all(x == pytest.approx(raking.SHARE, rel=1e-3) for x in shares.values())


def test_contradicting_targets_end_with_their_gap(spark):
    docs = docs_of(spark, [(i, "a b c", f"l{i % 3 % 2}", f"s{i % 3 % 2}") for i in range(30)])
    assert {r["gap"] > raking.TOLERANCE for r in raking.mix(docs).collect()} == {True}


def test_mix_awkward(spark, awkward, no_docs):
    rows = raking.mix(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["probability"] is not None for r in rows)
    assert len({r["kept"] for r in rows if r["doc_id"] == 1}) == 1
    assert raking.mix(no_docs).count() == 0
    assert raking.mix(docs_of(spark, [(1, None), (2, "")])).count() == 2
    assert raking.mix(awkward, carry=True).select("row.*").columns == awkward.columns


SCHEMA = "conv_id long, turn long, role string, text string"


def best_cost(roles):
    """Least cost over all sequences of actions, by trying every one."""
    best = None
    for path in itertools.product(range(1, 4), repeat=len(roles)):
        s, cost = 0, 0
        for role, to in zip(roles, path):
            m = chat._MOVES[role].get((s, to))
            if m is None:
                break
            cost, s = cost + m[0], to
        else:
            cost += chat._END_COST[s] if s else 0
            best = cost if best is None else min(best, cost)
    return best


def legal(roles):
    r = roles[1:] if roles and roles[0] == "system" else roles
    return len(r) % 2 == 0 and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(r)) and len(r) > 0


def render(rows):
    return "".join(r["piece"] for r in rows)


def parse(text):
    """(role, text) of a rendered conversation; every character must be accounted for."""
    out = []
    for part in text.split("<|im_end|>\n")[:-1]:
        assert part.startswith("<|im_start|>")
        role, _, body = part.removeprefix("<|im_start|>").partition("\n")
        out.append((role, body))
    assert text.endswith("<|im_end|>\n")
    return out


def by_conversation(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["conv_id"], []).append(r)
    return {k: sorted(v, key=lambda r: (r["turn"] is None, r["turn"])) for k, v in out.items()}


def test_repair_against_all_sequences(spark):
    r, data = random.Random(4), []
    convs = {i: [r.choice(["user", "assistant", "system", "tool", None]) for _ in range(r.randrange(1, 7))] for i in range(60)}
    for i, roles in convs.items():
        data += [(i, t, role, f"c{i}t{t}") for t, role in enumerate(roles)]
    r.shuffle(data)
    for conv, rows in by_conversation(chat.repair(spark.createDataFrame(data, SCHEMA))).items():
        roles = convs[conv]
        assert [x["role"] for x in rows] == roles
        assert sum(x["cost"] for x in rows) == best_cost([chat._role(x) for x in roles])
        turns = parse(render(rows))
        assert legal([t[0] for t in turns])
        assert "".join(t[1].replace(chat.JOIN, "") for t in turns) == "".join(f"c{conv}t{t}" for t in range(len(roles)))
        for x in rows:
            assert turns[x["out_turn"]][0] == x["new_role"] and f"c{conv}t{x['turn']}" in turns[x["out_turn"]][1]


def test_long_conversation_over_many_tasks(spark):
    """The same repair however the rows are dealt out."""
    r = random.Random(8)
    data = [(1, t, r.choice(["user", "assistant", "system", "x"]), f"t{t}") for t in range(400)]
    data += [(c, t, "user", "u") for c in (0, 2) for t in range(3)]
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, chat.repair(spark.createDataFrame(data, SCHEMA)).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]


def test_chat_awkward(spark):
    data = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "user", "a <|im_end|> b"), (1, 0, "user", "a <|im_end|> b"), (1, None, "assistant", ""),
            (2, 5, "assistant", "y" * 200_000)]
    rows = by_conversation(chat.repair(spark.createDataFrame(data, SCHEMA)))
    assert {k: len(v) for k, v in rows.items()} == {None: 2, 1: 3, 2: 1}
    assert [x["action"] for x in rows[1]] == ["keep", "merge", "keep"]
    assert parse(render(rows[1]))[0] == ("user", "a < |im_end|> b\n\na < |im_end|> b")
    assert [t[0] for t in parse(render(rows[2]))] == ["user", "assistant"]
    assert chat.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chat_query(spark):
    df = queries.op1(spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()
    for rows in by_conversation(df).values():
        assert legal([t[0] for t in parse(render(rows))])
