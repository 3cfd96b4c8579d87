import numpy as np
import pytest

from tidelog.llm import embeddings
from tidelog.llm.embeddings import Index, indexed_duplicates, near_duplicates, traversal

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def vectors(n=700, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    hot = rng.normal(size=dim)
    for i in range(0, n, 3):  # a third is one group
        x[i] = hot + 0.02 * rng.normal(size=dim)
    for i in range(1, n, 11):
        x[i] = x[(i * 7) % n] + 0.05 * rng.normal(size=dim)
    return x


def brute(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    return ids, link


@pytest.mark.parametrize("block", [64, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(vectors())]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, None] + [0.0] * 14), (5003, [float("nan")] * 16), (5004, [float("inf")] + [0.0] * 15), (5005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    out = {r["vec_id"]: r for r in near_duplicates(table).collect()}
    ids, link = brute(rows[:700])
    found = sum(out[i]["n_links"] for i in ids)
    assert found <= link.sum() and found >= 0.98 * link.sum()
    assert all(out[int(i)]["n_links"] <= n for i, n in zip(ids, link.sum(1), strict=True))
    hot = [int(i) for i in ids if i % 3 == 0 and i % 11 != 1]
    assert {out[i]["component_id"] for i in hot} == {0} and out[0]["kept"] and not out[3]["kept"]
    for i in range(5000, 5006):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)


def test_small_and_odd_tables(spark):
    table = lambda rows: spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    assert near_duplicates(table([])).count() == 0
    assert near_duplicates(table([(1, None)])).collect()[0]["n_links"] == 0
    rows = near_duplicates(table([(1, [1.0]), (2, [2.0]), (3, [-1.0]), (None, [1.0])])).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in rows} == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (None, 0, None)}
    twice = near_duplicates(table([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert len(twice) == 3 and all(r["component_id"] == r["vec_id"] for r in twice)


def test_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    index = Index(rng.normal(size=(9, 4)), rng.normal(size=(7, 5)))
    x = rng.normal(size=(20, 9))
    full = ((x[:, None, :4] - index.first) ** 2).sum(2)[:, :, None] + ((x[:, None, 4:] - index.second) ** 2).sum(2)[:, None, :]
    for most in (1, 5, 63):
        found = traversal(x, index, most)
        for row, d in zip(found, full.reshape(20, -1), strict=True):
            assert row.tolist() == np.argsort(d, kind="stable")[:most].tolist()


def test_rows_of_one_id_are_one_vector(spark):
    """A partner counts once, whether rows repeat or an id has several vectors."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.99, 0.05, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a)] * 3 + [(2, b)] + [(3, a), (3, c), (3, c)] + [(4, c)] + [(5, [0.0, 1.0, 0.0, 0.0])] + [(9, b)] * 2
    out = near_duplicates(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in out} == {(1, 3, 1), (2, 3, 1), (3, 4, 1), (4, 1, 1), (5, 0, 5), (9, 3, 1)}


def test_a_hot_id(spark):
    rows = [(7, [1.0, 0.001 * i]) for i in range(900)] + [(i, [1.0, 0.0]) for i in range(100, 130)]
    out = near_duplicates(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect()
    assert {(r["vec_id"], r["n_links"]) for r in out} == {(7, 30)} | {(i, 30) for i in range(100, 130)}


def test_recall_is_measured_and_reached(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))  # no clusters: links cross many cells
    table = spark.createDataFrame([(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)], SCHEMA)
    ids, link = brute([(i, list(r)) for i, r in enumerate(x)])
    for first, most in ((128, 2048), (2, 4)):  # of few cells: all are compared
        monkeypatch.setattr(embeddings, "FIRST_CELLS", first)
        monkeypatch.setattr(embeddings, "MOST_CELLS", most)
        out, index = indexed_duplicates(table)
        found = {r["vec_id"]: r["n_links"] for r in out.collect()}
        assert index.recall >= 0.995 and sum(found.values()) >= 0.99 * link.sum()
        if most == 4:
            assert len(index.first) == 1 and all(found[int(i)] == n for i, n in zip(ids, link.sum(1), strict=True))
