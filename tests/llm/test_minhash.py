import random
import re

import pytest

from tidelog.llm import minhash
from tidelog.llm.components import components
from tidelog.llm.minhash import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(pairs, ids).items()}


def test_equal_to_brute_force(known, docs, corpus, empty):
    rows, table = known
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table).collect()}
    assert found == brute(rows)
    out = near_duplicates(docs).collect()
    assert len(out) == len(corpus) and all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in out if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_large_groups_of_drifting_copies(make, monkeypatch, rounds):
    """Chains of copies where many pairs are below the threshold; without rounds of stars, the blocks do it all."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    original = minhash.class_links
    monkeypatch.setattr(minhash, "class_links", lambda b, t: original(b, t, rounds=rounds))
    rng = random.Random(3)
    rows, at = [], 0
    for family in range(3):
        words = [f"w{family}.{i}" for i in range(60)]
        for _ in range(50):
            if rng.random() < 0.7:
                words[rng.randrange(60)] = f"n{rng.random()}"
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(60)] = f"c{rng.random()}"
            rows.append((at, " ".join(copy), "en", "s"))
            at += 1
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows)).collect()}
    assert found == brute(rows)


def test_one_row_of_each_group_stays(docs, known, empty):
    rows, _ = known
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in brute(rows).values()})
    assert ids.count(None) == 1 and drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(1)
    n = 40
    edges = {"path": [(i + 1, i) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "loops": [(3, 3), (4, 5), (5, 4)]}[shape]
    nodes = {x for e in edges for x in e}
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = groups(edges, nodes)
    assert {x: found.get(x, x) for x in nodes} == wanted


def test_repeated_and_null_ids(make):
    """Rows of one id are one document, linked by any of its texts; a hot id makes no pairs."""
    words = [[f"w{k}.{i}" for i in range(40)] for k in range(3)]
    near = lambda k, i: " ".join([*words[k][:38], f"x{i}", f"y{i}"])
    rows = [(1, near(0, 1), "en", "s"), (2, near(0, 2), "en", "s"), (2, near(1, 3), "en", "s"), (3, near(1, 4), "en", "s"), (4, near(2, 5), "en", "s")] + [(7, near(2, 100 + i), "en", "s") for i in range(300)] + [(None, near(0, 9), "en", "s")] * 3
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(make(rows)).collect()}
    assert out == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (7, 4, False), (None, None, True)}
    kept = [r["doc_id"] for r in drop_near_duplicates(make(rows)).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 4] and kept.count(None) == 3


def test_texts_of_two_words(make, regular):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(make(regular)).collect()}
    assert found == brute(regular)


def test_only_candidates_are_shuffled_with_their_texts_and_read_tables_alone_are_left(spark, make, monkeypatch):
    """Before sets are compared: of the tables so far those that are still read, and the texts sent to the join are few."""
    import os
    import re

    import tidelog.llm.minhash as module

    rows = [(i, " ".join(f"w{i}.{k}" for k in range(30)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(["x", "y"][k == i] + str(k) for k in range(90)), "en", "s") for i in range(2)]
    paths, sent, left = {}, [], []
    keep, links, real = module.keep, module.class_links, module.sifted

    def kept(df, label):
        paths[label] = (out := keep(df, label))._tidelog_path
        return out

    def sifting(slim, *args):
        sent.append((out := real(slim, *args)).count())
        return out

    def linking(*args):
        left.extend(k for k, p in paths.items() if os.path.exists(re.sub("^file:/*", "/", p)))
        return links(*args)

    monkeypatch.setattr(module, "keep", kept)
    monkeypatch.setattr(module, "sifted", sifting)
    monkeypatch.setattr(module, "class_links", linking)
    out = {r["doc_id"]: r["component_id"] for r in module.near_duplicates(make(rows)).collect()}
    assert out[1001] == 1000 and all(out[i] == i for i in range(400))
    assert sorted(left) == ["buckets", "classes", "prints", "sets"] and 2 <= sent[0] < 40
