import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.sharding import difference, shard_documents


@settings(deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 5))
def test_differencing_assigns_every_group_to_one_shard(sizes, shards):
    found = difference([[s] + [0] * (shards - 1) for s in sizes])
    total = [0] * shards
    for s, bins in zip(sizes, found, strict=True):
        assert sorted(bins) == list(range(shards))
        total[bins[0]] += s
    assert sum(total) == sum(sizes) and max(total) - min(total) <= max(sizes)


def test_two_way_example():
    bins = difference([[s, 0] for s in (8, 7, 6, 5, 4)])
    sums = [sum(s for s, b in zip((8, 7, 6, 5, 4), bins, strict=True) if b[0] == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2  # what differencing gives for these


def test_shards(docs, corpus, empty):
    for limits in ({}, {"part_groups": 5, "combined": 3}):
        rows = [r.asDict() for r in shard_documents(docs, shards=6, **limits).collect()]
        assert len(rows) == len(corpus)
        expected = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus)
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == expected
        where: dict = {}
        for r in rows:
            assert where.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        for k in range(6):
            own = [r for r in rows if r["shard"] == k]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(6)]
        rest = sorted(sums)[:-1]  # one text is longer than a fair share
        assert max(rest) - min(rest) < 700
    assert shard_documents(empty).count() == 0


def naive(sizes, shards):
    """Differencing of whole groups, by the definition: lists of groups in bins, the two of largest spread combined in opposite order."""
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    parts = [(i, [([k], sizes[k])] + [([], 0)] * (shards - 1)) for i, k in enumerate(order)]
    serial = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (p[1][-1][1] - p[1][0][1], p[0]))
        (_, a), (_, b), *parts = parts
        bins = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        parts.append((serial, sorted(bins, key=lambda x: -x[1])))
        serial += 1
    return [set(groups) for groups, _ in parts[0][1]]


def test_documents_equal_naive_differencing(make):
    import hashlib
    import random

    rng = random.Random(2)
    texts = ["x" * (7 * i + 1) + f"{i}" for i in range(60)]
    rows = [(i, rng.choice(texts), "en", "s") for i in range(200)]
    sizes: dict = {}
    for _, t, *_ in rows:
        k = hashlib.md5(t.encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + len(t) + 8
    wanted = naive(sizes, 5)
    out = shard_documents(make(rows), shards=5).collect()
    text = {r[0]: hashlib.md5(r[1].encode()).hexdigest() for r in rows}
    found = [{text[r["doc_id"]] for r in out if r["shard"] == k} for k in range(5)]
    assert sorted(map(sorted, found)) == sorted(map(sorted, wanted))


def test_hot_null_id(make):
    rows = [(None, f"text {i}", "en", "s") for i in range(500)] + [(3, "same", "en", "s")] * 400
    out = shard_documents(make(rows), shards=4).collect()
    assert len(out) == 900 and len({r["shard"] for r in out if r["doc_id"] == 3}) == 1
    for k in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
