import re
from collections import defaultdict

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.mixing import BITS, GOLDEN, first_multiple, mix, mix_documents, next_point

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), times=3):
    """Water filling, one source after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: times * sizes[s] for s in names}
        level = (total - sum(times * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        new = {s for s in open_ if weight[s] * level > times * sizes[s]}
        if not new:
            return {s: times * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


@pytest.mark.parametrize("block", [1, 16, 2048])
def test_targets_and_taken(docs, corpus, block):
    sizes = defaultdict(int)
    for _, text, _, source in corpus:
        sizes[source] += len(WORD.findall(text or ""))
    wanted = targets(sizes)
    mixed = mix(docs, block_words=block)
    rows = mixed.documents.collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in rows) == sorted((r[0] if r[0] is not None else -1, len(WORD.findall(r[1] or ""))) for r in corpus)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) < 1 for s in wanted)
    again = mix(docs.repartition(5), block_words=block).documents.collect()
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_prefixes_of_the_schedule_are_near_the_weights(docs):
    mixed = mix(docs, block_words=1)
    slots = sorted((r["slot"], r["source_rank"]) for r in mixed.schedule.collect())
    sources = {r["source_rank"]: r["target"] for r in mixed.fragments.join(mixed.documents.select("source", "target").distinct(), "source").select("source_rank", "target").distinct().collect()}
    total = len(slots)  # also those of the null source, which the join leaves out
    half = slots[: len(slots) // 2]
    for s, target in sources.items():
        assert abs(sum(x == s for _, x in half) - len(half) * target / total) <= 8


def test_fragments_fill_blocks(docs):
    mixed = mix(docs, block_words=32)
    by = defaultdict(int)
    for r in mixed.fragments.collect():
        assert 0 <= r["word_start"] < r["word_end"]
        by[r["source_rank"], r["rank"]] += r["word_end"] - r["word_start"]
    last = defaultdict(int)
    for s, k in by:
        last[s] = max(last[s], k)
    assert all(n == 32 or (k == last[s] and n < 32) for (s, k), n in by.items())


def test_mixed_documents(docs, corpus, empty):
    out = mix_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    taken = defaultdict(int)
    for r in mix(docs).documents.collect():
        taken[r["source"]] += r["taken"]
    assert {s: n for s, n in taken.items() if n} == dict(words)
    assert mix_documents(empty).count() == 0 and mix(empty).documents.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 399), st.integers(0, 399))
def test_first_multiple(m, a, x, y):
    low, high = sorted((x % m, y % m))
    wanted = next((k for k in range(m) if low <= a * k % m <= high), None)
    assert first_multiple(a % m, m, low, high) == wanted


def test_next_points_are_those_of_the_sequence():
    point = lambda k: (k * GOLDEN % 2**64) >> (64 - BITS)
    for low, size, after in ((0, 2**52, 5), (2**61, 2**50, 1000), (2**62 - 2**51, 2**51, 77), (12345, 2**53, 0)):
        found = next_point(after, low, low + size)
        assert found == next(k for k in range(after, after + 10**6) if low <= point(k) < low + size)


def test_the_schedule_decides(make):
    """Slots are unique and are those of the sequence; prefixes are near the weights; another sequence gives another mix."""
    import math

    rows = [(i, " ".join(f"w{i}.{k}" for k in range(37 + i % 90)), "en", "abcdefg"[min(i % 12, 6)]) for i in range(400)]
    out = {}
    for golden in (GOLDEN, 0xB504F333F9DE6485):
        mixed = mix(make(rows), block_words=8, golden=golden)
        schedule = sorted((r["slot"], r["source_rank"], r["rank"]) for r in mixed.schedule.collect())
        slots = [s for s, _, _ in schedule]
        assert len(set(slots)) == len(slots)
        seen = defaultdict(int)
        for _, source, rank in schedule:  # a source's blocks come in order
            assert rank == seen[source]
            seen[source] += 1
        targets_ = {r["source"]: r["target"] for r in mixed.documents.select("source", "target").distinct().collect()}
        share = {i: targets_[s] / sum(targets_.values()) for i, s in enumerate(sorted(targets_))}
        count = defaultdict(int)
        for n, (_, source, _) in enumerate(schedule, 1):
            count[source] += 1
            if golden == GOLDEN and n <= 0.9 * len(schedule):
                assert all(abs(count[s] - n * p) <= 2 + math.log(n + 1) for s, p in share.items())
        out[golden] = {(r["doc_id"], r["taken"], r["first_slot"]) for r in mixed.documents.collect()}
        assert all((t > 0) == (f is not None) for _, t, f in out[golden])
    one, two = out.values()
    assert one != two and {x[:2] for x in one} == {x[:2] for x in two}  # the same words, in another order


def test_mixed_documents_come_in_the_order_of_the_schedule(make):
    rows = [(i, " ".join(["w"] * (5 + i % 30)), "en", "ab"[i % 2]) for i in range(60)]
    table = make(rows)
    first = {r["doc_id"]: r["first_slot"] for r in mix(table, block_words=16).documents.collect()}
    order = [r["doc_id"] for r in mix_documents(table, block_words=16).collect()]
    seen = list(dict.fromkeys(order))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen) and set(seen) == {i for i, s in first.items() if s is not None}


def test_null_and_repeated_ids(make):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, f"{text} {i % 7}", "en", "s") for i in range(60)] + [(5, text, "en", None)] * 20
    mixed = mix(make(rows), block_words=16).documents.collect()
    taken = sum(r["taken"] for r in mixed)
    assert len(mixed) == 80 and 0 <= sum(r["size"] for r in mixed) - taken < 2  # less than a word a source
    assert sum(len(r["text"].split()) for r in mix_documents(make(rows), block_words=16).collect()) == taken


def test_texts_are_shuffled_once(spark, make):
    """However large the table: without broadcasts that small tables get, too, but for the bounded one of ranges."""
    import re

    rows = [(i, " ".join(f"w{i}.{k}" for k in range(5 + i % 30)), "en", "abc"[min(i % 12, 2)]) for i in range(240)]
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        out = mix_documents(make(rows), block_words=16)
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        shuffles = re.findall(r"\) Exchange\s*\nInput \[\d+\]: (.*)", plan)
        assert sum("text#" in x for x in shuffles) == 1
    finally:
        spark.conf.set(setting, before)


def test_every_place_gets_its_text_in_order(spark, make, monkeypatch):
    """Against a plain join and sort, with several epochs, cuts, long texts, rows that share all, and both ways to the parts."""
    import tidelog.llm.mixing as module
    from tidelog.plans.scratch import keep

    rows = [(i, " ".join(f"w{i}.{k}" for k in range(1 + i * i % 90)), "en", [None, "b", "c", "d"][min(i % 40, 3)]) for i in range(150)]
    rows += [(300, "same text for all of these", "en", "b")] * 9 + [(200, " ".join(f"x{k}" for k in range(3000)), "en", "c"), (201, None, "en", "b"), (202, " \n", "en", "c")]
    kept = {}
    monkeypatch.setattr(module, "keep", lambda df, label: kept.__setitem__(label, keep(df, label)) or kept[label])
    for most in (module.ROUTES, 0):
        monkeypatch.setattr(module, "ROUTES", most)
        table = make(rows)
        got = [(r["doc_id"], r["text"]) for r in mix_documents(table, block_words=16).collect()]
        mixed = mix(table, block_words=16)
        of = mixed.copies.join(mixed.lines.select("row", "doc_id", "size"), "row").collect()
        texts = {i: t for i, t, _, _ in rows}
        wanted = {}
        for r in of:
            wanted.setdefault(r["slot"], []).append((r["doc_id"], " ".join(texts[r["doc_id"]].split()[: r["words"]])))
        at = 0
        for slot in sorted(wanted):  # those of one slot come in any order that is the same in each run
            n = len(wanted[slot])
            assert sorted(got[at : at + n]) == sorted(wanted[slot])
            at += n
        assert at == len(got) and {r["epoch"] for r in of} == {0, 1, 2} and any(r["words"] < r["size"] for r in of)
    by = defaultdict(list)
    for r in kept["route"].collect():
        by[r["__source"], r["epoch"]].append((r["__lo"], r["__hi"]))
    assert max(map(len, by.values())) > 1
    for ranges in map(sorted, by.values()):  # so a text is sent to one part for each epoch, but at borders
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
