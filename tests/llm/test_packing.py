import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm.bpe import WordBpe
from tidelog.llm.packing import CapacityTree, best_fit_decreasing, pack
from tidelog.llm.words import Hasher, chunks

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


@settings(deadline=None, max_examples=60)
@given(texts=st.lists(st.text(alphabet="aAbétTÉ'<|>s.9 \n\t́日ß×-", max_size=40), max_size=6))
def test_ids_are_the_librarys(bpe, texts):
    for _, data, offsets in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
        ids, count = bpe.texts(data, offsets, Hasher(), 1)
        wanted = [bpe.library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == wanted


def test_special_tokens_in_text(bpe):
    for text in ("<|endoftext|>", "a<|endoftext|>b it's DON'T '' 'SABC", "x" * 3000):
        _, data, offsets = next(chunks(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])))
        assert bpe.texts(data, offsets, Hasher(), 1)[0].tolist() == bpe.library.encode(text, add_special_tokens=False).ids + [1]


def plain_best_fit(lengths, window):
    """One piece at a time: (how full each window is)."""
    windows = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, used in enumerate(windows) if used + length <= window]
        if fits:
            best = max(fits, key=lambda i: windows[i])
            windows[best] += length
        else:
            windows.append(length)
    return sorted(windows)


@settings(deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_the_plan_is_best_fit_decreasing(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = best_fit_decreasing(counts, 20)
    used: dict = {}
    for j in range(len(plan.rank)):
        length = plan.length[j]
        later = [plan.rank[k] for k in range(len(plan.rank)) if plan.length[k] == length and plan.rank[k] > plan.rank[j]]
        for q in range(plan.rank[j], min([counts[length], *later])):
            i = q - plan.rank[j]
            own = used.setdefault(plan.sequence[j] + i // plan.per[j], set())
            span = set(range(plan.offset[j] + i % plan.per[j] * length, plan.offset[j] + (i % plan.per[j] + 1) * length))
            assert not own & span and max(span) < 20
            own |= span
    assert set(used) == set(range(plan.sequences))
    assert all(own == set(range(len(own))) for own in used.values())
    assert sorted(len(own) for own in used.values()) == plain_best_fit(lengths, 20)


def test_capacity_tree():
    tree = CapacityTree(20)
    assert tree.tightest(0) is None
    for c in (3, 9, 20):
        tree.set(c, 1)
    assert [tree.tightest(c) for c in (0, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    tree.set(9, 0)
    assert tree.tightest(4) == 20


def test_every_id_lies_in_one_piece(docs, corpus, empty):
    packed = pack(docs, PATH, window=64)
    rows = [r.asDict() for r in packed.placement(crc=F.crc32("ids")).collect()]
    library = Tokenizer.from_file(PATH)
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, _, _ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        copies = sum(c[0] == doc_id for c in corpus)
        own = sorted((r for r in by_doc[doc_id]), key=lambda r: r["start"])
        assert len(own) == copies * -(-len(ids) // 64)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["length"] == min(64, len(ids) - r["start"]) and r["start"] % 64 == 0
            assert r["crc"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    windows: dict = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(windows) == set(range(len(windows))) and len(windows) == packed.plan.sequences
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = [r["length"] for r in rows]
    assert sorted(sum(x for _, x in p) for p in windows.values()) == plain_best_fit(lengths, 64)
    sequences = packed.sequences(pad_id=9).collect()
    assert len(sequences) == len(windows) and {len(r["tokens"]) for r in sequences} == {256}
    first = next(r for r in sequences if r["sequence_id"] == 0)
    assert np.frombuffer(bytes(first["tokens"]), "<u4")[-1] != 0
    assert pack(empty, PATH).placement().count() == 0


def test_words_of_two_letters(make, regular):
    library = Tokenizer.from_file(PATH)
    rows = {(r["doc_id"], r["start"]): r["crc"] for r in pack(make(regular), PATH).placement(crc=F.crc32("ids")).collect()}
    wanted = {}
    for doc_id, text, *_ in regular:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        wanted |= {(doc_id, a): zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)}
    assert rows == wanted
