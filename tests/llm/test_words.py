import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.words import Hasher, Windows, Words, chunks, covered, repeated

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\ré ", max_size=30)), max_size=8)


def split(texts, limit=10):
    out = []
    for part, data, offsets in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), limit=limit):
        w = Words(data, offsets)
        raw = data.tobytes()
        out += [[raw[a:b].decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)] for i in range(part.num_rows)]
    return out


@settings(deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    assert split(texts) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(deadline=None)
@given(TEXTS, st.integers(1, 3))
def test_windows_hash_alike_only_if_equal(texts, width):
    for _, data, offsets in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
        w = Words(data, offsets)
        at, text, keys = Windows()(Hasher()(data, w.starts, w.ends), w.first, width)
        lists = split(texts, 1000)
        full = [(t, tuple(lists[t][i : i + width])) for t in range(len(lists)) for i in range(len(lists[t]) - width + 1)]
        assert [t for t, _ in full] == text.tolist()
        by: dict = {}
        for (_, words), k in zip(full, keys.tolist(), strict=True):
            assert by.setdefault(k, words) == words
        assert len(by) == len({words for _, words in full})


def test_repeated_and_covered():
    assert repeated(np.array([3, 1, 3, 2])).tolist() == [True, False, True, False]
    assert covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]


def test_two_symbols_do_not_cancel_out():
    from tests.llm.conftest import alternating

    hasher, windows = Hasher(), Windows()
    for n in (512, 1024, 2048, 4096, 8192):
        words = ["".join(alternating(n, a, b)) for a, b in ("ab", "ba")]
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        one, two = hasher(data, np.array([0, n + 1]), np.array([n, 2 * n + 1]))
        assert one != two
        for width in (16, 50, 512, 1024):
            own = [windows.fold(np.array(alternating(n, a, b), np.uint64), width) for a, b in ((one, two), (two, one))]
            sequences = {tuple(s[i : i + width]) for s in (alternating(n, 0, 1), alternating(n, 1, 0)) for i in range(n - width + 1)}
            assert len(np.unique(np.concatenate(own))) == len(sequences)


def test_long_ranges_hash_alike_in_pieces():
    rng = np.random.default_rng(1)
    data = rng.integers(33, 90, 5000).astype(np.uint8)
    whole, pieces = Hasher(), Hasher()
    pieces.AT_ONCE = 37
    starts = np.array([0, 10, 400, 401, 2500])
    ends = np.array([10, 400, 401, 2500, 5000])
    assert whole(data, starts, ends).tolist() == pieces(data, starts, ends).tolist()


def test_same_bytes():
    from tidelog.llm.words import same_bytes

    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    starts, other = rng.integers(0, 300, 80), rng.integers(0, 300, 80)
    size, its = rng.integers(1, 9, 80), rng.integers(1, 9, 80)
    its[::2] = size[::2]
    starts[0], other[0], size[0], its[0] = 5, 5, 90, 90
    wanted = [data[a : a + n].tolist() == data[b : b + m].tolist() for a, n, b, m in zip(starts, size, other, its, strict=True)]
    for at_once in (1, 7, 50, 1 << 22):
        assert same_bytes(data, starts, starts + size, data, other, other + its, at_once).tolist() == wanted
        assert same_bytes(data, starts, starts + size, data.copy(), other, other + its, at_once).tolist() == wanted


def test_ranges_that_only_share_a_hash_are_told_apart():
    from tidelog.llm.words import distinct

    data = np.frombuffer(b"aa bb aa cc", np.uint8)
    starts = np.array([0, 3, 6, 9])
    where, which = distinct(lambda d, a, b: np.zeros(len(a), np.uint64), data, starts, starts + 2)
    words = [data[starts[where[i]] : starts[where[i]] + 2].tobytes() for i in which]
    assert words == [b"aa", b"bb", b"aa", b"cc"]


def test_batches_are_bounded_whatever_the_setting_says(spark):
    from tidelog.llm.batches import BYTES, SETTING, bounded_batches

    before = spark.conf.get(SETTING)
    try:
        for now, wanted in (("4m", "4m"), ("1g", str(BYTES)), ("100kb", "100kb"), (str(BYTES * 2), str(BYTES)), ("-1", str(BYTES))):
            spark.conf.set(SETTING, now)
            bounded_batches(spark)
            assert spark.conf.get(SETTING) == wanted
    finally:
        spark.conf.set(SETTING, before)
