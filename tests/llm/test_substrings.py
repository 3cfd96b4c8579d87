import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.substrings import drop_repeated, sliding_min

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """doc_id -> (words, removed, kept), windows judged on the input."""
    first: dict = {}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        mark = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < doc_id:
                mark[i : i + width] = [True] * width
        out[doc_id] = (len(words), sum(mark), " ".join(w for w, m in zip(words, mark, strict=True) if not m))
    return out


@given(st.lists(st.integers(0, 50), min_size=1, max_size=30), st.integers(1, 12))
def test_sliding_min(x, width):
    out = sliding_min(np.array(x), width)
    for i in range(len(x) - width + 1):
        assert out[i] == min(x[i : i + width])


def test_equal_to_brute_force(known, docs, empty):
    rows, table = known
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in drop_repeated(table).collect()}
    assert found == brute(rows, 50)
    assert sum(x[1] for x in found.values()) > 500
    out = drop_repeated(docs).collect()  # nulls and repeated rows
    assert len(out) == docs.count() and [r["n_removed"] for r in out if r["doc_id"] is None] == [0]
    assert drop_repeated(empty).count() == 0


@settings(deadline=None, max_examples=6)
@given(st.lists(st.text(alphabet="ab ", max_size=120), min_size=1, max_size=12))
def test_small_alphabets(spark, texts):
    from tidelog.llm.substrings import repeated_spans

    rows = [(i, t) for i, t in enumerate(texts)]
    spans = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), window=6, gram=2, cells=1 << 10).collect()
    gone = {r["doc_id"]: {p for s in r["spans"] for p in range(s["lo"], s["hi"] + 6)} for r in spans}
    wanted = brute(rows, 6)
    assert {i: len(gone.get(i, ())) for i, _ in rows} == {i: w[1] for i, w in wanted.items()}


def test_counts_replace_columns_of_their_names(make, corpus):
    from pyspark.sql import functions as F

    out = drop_repeated(make(corpus[:3]).withColumn("n_words", F.lit("mine")))
    assert out.columns.count("n_words") == 1 and dict(out.dtypes)["n_words"] == "bigint"


def test_sketch_overestimates_and_filters(spark):
    """No repeated window is lost at any width, and a wide sketch lets few others through."""
    import pyarrow as pa

    from tidelog.llm.substrings import passes, runs_of, sketch_of
    from tidelog.llm.words import Hasher, Windows, Words, chunks

    rng = np.random.default_rng(4)
    shared = " ".join(f"s{x}" for x in range(80))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) + (" " + shared if i % 5 == 0 else "") for i in range(40)]
    slim = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp long").repartition(5)
    _, data, offsets = next(chunks(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])))
    w = Words(data, offsets)
    text, lo, hi, value = runs_of(Hasher()(data, w.starts, w.ends), w.first, Windows(), 50, 10)
    own, count = np.unique(value, return_counts=True)
    twice = np.isin(value, own[count > 1])
    assert twice.any() and not twice.all()
    let_through = []
    for cells in (1 << 4, 1 << 10, 1 << 22):
        ok = passes(value, sketch_of(slim, 50, 10, cells))
        assert ok[twice].all()
        let_through.append(float(ok[~twice].mean()))
    assert let_through[0] == 1.0 and let_through[1] < 0.9 and let_through[2] < 0.01


def test_a_hot_passage_is_spread(make):
    from tidelog.llm.substrings import drop_repeated as removed

    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, f"own{i} {passage} end{i}" if i % 2 else " ".join(f"u{i}.{x}" for x in range(70)), "en", "s") for i in range(1500)]
    out = {r["doc_id"]: r["n_removed"] for r in removed(make(rows)).collect()}
    assert out == {i: 60 if i % 2 and i > 1 else 0 for i in range(1500)}


def test_texts_of_two_words(make, regular):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in drop_repeated(make(regular)).collect()}
    assert found == brute(regular, 50)
