import re
from collections import Counter

from tidelog.llm.quality import POLICIES, RULES, ablations, apply_policy, filter_documents, ledger, policy_mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    mark = [False] * len(words)
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            mark[i : i + 8] = [True] * 8
    lines, before, dup, dup_chars, n = text.split("\n"), set(), 0, 0, 0
    for line in lines:
        if WORD.search(line):
            n += 1
            if line in before:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            before.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), n, dup, dup_chars, sum(mark), len(set(words)), max(map(len, words), default=0))


def test_measures_equal_brute_force(docs, corpus, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", "n_distinct_words", "longest_word"]
    rows = ledger(docs).collect()
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[n] for n in names)) for r in rows)
    assert found == sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in corpus)
    assert ledger(empty).count() == 0


def test_failures_policies_and_ablations(docs):
    book = ledger(docs)
    rows = book.collect()
    for r in rows:
        assert bool(r["failures"] & 1) == (r["n_words"] < 20)
        assert bool(r["failures"] & 2) == (100 * r["n_repeat_words"] > 30 * r["n_words"])
    kept = apply_policy(book, "v1").where("kept").count()
    assert kept == sum(not r["failures"] & policy_mask("v1") for r in rows)
    for a in ablations(book, "v1").collect():
        bit = policy_mask((a["rule"],))
        assert a["failed"] == sum(bool(r["failures"] & bit) for r in rows)
        assert a["failed_alone"] == sum(r["failures"] == bit for r in rows)
        assert a["kept_without"] == sum(not r["failures"] & (policy_mask("v1") & ~bit) for r in rows)
    assert set(POLICIES["base"]) < {n for n, _ in RULES}


def test_variety_does_not_fall_with_length(make):
    import random

    rng = random.Random(3)
    clean = " ".join(f"word{rng.randrange(45_000)}" for _ in range(1_050_000))
    poor = " ".join(f"word{rng.randrange(400)}" for _ in range(100_000))
    rows = {r["doc_id"]: r for r in ledger(make([(1, clean, "en", "s"), (2, poor, "en", "s"), (3, clean[:20_000], "en", "s")])).collect()}
    assert 20 * rows[1]["n_distinct_words"] < rows[1]["n_words"] and rows[1]["failures"] == 0
    assert rows[2]["failures"] == policy_mask(("few_kinds",)) and rows[3]["n_window_kinds"] == rows[3]["n_distinct_words"]


def test_filter_keeps_rows_as_they_are(docs, corpus, empty):
    out = filter_documents(docs)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    assert None not in texts and "" not in texts and corpus[0][1] in texts and ("Na " * 60) not in texts
    assert filter_documents(empty).count() == 0


def test_texts_of_two_words(make, regular):
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", "n_distinct_words", "longest_word"]
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in ledger(make(regular)).collect()}
    assert found == {i: brute(t) for i, t, *_ in regular}
