"""The stages against brute force on a small folder of tables, and the whole run."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.plans.scratch import keep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, folder, corpus):
    from tests.llm.test_minhash import brute as duplicates
    from tests.llm.test_mixing import targets
    from tests.llm.test_pii import brute as spans
    from tests.llm.test_quality import brute as measures

    rows = {}
    for i, t, _, s in corpus:
        m = measures(t)
        n, chars, symbols, lines, dup, dup_chars, again, kinds, _ = m
        bad = n < 20 or 100 * again > 30 * n or 10 * symbols > n or 2 * dup > lines or 2 * dup_chars > chars or chars < 2 * n or chars > 25 * n or (n >= 100 and 20 * kinds < n)
        if not bad and i is not None:
            rows[i] = (i, t, "en", s)
    groups = duplicates(list(rows.values()))
    kept = [rows[i] for i in rows if groups[i][1] == i]
    null = next((r for r in corpus if r[0] is None), None)
    kept += [null] if null and measures(null[1])[0] >= 20 else []
    clean = []
    for i, t, lang, s in kept:
        assert not spans(t)
        clean.append((i, t, lang, s))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), name)
        assert docs.columns == columns
        counts.append(docs)
    third = {(r["doc_id"], r["text"]) for r in counts[2].collect()}
    assert third == {(i, t) for i, t, _, _ in clean} and counts[2].count() == len(clean)
    sizes: dict = {}
    for _, t, _, s in clean:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    wanted, got = targets(sizes), {}
    for r in counts[3].collect():
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert all(abs(got[s] - wanted[s]) < 1 for s in wanted)
    pieces = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in counts[3].collect())
    assert sum(r["length"] for r in pieces) == total
    windows = np.array([(r["sequence_id"], r["offset"], r["length"]) for r in pieces])
    for k in np.unique(windows[:, 0]):
        own = windows[windows[:, 0] == k]
        own = own[own[:, 1].argsort()]
        assert (own[:, 1] == np.concatenate(([0], np.cumsum(own[:, 2])[:-1]))).all() and own[:, 2].sum() <= 2048
