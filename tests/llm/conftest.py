import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, `key` string, size long, block int"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(n))


def alternating(n, a, b):
    """The Thue-Morse sequence in two symbols: what cancels out in hashes that are polynomials modulo a power of two."""
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    texts = [words(rng, rng.randint(5, 160)) for _ in range(40)]
    base = words(rng, 120).split()
    for i in range(12):  # near copies
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [texts[7].upper()]
    passage = words(rng, 70)
    texts += [words(rng, 30) + " " + passage + "\n" + words(rng, 20) for _ in range(6)]
    texts += ["", " \t\n", None, "one", "a b c", "Mail me: jo.doe@example.com or +1 (555) 123-4567, ip 10.0.0.1.", "é ß 日本  x", passage]
    texts += ["line one two\nline one two\n\nother line here\nline one two\n" * 3, words(rng, 9000), "Na " * 60]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]  # repeated rows
    rows += [(None, texts[1], None, "s1")]
    return rows


@pytest.fixture(scope="session")
def regular():
    """Rows with long words of two letters, and long texts of two words, that differ in their order alone."""
    texts = []
    for a, b in (("a", "b"), ("b", "a")):
        texts += [f"one {''.join(alternating(n, a, b))} two" for n in (1024, 2048, 4096, 8192)]
        texts += [" ".join(alternating(2048, a, b)), "x " + " ".join(alternating(600, a, b))]
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame of documents with extra columns whose names operators use inside."""

    def build(rows):
        full = [(i, t, lang, s, len(t or ""), 7, "k", 3, 1) for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def docs(make, corpus):
    return make(corpus)


@pytest.fixture(scope="session")
def known(make, corpus):
    """Without rows whose id is null or repeated, for comparisons by id."""
    seen, rows = set(), []
    for r in corpus:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    return rows, make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
