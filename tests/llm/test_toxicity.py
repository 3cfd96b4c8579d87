import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.toxicity import FuzzyLexicon, allowed_edits, fit, learn, plain, score


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=11), min_size=1, max_size=6, unique=True), st.text(alphabet="abcd", max_size=12))
def test_automaton_equals_edit_distance(terms, word):
    found = FuzzyLexicon(terms).match(word)
    best = min(((distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= allowed_edits(t)), default=None)
    assert found == best


def test_stems_take_any_ending():
    lexicon = FuzzyLexicon(["vequ*", "idiot", "worthless"])
    assert lexicon.match("vequoir") == (0, 0) and lexicon.match("vequ") == (0, 0) and lexicon.match("veju") is None
    assert lexicon.match("idiiot") == (1, 1) and lexicon.match("wurthles") == (2, 2) and lexicon.match("idiol")[0] == 1
    assert plain("(1d10T!)") == "idiot" and plain("2024") == "2024"


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="abc", min_size=4, max_size=9), min_size=1, max_size=5, unique=True), st.sets(st.integers(0, 4)), st.text(alphabet="abcd", max_size=14))
def test_automaton_with_stems_equals_edit_distance(bodies, stems, word):
    terms = [b + "*" * (i in stems) for i, b in enumerate(bodies)]
    near = lambda t: min(distance(word[:k], t[:-1]) for k in range(len(word) + 1)) if t.endswith("*") else distance(word, t)
    found, best = FuzzyLexicon(terms).match(word), min(((near(t), i) for i, t in enumerate(terms) if near(t) <= allowed_edits(t)), default=None)
    assert (found and found[0]) == (best and best[0]) and (not found or near(terms[found[1]]) == found[0])


def test_misspelled_stems_are_hits():
    lexicon = FuzzyLexicon(["bomente*", "achlich*", "vequ*"])
    assert lexicon.match("bomentecil") == (0, 0) and lexicon.match("bomnteci") == (1, 0) and lexicon.match("achlixhkeit") == (1, 1) and lexicon.match("axchlichkeit") == (1, 1)
    assert lexicon.match("ahclichkeit") is None and lexicon.match("vexuoir") is None  # two letters swapped are two edits; four letters allow none


def test_known_words_are_no_misspelled_stems():
    lexicon = FuzzyLexicon(["achlich*", "sachlicht"], frozenset({"sachlich", "sachlichta", "achlichen"}))
    assert lexicon.match("sachlich") == (1, 1) and lexicon.match("sachlichta") == (1, 1) and lexicon.match("achlichen") == (0, 0)
    assert FuzzyLexicon(["achlich*"], frozenset({"sachlich"})).match("sachlich") is None and FuzzyLexicon(["achlich*"]).match("sachlich") == (1, 0)


def build(n=900, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(4):
                term = rng.choice(["grobian", "schuft", "flegel", "tropfx" + rng.choice("abcdefgh") + rng.choice("aeiou")])
                if rng.random() < 0.3 and not term.startswith("tropf"):
                    k = rng.randrange(1, len(term) - 1)
                    term = term[:k] + "x" + term[k:]
                words.insert(rng.randrange(len(words)), term)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = build()
    rows += [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, rows[0][1], None, None)]
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = learn(docs, table)
    assert {"grobian", "schuft", "flegel"} <= set(model.terms) and any(t.startswith("tropf") for t in model.terms)
    out = {r["doc_id"]: r for r in score(docs, model).collect()}
    assert len(out) == len(rows)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(out[i]["score"], y) for i, _, y in labels if out[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.98 and sum(s >= 0.7 for s in pos) >= 0.95 * len(pos) and sum(s >= 0.7 for s in neg) <= 0.01 * len(neg)
    assert out[5002]["score"] == out[0]["score"] and out[5000]["score"] == out[5001]["score"] < 0.5


def test_held_out_labels_do_not_matter(spark, make):
    rows, labels = build(300)
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in labels]
    one, two = (learn(make(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert one == two


def test_without_labels_or_rows(spark, make, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(docs, learn(docs, none)).collect()} == {0.0}
    assert score(empty, learn(empty, none)).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 7)], "doc_id long, quality int, toxic int")
    assert score(docs, learn(docs, odd)).count() == docs.count()


def test_regression_separates():
    import numpy as np

    x = np.array([[1.0, v] for v in range(20)])
    beta = fit(x, (x[:, 1] > 9).astype(float), penalty=0.01)
    assert ((x @ beta > 0) == (x[:, 1] > 9)).all()


def test_terms_and_words_are_not_capped(spark, make):
    from tidelog.llm.toxicity import chosen_terms

    rows = [{"word": f"word{i:04d}x", "t": 9, "odds": 4.0 + i / 1000} for i in range(3000)] + [{"word": "stem*", "t": 50, "odds": 5.0}, {"word": "stemm*", "t": 49, "odds": 5.0}]
    found = chosen_terms(rows)
    assert len(found) == 3001 and found[0] == ("stemm*", 5.0) and {t for t, _ in found} == {r["word"] for r in rows} - {"stem*"}
    long = "z" * 30 + "q" * 30
    rows, labels = build(500)
    rows = [(i, t + (f" u{i} {long} v{i}" if labels[i][2] else ""), *rest) for i, t, *rest in rows]
    model = learn(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert long in model.terms or any(long.startswith(t[:-1]) for t in model.terms if t.endswith("*"))


def test_training_is_bounded_and_ids_count_once(spark, make):
    from tidelog.llm.toxicity import training_rows

    rows = [(i % 30, f"text {i} here", "en", "s") for i in range(600)] + [(None, "no id", "en", "s")] * 5
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)] * 3 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert training_rows(make(rows), labels, 10).count() == 10 and training_rows(make(rows), labels).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(30))


def test_quotations_are_told_from_abuse(spark, make):
    """A quoted term counts less than a used one, also where training shows no quotation, and less still where it does."""
    rng = random.Random(9)
    rows, labels = build()
    terms, filler = ["grobian", "schuft", "flegel"], " ".join(t for (_, t, *_), (_, _, y) in zip(rows, labels, strict=True) if not y).split()

    def text(one, two, three):
        words = [rng.choice(filler) for _ in range(40)]
        return " ".join([*words[:20], one.format(rng.choice(terms)), *words[20:30], two, rng.choice(terms), three, *words[30:]])

    cited = lambda first: [(first + k, text('"{}"', '"so', 'then"'), "en", "s") for k in range(40)]
    quoted, more, used = cited(10_000), cited(30_000), [(20_000 + k, text("{}", "so", "then"), "en", "s") for k in range(40)]
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    for train, known in ((rows, labels), (rows + more, labels + [(r[0], 1, 0) for r in more])):
        out = {r["doc_id"]: r["score"] for r in score(make(rows + quoted + used), learn(make(train), table(known))).collect()}
        q, u = [out[r[0]] for r in quoted], [out[r[0]] for r in used]
        assert sum(x < 0.5 for x in q) >= 38 and sum(x >= 0.7 for x in u) >= 36, (sorted(q)[-5:], sorted(u)[:5])


def test_very_long_texts_and_null_ids(spark, make):
    rows, labels = build(600)
    model = learn(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean = " ".join(rows[next(i for i, _, y in labels if not y)][1] for _ in range(4000))
    rude = clean + " grobian schuft flegel" * 4000
    out = {(r["doc_id"], r["n_hits"] > 0): r for r in score(make([(1, clean, "en", "s"), (2, rude, "en", "s"), (None, "grobian", "en", "s"), (None, None, "en", "s")]), model).collect()}
    assert out[2, True]["n_hits"] >= 12_000 and out[2, True]["score"] > 0.7 and out[None, True]["held_out"] is False
