import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm.pii import base_spans, find, listed, redact

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(s))) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="a@.1205+-( )_é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text) == brute(text)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "1.2.3.4.5", "300.1.1.1", "001.2.3.4", "a@b.c@d.e", "x.@-.-", "@a.b", " ", ",", "7"]), max_size=8))
def test_base_spans_of_likely_texts(parts):
    text = "".join(parts)
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 5000 + ".", "@" * 100_000, "+1" * 100_000, "1." * 100_000, "a" * 100_000 + "@" + "b" * 100_000):
        base_spans(text)


def spans_of(rows):
    return {r["doc_id"]: r["spans"] for r in rows}


def test_spans_of_documents(docs, corpus, empty):
    rows = find(docs).select("doc_id", listed(find_base()).alias("spans")).collect()
    text = {r[0]: r[1] for r in corpus}
    assert len(rows) == len(corpus)
    for r in rows:
        wanted = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in brute(text[r["doc_id"]]))
        assert r["spans"] == wanted and hashlib.sha256(wanted.encode())
    assert find(empty).count() == 0


def find_base():
    from pyspark.sql import functions as F

    return F.col("base")


def test_patterns_find_what_the_base_misses(make):
    rows = [(i, f"please dial my number +1 (555) 123-{4000 + i} today ok", "en", "s") for i in range(30)]
    rows += [(100, "please dial my number 555-0199-22 today ok", "en", "s"), (101, "in the year 1999-2001 it was", "en", "s")]
    found = {r["doc_id"]: (r["base"], r["added"]) for r in find(make(rows)).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in found[100][1]] == [(22, 33, 3)] and not found[100][0]
    assert not found[101][1] and all(not found[i][1] for i in range(30))
    out = {r["doc_id"]: r["text"] for r in redact(make(rows)).collect()}
    assert out[100] == "please dial my number <PHONE> today ok" and out[3] == "please dial my number <PHONE> today ok" and out[101] == rows[-1][1]


def test_identifiers_in_groups_are_found_whole(make):
    phones = [(i, f"please dial my number +1 (555) 123-{4000 + i} today ok", "en", "s") for i in range(30)]
    cards = [(50 + i, f"he gave his card number {c} as asked", "en", "s") for i, c in enumerate(valid_cards(30))]
    odd = {100: "please dial my number (555) 123-4567 today ok", 101: "he gave his card number 4111 1111 1111 1112 as asked", 102: "see 12 34 or (555) 123-4567, 8 of them",
           103: "please dial my number 555 0199 - 22, today ok", 104: "please dial my number 5550 1234\n777 today ok"}
    rows = phones + cards + [(i, t, "en", "s") for i, t in odd.items()]
    out = {r["doc_id"]: r["text"] for r in redact(make(rows)).collect()}
    assert out[100] == "please dial my number <PHONE> today ok" and out[101] == "he gave his card number <CARD> as asked" and out[102] == odd[102]
    assert out[103] == "please dial my number <PHONE>, today ok" and out[104] == "please dial my number <PHONE>\n777 today ok"


def valid_cards(n):
    from tidelog.llm.pii import luhn

    return [f"4111 1111 {k // 10:04d} {k % 10}{e:03d}" for k in range(n) for e in [next(e for e in range(1000) if luhn(f"41111111{k // 10:04d}{k % 10}{e:03d}"))]]


def test_long_tokens_are_told_apart():
    from tidelog.llm.pii import instances

    one, two = (instances(f"{'w' * 60}{end} so 1234{'x' * 90}{end} there", [])[0] for end in "ab")
    assert one[3] != two[3] and one[4][0] != two[4][0] and one[3] == instances(f"1234{'X' * 90}A", [])[0][3]


def test_redaction_keeps_all_else(docs, corpus, empty):
    out = redact(docs)
    assert out.columns == docs.columns and redact(empty).count() == 0
    rows = out.collect()
    assert len(rows) == len(corpus) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in rows)
    mail = next(r["text"] for r in rows if r["text"] and r["text"].startswith("Mail"))
    assert mail == "Mail me: <EMAIL> or <PHONE>, ip <IP>."
    same = {r[0]: r[1] for r in corpus if not brute(r[1])}
    assert all(r["text"] == same[r["doc_id"]] for r in rows if r["doc_id"] in same and r["doc_id"] is not None)


def fixed_point(edges, seeds, least, accepted, support):
    """Trusted patterns by the definition: whole sets, round after round."""
    import math
    from collections import defaultdict

    of_pattern, of_what = defaultdict(set), defaultdict(set)
    for p, w in edges:
        of_pattern[p].add(w)
        of_what[w].add(p)
    known = set(seeds)
    while True:
        scores = {}
        for p, members in of_pattern.items():
            for kind in {k for _, k in known}:
                n = sum((w, kind) in known for w in members)
                if n >= least and n / len(members) >= support:
                    scores[p, kind] = n / len(members)
        new = set()
        for w, patterns in of_what.items():
            for kind in {k for _, k in scores}:
                own = [scores[p, kind] for p in patterns if (p, kind) in scores]
                belief = 1 - math.exp(sum(math.log1p(-min(x, 0.999)) for x in own))
                if own and round(belief, 9) >= accepted:
                    new.add((w, kind))
        if new <= known:
            return {(p, k): x for (p, k), x in scores.items() if x >= accepted}
        known |= new


def test_bootstrapping_equals_its_definition(spark):
    import random

    from tidelog.llm.pii import bootstrapped

    most_rounds = 0
    for seed in range(4):
        rng = random.Random(seed)
        edges, seeds = set(), set()
        for group in range(6):
            whats = [f"w{group}.{i}" for i in range(14)]
            for j in range(7):
                edges |= {(f"p{group}.{j}", w) for w in rng.sample(whats, rng.randint(2, 12))}
                edges |= {(f"p{group}.{j}", f"w{rng.randrange(6)}.{rng.randrange(14)}") for _ in range(rng.randint(0, 2))}
            seeds |= {(w, group % 3) for w in rng.sample(whats, rng.randint(5, 9))}
        kind = dict(seeds)
        rows = [(kind.get(w), w, p) for p, w in edges for _ in range(rng.randint(1, 2))]
        found = {(r["pattern"], r["kind"]): r["score"] for r in bootstrapped(spark.createDataFrame(rows, "kind int, what string, pattern string"), 3, 0.8, 0.5).collect()}
        wanted = fixed_point(edges, seeds, 3, 0.8, 0.5)
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in found)
        most_rounds += len(wanted)
    assert most_rounds > 5


def test_unseen_formats_are_found_and_decoys_are_not(make):
    """Formats without a base pattern, in contexts that seeds induce; a second round goes on from what the first found."""
    rows = [(i, f"w{i} call me at +1 (555) 123-{4000 + i} n{i}", "en", "s") for i in range(60)]
    rows += [(100 + i, f"v{i} please email john.d{i}@mail{i}.com x{i}", "en", "s") for i in range(20)]
    odd = {
        300: ("u call me at 020 7946 0018 soon", "phone", "020 7946 0018"), 301: ("u call me at (030) 901820 now", "phone", "(030) 901820"), 302: ("so please email jane @ mail9.com today", "email", "jane @ mail9.com"),
        303: ("so please email jim(at)mail8.com today", "email", "jim(at)mail8.com"), 304: ("u call me at tel 0151-12345-6 ok", None, ""), 305: ("u call me at 7946.0018.22, ok", "phone", "7946.0018.22"),
    }
    decoys = ["commit e7fbfec6a80404dc513b99d3fdbf2a6e53400638 is bad", "order no 4111 1111 1111 1112 came", "order 100200300400 at noon", "in the years 1999-2001 it was", "call me at e7fbfec6a80404dc513b99d3fdbf2a6e53400638 if so"]
    # the second round: numbers found by the first are the only ones known of "fax"
    second = [(400 + i, f"a{i} call me at 0{i}20 7946 00{i} z{i}", "en", "s") for i in range(1, 10)] + [(500 + i, f"b{i} fax 0{i}20 7946 00{i} y{i}", "en", "s") for i in range(1, 10)] + [(600, "c fax 0930 123 456 r", "en", "s")]
    table = make(rows + [(i, t, "en", "s") for i, (t, _, _) in odd.items()] + [(900 + i, t, "en", "s") for i, t in enumerate(decoys)] + second)
    out = {r["doc_id"]: r for r in find(table).collect()}
    text = {**{i: t for i, (t, _, _) in odd.items()}, 600: second[-1][1]}
    got = lambda i: [(("email", "ip", "card", "phone")[s["kind"]], text[i][s["start"] : s["end"]]) for s in out[i]["added"]]
    for i, (_, kind, what) in odd.items():
        assert got(i) == ([(kind, what)] if kind else []), i
    assert got(600) == [("phone", "0930 123 456")]
    assert all(not out[900 + i]["added"] for i in range(len(decoys)))
    assert all(not out[r[0]]["added"] and len(out[r[0]]["base"]) == 1 for r in rows)


def test_a_text_of_a_seed_is_one_everywhere(make):
    rows = [(1, "my number: +1 (555) 123-4567.", "en", "s"), (2, "both +1 (555) 123-4567 10.200.30.40 here", "en", "s")]
    out = {r["doc_id"]: r for r in find(make(rows)).collect()}
    assert [s["kind"] for s in out[2]["base"]] == [1] and [(s["start"], s["end"], s["kind"]) for s in out[2]["added"]] == [(5, 22, 3)]
