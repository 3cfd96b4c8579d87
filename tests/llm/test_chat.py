import pytest

from tidelog.llm.chat import conversations

SCHEMA = "conv_id long, turn long, role string, text string, uid string, h long"


@pytest.fixture
def build(spark):
    return lambda rows: spark.createDataFrame([(*r, "u", 1) for r in rows], SCHEMA).repartition(3)


def by_turn(df):
    return {(r["conv_id"], r["turn"]): r for r in df.collect()}


def test_quotes_link_to_what_they_quote(build):
    rows = [
        (1, 0, "user", "How do I  sort?\nIt is slow."),
        (1, 1, "assistant", "Use an index."),
        (1, 2, "user", "And memory?"),
        (1, 3, "assistant", "> how do i sort?\n> it is slow.\nSorting is n log n.\n"),
        (1, 4, "user", "> > How do I sort?\n> Sorting is n log n.\n\nThanks."),
        (1, 5, "user", "> never said\nWhat?"),
        (2, 0, "user", "> Use an index.\nother conversation"),
    ]
    out = by_turn(conversations(build(rows)))
    assert [out[1, t]["parent_turn"] for t in range(6)] == [None, None, None, 0, 3, None]
    assert [out[1, t]["root_turn"] for t in range(6)] == [0, 1, 2, 0, 0, 5]
    assert [out[1, t]["position"] for t in (0, 3, 4, 1, 2, 5)] == [0, 1, 2, 3, 4, 5]
    assert out[1, 3]["text"] == "Sorting is n log n." and out[1, 4]["text"] == "Thanks."
    assert (out[1, 4]["max_level"], out[1, 4]["n_quoted"], out[1, 4]["n_linked"]) == (2, 2, 2)
    assert (out[1, 5]["n_quoted"], out[1, 5]["n_linked"]) == (1, 0)
    assert out[2, 0]["parent_turn"] is None and out[2, 0]["text"] == "other conversation"
    assert out[1, 1]["formatted"] == "<|assistant|>\nUse an index.<|end|>\n" and out[1, 1]["text"] == "Use an index."


def brute(rows):
    """parent by turn of one conversation: votes of level-1 lines for the latest earlier message that has the line."""
    import re

    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"^[\s>]*", "", s)).strip().lower()
    own, parents = [], {}
    for turn, text in rows:
        votes: dict = {}
        for line in text.split("\n"):
            lead = re.match(r"^[\s>]*", line)[0].count(">")
            if lead == 1 and norm(line):
                hits = [t for t, n in own if n == norm(line) and t < turn]
                if hits:
                    votes[max(hits)] = votes.get(max(hits), 0) + 1
        parents[turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
        own += [(turn, norm(line)) for line in text.split("\n") if re.match(r"^[\s>]*", line)[0].count(">") == 0 and norm(line)]
    return parents


def test_long_conversation_equals_brute_force(build):
    import random

    rng = random.Random(2)
    rows = []
    for t in range(900):
        lines = [rng.choice(["same line", f"line {rng.randrange(40)}", f"Line   {t}"]) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            lines.insert(0, "> " + rng.choice(["same line", f"line {rng.randrange(40)}", f"line {rng.randrange(900)}"]))
        rows.append((7, t, "user", "\n".join(lines)))
    out = by_turn(conversations(build(rows)))
    wanted = brute([(t, text) for _, t, _, text in rows])
    assert {t: out[7, t]["parent_turn"] for t in range(900)} == wanted
    assert sorted(r["position"] for r in out.values()) == list(range(900))
    for t, parent in wanted.items():
        if parent is not None:
            assert out[7, t]["position"] > out[7, parent]["position"]


def test_nulls_empty_and_repeated_rows(build):
    rows = [(None, 0, "user", "a"), (1, None, None, "> a\nb"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "user", ""), (1, 2, "user", ">" * 5000 + " deep\n" + "x " * 20000)]
    out = conversations(build(rows)).collect()
    assert len(out) == 6 and sorted(r["position"] for r in out if r["conv_id"] == 1) == [0, 1, 2, 3, 4]
    assert {r["role"] for r in out} == {"user", "unknown"}
    assert next(r for r in out if r["turn"] == 2)["max_level"] == 5000
    assert conversations(build([])).count() == 0


def test_plan_has_no_python(build):
    plan = conversations(build([(1, 0, "user", "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sql_has_the_same_rows(spark, build, tmp_path):
    """The SQL of the query, on conversations with quotes."""
    import random

    import duckdb

    from tidelog.llm.sql import CHAT

    rng = random.Random(6)
    rows = []
    for c in range(6):
        for t in range(12):
            lines = [f"line {rng.randrange(9)}" for _ in range(2)]
            for _ in range(rng.randint(0, 3)):
                lines.insert(0, rng.choice([">", "> ", "> > "]) + f"Line  {rng.randrange(9)}")
            rows.append((c, t, "user", "\n".join(lines)))
    table = build(rows)
    table.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    out = conversations(table)
    wanted = con.sql(f"SELECT {', '.join(out.columns)} FROM ({CHAT})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, wanted))


REWRAPPED = [
    (1, 0, "user", "The first line of a paragraph\nthat goes on here.\n\nAnother one."),
    (1, 1, "assistant", "A whole body that is\nwrapped by hand\n\nin two paragraphs."),
    (1, 2, "user", "> The first line of\n> a paragraph that goes on here.\nYes."),  # a paragraph, wrapped anew
    (1, 3, "user", "> A whole body that is wrapped\n> by hand in two\n> paragraphs.\nRight."),  # a whole body
    (1, 4, "user", "> > The first line of a paragraph that goes on here.\n> Yes.\nNo."),  # a paragraph on one line, and a line
    (1, 5, "user", "> wrapped by hand\n> and something else\nPart."),  # one line of a passage that is nowhere
    (1, 6, "user", "> The first line of\n>\n> a paragraph that goes on here.\nApart."),  # a blank line ends a passage
]


def test_passages_that_were_wrapped_anew(build):
    out = by_turn(conversations(build(REWRAPPED)))
    assert [out[1, t]["parent_turn"] for t in range(7)] == [None, None, 0, 1, 2, 1, None]
    assert [out[1, t]["n_linked"] for t in range(7)] == [0, 0, 2, 3, 2, 1, 0] and [out[1, t]["n_quoted"] for t in range(7)] == [0, 0, 2, 3, 2, 2, 2]


def test_sql_of_passages(spark, build, tmp_path):
    import random

    import duckdb

    from tidelog.llm.sql import CHAT

    rng = random.Random(3)
    rows = [*REWRAPPED]
    for c in range(2, 6):
        for t in range(10):
            lines = []
            for _ in range(rng.randint(1, 5)):
                words = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
                lines.append(rng.choice(["", "", "> ", ">> "]) + words)
            rows.append((c, t, "user", "\n".join(lines)))
    table = build(rows)
    table.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    out = conversations(table)
    wanted = con.sql(f"SELECT {', '.join(out.columns)} FROM ({CHAT})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, wanted))


def test_a_very_long_quotation(build):
    lines = [f"line {i} of it" for i in range(30_000)]
    rows = [(1, 0, "user", "\n".join(lines)), (1, 1, "user", "\n".join("> " + " ".join(lines[i : i + 2]) for i in range(0, 30_000, 2)) + "\nSo?")]
    out = by_turn(conversations(build(rows)))
    assert (out[1, 1]["parent_turn"], out[1, 1]["n_linked"], out[1, 1]["text"]) == (0, 15_000, "So?")
