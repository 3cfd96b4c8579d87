"""Appends, loads and expectations."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.envelope import ANY, NO_STREAM, STREAM_EXISTS, Revision
from tidelog.errors import InvalidBatch, InvalidRevision, RevisionConflict, StoreClosed, StreamAlreadyExists, StreamNotFound
from tidelog.plans.commit import CommitRefused, LogStore, Manifest
from tidelog.sources.logs import EventLog, in_memory


def events(stream, *types):
    return [{"stream_id": stream, "event_type": t, "payload": f'{{"i": {i}}}'} for i, t in enumerate(types)]


@pytest.fixture
def store(spark, tmp_path):
    with LogStore(spark, str(tmp_path / "log")) as out:
        yield out


def types(rows):
    return [r["event_type"] for r in rows.collect()]


def test_empty_batch_succeeds_and_writes_nothing(store):
    result = store.append([], ANY)
    assert (result.successful, result.next_version, store.last_commit()) == (True, 0, 0)


def test_next_version_counts_the_batch(store):
    assert store.append(events("a", "x", "y", "z")).next_version == 3
    assert store.append(events("a", "x")).next_version == 4
    assert [r["version"] for r in store.read().load_stream("a").collect()] == [1, 2, 3, 4]


def test_mixed_streams_are_rejected_whole(store):
    with pytest.raises(InvalidBatch):
        store.append(events("a", "x") + events("b", "y"))
    assert store.last_commit() == 0


def test_expectations(store):
    with pytest.raises(StreamNotFound):
        store.append(events("a", "x"), STREAM_EXISTS)
    with pytest.raises(RevisionConflict):
        store.append(events("a", "x"), Revision(1))
    assert store.append(events("a", "x"), NO_STREAM).next_version == 1
    with pytest.raises(StreamAlreadyExists):
        store.append(events("a", "x"), NO_STREAM)
    assert store.append(events("a", "y"), STREAM_EXISTS).next_version == 2
    assert store.append(events("a", "z"), Revision(2)).next_version == 3
    with pytest.raises(RevisionConflict) as e:
        store.append(events("a", "z"), Revision(2))
    assert (e.value.stream, e.value.expected, e.value.actual) == ("a", 2, 3)


def test_load_after_a_revision(store):
    store.append(events("a", "created", "item-1", "item-2", "item-3", "shipped"))
    log = store.read()
    assert types(log.load_stream_from("a", Revision(2))) == ["item-2", "item-3", "shipped"]
    assert types(log.load_stream_from("a", Revision(5))) == []
    with pytest.raises(InvalidRevision):
        log.load_stream_from("a", Revision(6))
    with pytest.raises(InvalidRevision):
        log.load_all(Revision(6))
    assert types(log.load_all(Revision(5))) == []


def test_streams_that_never_were(store):
    log = store.read()
    assert types(log.load_stream_from("a", ANY)) == []
    assert types(log.load_stream_from("a", NO_STREAM)) == []
    with pytest.raises(StreamNotFound):
        log.load_stream("a")
    store.append(events("a", "x"))
    with pytest.raises(StreamAlreadyExists):
        store.read().load_stream_from("a", NO_STREAM)


def test_global_order_of_interleaved_appends(store):
    for s in "aba":
        store.append(events(s, f"of-{s}"))
    assert types(store.read().load_all()) == ["of-a", "of-b", "of-a"]
    assert [r["global_version"] for r in store.read().load_all().collect()] == [1, 2, 3]


def test_a_stream_may_be_named_all(store):
    store.append(events("all", "x"))
    store.append(events("other", "y"))
    assert types(store.read().load_stream("all")) == ["x"]


def test_a_new_store_goes_on_where_the_old_one_ended(spark, store):
    store.append(events("a", "x", "y"))
    again = LogStore(spark, store.path)
    assert again.append(events("b", "z")).next_version == 1
    assert [r["global_version"] for r in again.read().load_all().collect()] == [1, 2, 3]
    assert again.head("a") == 2


def test_files_without_a_manifest_are_invisible(store):
    store.append(events("a", "x"))
    store._write(in_memory(store.spark, [{"event_id": "e", "stream_id": "a", "version": 2, "global_version": 2, "event_type": "lost"}]).events)
    assert types(store.read().load_all()) == ["x"]


def test_a_manifest_number_is_taken_once(store):
    store.append(events("a", "x"))
    with pytest.raises(CommitRefused):
        store._publish(Manifest(1, [], 0, 0))
    store.append(events("b", "y"))
    assert store.read().last_position() == 2


def test_reading_as_of_a_commit(store):
    store.append(events("a", "x"))
    store.append(events("a", "y"))
    assert types(store.read(upto=1).load_all()) == ["x"]
    assert types(store.read(after=1).load_all()) == ["y"]


def test_concurrent_writers_lose_nothing(spark, store):
    failures = []

    def write(i):
        try:
            own = LogStore(spark, store.path)
            for j in range(3):
                own.append(events(f"s{i}", f"t{j}"))
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    rows = store.read().load_all().collect()
    assert [r["global_version"] for r in rows] == list(range(1, 13))
    for i in range(4):
        assert [(r["version"], r["event_type"]) for r in rows if r["stream_id"] == f"s{i}"] == [(1, "t0"), (2, "t1"), (3, "t2")]


def test_bulk_append_numbers_every_stream(spark, store):
    store.append(events("s1", "old"))
    rows = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 3).alias("stream_id"), F.lit("new").alias("event_type"), F.col("id").cast("string").alias("payload"), F.col("id").alias("at"))
    store.append_all(rows, ["at"])
    log = store.read().load_all().collect()
    assert [r["global_version"] for r in log] == list(range(1, 42))
    for s in ("s0", "s1", "s2"):
        assert [r["version"] for r in log if r["stream_id"] == s] == list(range(1, 1 + sum(r["stream_id"] == s for r in log)))
    assert [int(r["payload"]) for r in log if r["event_type"] == "new"] == list(range(40))
    wrong = spark.createDataFrame([("s1", 3)], "stream_id string, expected long")
    with pytest.raises(RevisionConflict):
        store.append_all(rows, ["at"], wrong)
    assert store.last_commit() == 2


def test_compaction_keeps_the_log(store):
    for s in "abc":
        store.append(events(s, "x", "y"))
    before = [tuple(r) for r in store.read().load_all().select("stream_id", "version", "global_version").collect()]
    store.compact()
    assert [tuple(r) for r in store.read().load_all().select("stream_id", "version", "global_version").collect()] == before
    assert store.append(events("a", "z"), Revision(2)).next_version == 3
    assert store.read().last_position() == 7


def test_closed_store_refuses(store):
    store.close()
    store.close()
    with pytest.raises(StoreClosed):
        store.append(events("a", "x"))
    with pytest.raises(StoreClosed):
        store.read()


def test_defaults_are_filled_in(store):
    store.append([{"stream_id": "a", "event_type": "x", "metadata": {"user": "u"}}, {"stream_id": "a", "event_type": "y"}])
    one, two = store.read().load_stream("a").collect()
    assert one["metadata"] == {"user": "u"} and two["metadata"] == {}
    assert len(one["event_id"]) == 36 and one["event_id"] != two["event_id"] and one["occurred_at"] is not None


def test_filters(spark):
    log = in_memory(spark, [{"event_id": str(i), "stream_id": s, "version": 1, "global_version": i, "event_type": t} for i, (s, t) in enumerate([("ab-1", "x"), ("b-1", "$sys"), ("ab-2", "y")], 1)])
    assert types(log.of_types([]).events) == ["x", "$sys", "y"]
    assert types(log.with_prefixes([]).events) == ["x", "$sys", "y"]
    assert types(log.with_prefixes(["ab", "zz"]).events) == ["x", "y"]
    assert types(log.without_system_events().events) == ["x", "y"]
    assert log.exists("b-1") and not log.exists("b-2")
    assert [r["event_type"] for r in log.iterate()] == ["x", "$sys", "y"]


def test_json_export_and_import(spark, tmp_path, store):
    from tidelog.sources.logs import from_json, to_json

    store.append(events("a", "x", "y"))
    to_json(store.read(), str(tmp_path / "out"))
    (tmp_path / "out" / "broken.json").write_text("{not json\n")
    log, bad = from_json(spark, str(tmp_path / "out"))
    assert types(log.load_stream("a")) == ["x", "y"]
    assert bad.count() == 1


def test_filters_reach_the_scan(store):
    store.append(events("a", "x"))
    plan = store.read().events.where("stream_id = 'a' and version > 0").select("event_type")._jdf.queryExecution().toString()
    assert "EqualTo(stream_id,a)" in plan and "GreaterThan(version,0)" in plan
    assert "payload" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_union_is_one_log(spark):
    rows = [{"event_id": str(i), "stream_id": "s", "version": i, "global_version": i, "event_type": "x"} for i in (1, 2)]
    both = EventLog(in_memory(spark, rows[:1]).events).union(in_memory(spark, rows[1:]))
    assert both.last_position() == 2


def many(spark, n, events=2, first="s"):
    return spark.createDataFrame([(f"{first}{i}", "E", str(k), i * 100 + k) for i in range(n) for k in range(events)], "stream_id string, event_type string, payload string, o long")


def test_failures_of_a_bulk_append_have_their_own_kinds(spark, tmp_path):
    from tidelog.errors import InvalidRevision, RevisionConflict, StreamAlreadyExists, StreamNotFound

    with LogStore(spark, str(tmp_path / "s")) as store:
        store.append_all(many(spark, 3), ["o"])
        expect = lambda rows: spark.createDataFrame(rows, "stream_id string, expected long")
        for rows, error in (([("s0", 0)], StreamAlreadyExists), ([("new", -2)], StreamNotFound), ([("s1", 7)], RevisionConflict), ([("s1", -9)], InvalidRevision), ([("new", 3)], RevisionConflict)):
            with pytest.raises(error):
                store.append_all(many(spark, 3), ["o"], expect(rows))
        assert store.last_commit() == 1
        store.append_all(many(spark, 3), ["o"], expect([("s0", 2), ("s1", -2), ("s2", -1), ("other", 0)]))
        assert {r["head"] for r in store.heads().collect()} == {4} and store.position() == 12


def test_an_append_reads_heads_and_no_events(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LogStore, "LISTED_HEADS", 4)
    monkeypatch.setattr(LogStore, "DELTAS", 3)
    store = LogStore(spark, str(tmp_path / "s"))
    wanted = {}
    for i in range(8):
        rows = many(spark, 5 + i, 1 + i % 2) if i % 3 else many(spark, 2, 3, "few")
        store.append_all(rows, ["o"])
        for r in rows.collect():
            wanted[r["stream_id"]] = wanted.get(r["stream_id"], 0) + 1
    files = store.heads().inputFiles()
    assert files and all("/heads/" in f for f in files)
    monkeypatch.setattr(store, "read", None)  # whoever reads events fails
    store.append_all(many(spark, 20), ["o"])
    for i in range(20):
        wanted[f"s{i}"] = wanted.get(f"s{i}", 0) + 2
    monkeypatch.undo()
    again = LogStore(spark, str(tmp_path / "s"))
    assert {r["stream_id"]: r["head"] for r in again.heads().collect()} == wanted
    assert {r["stream_id"]: r["head"] for r in again.read().heads().collect()} == wanted
    assert all(again.head(s) == n for s, n in list(wanted.items())[:6]) and again.head("none") == 0
    assert any(m.all_heads for m in again.manifests())
    again.compact()
    assert again.head("s3") == wanted["s3"] and LogStore(spark, str(tmp_path / "s")).head("few0") == wanted["few0"]
    numbers = [r["global_version"] for r in again.read().load_all().collect()]
    assert numbers == list(range(1, sum(wanted.values()) + 1))


def test_long_logs_are_opened_by_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LogStore, "CHUNK", 3)
    store = LogStore(spark, str(tmp_path / "s"))
    for i in range(7):
        store.append([{"stream_id": f"a{i % 2}", "event_type": "E", "payload": str(i)}])
    opened = []
    fresh = LogStore(spark, str(tmp_path / "s"))
    text = fresh._text
    monkeypatch.setattr(fresh, "_text", lambda name: opened.append(name) or text(name))
    assert [m.number for m in fresh.manifests()] == list(range(1, 8)) and fresh.manifests() == store.manifests()
    assert sum("/manifests/" in name for name in opened) <= 4 and fresh.head("a0") == 4


def test_restore_and_what_reaches_the_scan(spark, tmp_path):
    store, copy = LogStore(spark, str(tmp_path / "s")), LogStore(spark, str(tmp_path / "t"))
    store.append_all(many(spark, 30, 3), ["o"])
    copy.restore(store.read().events)
    rows = lambda s: sorted(tuple(r)[:8] for r in s.read().events.drop("metadata").collect())
    assert rows(copy) == rows(store) and copy.head("s7") == 3 and copy.position() == 90
    plan = copy.read().load_stream_from("s7", Revision(1))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(stream_id,s7)" in pushed and "GreaterThan(version,1)" in pushed
    copy.append([{"stream_id": "s7", "event_type": "E", "payload": ""}], Revision(3))
    assert copy.head("s7") == 4
    with pytest.raises(Exception, match="not empty"):
        copy.restore(store.read().events)


def test_retrying(spark, tmp_path):
    from tidelog.envelope import AppendResult
    from tidelog.errors import RevisionConflict

    store, left = LogStore(spark, str(tmp_path / "s")), [2]

    def attempt():
        if left[0]:
            left[0] -= 1
            raise RevisionConflict("s", 1, 2)
        return AppendResult(True, "s", 1)

    assert store.retrying(attempt, retries=2, pause=0.01).successful
    left[0] = 3
    with pytest.raises(RevisionConflict):
        store.retrying(attempt, retries=1, pause=0.01)
