"""Command handlers, buses, registry, middleware, telemetry."""

import logging
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.bus import CommandBus, QueryBus, shard_of
from tidelog.envelope import ANY, NO_STREAM, STREAM_EXISTS, Revision
from tidelog.errors import BusClosed, DuplicateHandler, HandlerFailed, HandlerNotFound, RevisionConflict, RuleViolation, StreamAlreadyExists, StreamNotFound
from tidelog.operators import fold
from tidelog.operators.decide import CommandHandler
from tidelog.plans.commit import LogStore
from tidelog.registry import EventRegistry, Router
from tidelog.sources.logs import in_memory
from tidelog.telemetry import Recorder, counters, logged, stamped, timed


@dataclass
class Add:
    aggregate_id: str
    n: int = 1


@dataclass
class Other:
    aggregate_id: str


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "log"))


def handler(store, decide=None, **options):
    return CommandHandler(store, lambda: 0, lambda s, e: s + 1, decide or (lambda s, c: [{"event_type": "Added", "payload": str(s + i)} for i in range(c.n)]), **options)


def test_versions_metadata_and_stream_name(store):
    store.append([{"stream_id": "t-a", "event_type": "Added"}])
    h = handler(store, stream_name=lambda c: f"t-{c.aggregate_id}", metadata=[lambda c: {"user": "u", "x": "1"}, lambda c: {"x": "2"}])
    assert h(Add("a", 2)).next_version == 3
    rows = store.read().load_stream("t-a").collect()
    assert [r["version"] for r in rows] == [1, 2, 3] and [r["payload"] for r in rows[1:]] == ["1", "2"]
    assert rows[1]["metadata"] == rows[2]["metadata"] == {"user": "u", "x": "2"}


def test_nothing_decided_is_a_success_without_a_commit(store):
    assert handler(store, lambda s, c: [])(Add("a")).successful
    assert store.last_commit() == 0


def test_rules_reject(store):
    def no(s, c):
        raise ValueError("no")

    with pytest.raises(RuleViolation, match="no") as e:
        handler(store, no)(Add("a"))
    assert isinstance(e.value.cause, ValueError)


def interfering(store, times):
    """A decision that another writer gets ahead of, so many times."""
    left = [times]

    def decide(state, command):
        if left[0]:
            left[0] -= 1
            store.append([{"stream_id": command.aggregate_id, "event_type": "Added"}])
        return [{"event_type": "Added", "payload": str(state)}]

    return decide


def test_conflicts_are_retried_against_what_was_committed(store):
    store.append([{"stream_id": "a", "event_type": "Added"}])
    assert handler(store, interfering(store, 2), retries=3, pause=0)(Add("a")).next_version == 4
    assert store.read().load_stream("a").collect()[-1]["payload"] == "3"
    with pytest.raises(RevisionConflict):
        handler(store, interfering(store, 2), retries=1, pause=0)(Add("a"))


def test_two_creators_do_not_both_win(store):
    with pytest.raises(RevisionConflict):
        handler(store, interfering(store, 1))(Add("new"))
    assert store.head("new") == 1


def test_what_the_caller_asserts_is_not_retried(store):
    store.append([{"stream_id": "a", "event_type": "Added"}])
    with pytest.raises(RevisionConflict):
        handler(store, expected=Revision(5), retries=5, pause=0)(Add("a"))
    with pytest.raises(StreamAlreadyExists):
        handler(store, expected=NO_STREAM, retries=5)(Add("a"))
    with pytest.raises(StreamNotFound):
        handler(store, expected=STREAM_EXISTS, retries=5)(Add("b"))
    assert handler(store, expected=Revision(1))(Add("a")).next_version == 2
    assert store.read().load_stream("a").collect()[-1]["payload"] == "1"  # folded from all events


def test_command_bus(store):
    bus = CommandBus(shards=3)
    bus.register(Add, handler(store))
    with pytest.raises(DuplicateHandler):
        bus.register(Add, handler(store))
    assert bus.dispatch(Add("a", 2)).next_version == 2
    with pytest.raises(HandlerNotFound):
        bus.dispatch(Other("a"))

    def broken(command):
        raise KeyError("x")

    bus.register(Other, broken)
    with pytest.raises(HandlerFailed):
        bus.dispatch(Other("a"))
    bus.stop()
    bus.stop()
    with pytest.raises(BusClosed):
        bus.dispatch(Add("a"))


def test_shards(spark):
    assert shard_of("abc", 3) == 2 and shard_of("xyz", 3) == 0 and shard_of("a", 0) == 0
    keys = ["abc", "xyz", "agg-1", "é", "", "日本"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fn.shard("k", 7).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: shard_of(k, 7) for k in keys}


def test_query_bus():
    bus = QueryBus()
    bus.register(Add, lambda q: q.n + 1, "int")
    with pytest.raises(DuplicateHandler):
        bus.register(Add, lambda q: 0, "int")
    bus.register(Add, lambda q: str(q.n), "str")
    assert bus.gateway(Add, "int")(Add("a", 4)) == 5 and bus.gateway(Add, "str")(Add("a", 4)) == "4"
    bus.validate()
    ask = bus.gateway(Other, "int")
    with pytest.raises(HandlerNotFound, match="Other"):
        bus.validate()
    with pytest.raises(HandlerNotFound):
        ask(Other("a"))


def test_middleware_order_and_baking_in():
    seen = []

    def layer(name):
        def wrap(h):
            def call(m):
                seen.append(name)
                return h(m)

            return call

        return wrap

    bus = QueryBus()
    bus.use(layer("first"), layer("second"))
    bus.register(Add, lambda q: seen.append("handler"), "x")
    bus.use(layer("late"))
    bus.register(Other, lambda q: None, "x")
    bus.gateway(Add, "x")(Add("a"))
    assert seen == ["first", "second", "handler"]
    seen.clear()
    bus.gateway(Other, "x")(Other("a"))
    assert seen == ["first", "second", "late"]


def test_telemetry(spark, caplog):
    records = Recorder()
    bus = QueryBus()
    bus.use(timed(records, "command", events=lambda n: n), logged(logging.getLogger("t"), "command"))

    def work(c):
        if c.n < 0:
            raise RevisionConflict("a", 1, 2)
        return c.n

    bus.register(Add, work, "n")
    ask = bus.gateway(Add, "n")
    with caplog.at_level(logging.INFO):
        ask(Add("a", 3))
        with pytest.raises(RevisionConflict):
            ask(Add("a", -1))
    assert "done" in caplog.text and "failed" in caplog.text
    table = records.table(spark)
    assert tuple(counters(table, "kind").first()) == ("command", 2, 1, 1, 3)
    assert table.agg(F.max("seconds")).first()[0] < 1
    assert stamped({"a": "1"}, causation_id="c", trace="") == {"a": "1", "causation_id": "c"}


def test_registry(spark):
    reg = EventRegistry()
    reg.register("Created", "id string, name string", aliases=("Made",))
    reg.alias("Created", "Begun")
    with pytest.raises(DuplicateHandler):
        reg.register("Made", "id string")
    with pytest.raises(ValueError):
        reg.register("", "id string")
    assert reg.names_for("Created", "Unknown") == ["Begun", "Created", "Made", "Unknown"]
    log = in_memory(spark, [{"event_id": str(i), "stream_id": "s", "version": i, "global_version": i, "event_type": t, "payload": p} for i, (t, p) in enumerate([("Made", '{"id":"1","name":"a"}'), ("Created", '{"id":"2"}')], 1)]).events
    assert [(r["id"], r["name"]) for r in reg.view(log, "Created").orderBy("version").collect()] == [("1", "a"), ("2", None)]
    assert {r["event_type"] for r in reg.check(log).collect()} == {"Created"}
    odd = log.withColumn("event_type", F.lit("Nobody"))
    with pytest.raises(Exception, match="Nobody"):
        reg.check(odd).collect()
    with pytest.raises(Exception, match="MALFORMED|[Mm]alformed|FAILFAST"):
        reg.view(log.withColumn("payload", F.lit("{broken")), "Created").collect()
    assert reg.view(log.withColumn("payload", F.lit("{broken")), "Created", strict=False).first()["id"] is None


def test_router(spark):
    reg = EventRegistry()
    reg.register("Created", "id string", aliases=("Made",))
    seen = {}
    router = Router(reg).on("Created", lambda df: seen.update(created=df.count())).on("Closed", lambda df: seen.update(closed=df.count()))
    with pytest.raises(DuplicateHandler):
        router.on("Created", print)
    assert router.stream_filter() == ["Closed", "Created", "Made"]
    router(in_memory(spark, [{"event_id": str(i), "stream_id": "s", "version": i, "global_version": i, "event_type": t, "payload": "{}"} for i, t in enumerate(["Made", "Created", "Closed", "Else"], 1)]).events)
    assert seen == {"created": 2, "closed": 1}


def test_names(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    for full, short in {"*a/b.Cart": "Cart", "m.Cart": "Cart", "Cart": "Cart", "*Cart": "Cart", "x.Snap[y.z.Cart]": "Snap[y.z.Cart]"}.items():
        assert pick(fn.type_name(F.lit(full))) == short
    assert pick(fn.file_version(F.lit("/a/0000000012-X.json"))) == 12
    assert pick(fn.file_version(F.lit("/a/00000000000000000007.json"))) == 7
    assert pick(fn.file_version(F.lit("/a/readme.txt"))) is None
    assert pick(fn.merge_metadata(F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("2")))) == {"a": "2"}
    assert pick(fn.causation_id(F.create_map(F.lit("a"), F.lit("1")))) == ""


def test_a_fold_of_a_prefix_goes_on_with_the_tail(spark):
    rows = [{"event_id": str(i), "stream_id": f"s{i % 3}", "version": 1 + i // 3, "global_version": i, "event_type": "ab"[i * 7 % 2]} for i in range(60)]
    log = in_memory(spark, rows).events
    initial = F.lit("")
    evolve = lambda s, e: F.concat(s, e["event_type"])
    whole = {tuple(r) for r in fold.fold_ordered(log, initial, evolve, ["event_type"]).collect()}
    for cut in (0, 7, 20):
        start = fold.fold_ordered(log.where(F.col("version") <= cut), initial, evolve, ["event_type"])
        assert {tuple(r) for r in fold.fold_ordered(log, initial, evolve, ["event_type"], snapshot=start).collect()} == whole
    by_code = fold.fold_python(log, lambda: "", lambda s, e: s + e["event_type"], lambda s: {"state": s}, "state string", ["event_type"])
    assert {(r["stream_id"], r["state"], r["version"]) for r in by_code.collect()} == whole


def test_any_is_default(store):
    assert handler(store).expected == ANY


def test_observed_store_counts_what_succeeded(spark, store):
    from tidelog.telemetry import ObservedStore

    records = Recorder()
    observed = ObservedStore(store, records, lambda: {"causation_id": "c-1", "trace": ""})
    observed.append([{"stream_id": "a", "event_type": "x", "metadata": {"user": "u"}}, {"stream_id": "a", "event_type": "y"}])
    with pytest.raises(RevisionConflict):
        observed.append([{"stream_id": "a", "event_type": "z"}], Revision(7))
    log = observed.read()
    assert [r["metadata"] for r in log.load_stream("a").collect()] == [{"user": "u", "causation_id": "c-1"}, {"causation_id": "c-1"}]
    rows = {r["operation"]: r for r in counters(records.table(spark), "operation").collect()}
    assert tuple(rows["append"])[1:] == (2, 1, 1, 2) and rows["load"]["calls"] == 1 and observed.head("a") == 2


def refuses_by_name(state, command):
    if state:
        raise RuleViolation("one is enough")
    return [{"event_type": "Made"}]


def refuses_by_import(state, command):
    from tidelog.errors import RuleViolation as Again

    if state:
        raise Again("one is enough")
    return [{"event_type": "Made"}]


def breaks(state, command):
    raise ValueError("odd")


@pytest.mark.parametrize("by_value", [False, True])
def test_rule_rejections_of_workers(spark, by_value):
    """Rejections are told by their mark, whether a worker has the library's classes by name or as copies."""
    import tidelog
    from pyspark import cloudpickle
    from tidelog.operators.decide import serial_decisions

    work = spark.createDataFrame([(s, i, i) for s in "abc" for i in range(10)] + [("hot", i, i) for i in range(200)], "stream_id string, seq long, command_id long")
    if by_value:
        cloudpickle.register_pickle_by_value(tidelog)
    try:
        for decide in (refuses_by_name, refuses_by_import):
            rows = serial_decisions(work, decide, lambda s, e: s + 1, lambda: 0, []).collect()
            assert len(rows) == 230 and {(r["command_id"], r["version"], r["kind"]) for r in rows if r["stream_id"] == "hot"} == {(i, None if i else 1, "rule" if i else None) for i in range(200)}
            assert sum(r["kind"] == "rule" for r in rows) == 226
        failed = serial_decisions(work, breaks, lambda s, e: s, lambda: 0, []).collect()
        assert len(failed) == 230 and {(r["kind"], r["message"]) for r in failed} == {("failed", "ValueError: odd")}
    finally:
        if by_value:
            cloudpickle.unregister_pickle_by_value(tidelog)


class Slow:
    """A bus of two shards whose first is held up until ``go`` is set."""

    def __init__(self, depth=1):
        import threading

        self.go, self.done, self.bus = threading.Event(), [], CommandBus(2, depth)
        self.bus.register(Add, self.handle)
        names = [f"a{i}" for i in range(50)]
        self.held, self.free = (next(n for n in names if shard_of(n, 2) == k) for k in (0, 1))

    def handle(self, command):
        if command.aggregate_id == self.held:
            assert self.go.wait(20)
        self.done.append(command.n)
        return command.n

    def start(self, n):
        import threading

        out = []

        def run():
            try:
                out.append(self.bus.dispatch(Add(self.held, n)))
            except Exception as e:  # noqa: BLE001
                out.append(e)

        thread = threading.Thread(target=run)
        thread.start()
        return thread, out


def test_a_full_shard_holds_up_its_own_callers_only():
    import time

    slow = Slow()
    waiting = [slow.start(i) for i in range(3)]  # one under way, one in the queue, one that waits for a place
    time.sleep(0.2)
    began = time.monotonic()
    assert slow.bus.dispatch(Add(slow.free, 7), timeout=5) == 7
    with pytest.raises(TimeoutError):
        slow.bus.dispatch(Add(slow.held, 8), timeout=0.2)  # the time covers the wait for a place
    assert time.monotonic() - began < 3
    given_up = time.monotonic() + 0.2
    from tidelog.errors import DispatchCancelled

    with pytest.raises(DispatchCancelled):
        slow.bus.dispatch(Add(slow.held, 9), cancelled=lambda: time.monotonic() > given_up)
    slow.go.set()
    for thread, _ in waiting:
        thread.join(10)
    assert sorted(out[0] for _, out in waiting) == [0, 1, 2] and set(slow.done) == {0, 1, 2, 7}
    slow.bus.stop()


def test_stop_tells_who_waits_for_a_place():
    import threading
    import time

    slow = Slow()
    waiting = [slow.start(i) for i in range(3)]
    time.sleep(0.2)
    stopping = threading.Thread(target=slow.bus.stop)
    stopping.start()
    time.sleep(0.2)
    with pytest.raises(BusClosed):
        slow.bus.dispatch(Add(slow.free))
    slow.go.set()
    stopping.join(10)
    for thread, _ in waiting:
        thread.join(10)
    results = [out[0] for _, out in waiting]
    assert sum(isinstance(r, BusClosed) for r in results) == 1 and len(slow.done) == 2  # what was taken is finished


def test_spans_follow_calls_and_events(spark):
    from tidelog.telemetry import attribute, current_trace, traced

    recorder, seen = Recorder(), []
    inner = traced(recorder, "store")(lambda m: seen.append(current_trace()))
    traced(recorder, "command")(inner)(Add("a"))
    traced(recorder, "event", parent=lambda m: m["traceparent"])(lambda m: None)({"traceparent": seen[0]})
    rows = {r["kind"]: r["labels"] for r in recorder.table(spark).collect()}
    assert rows["store"]["trace_id"] == rows["command"]["trace_id"] == rows["event"]["trace_id"]
    assert rows["store"]["parent_id"] == rows["command"]["span_id"] and rows["event"]["parent_id"] == rows["store"]["span_id"] and rows["command"]["parent_id"] == ""
    assert current_trace() == "" and attribute("event.id", "shop") == "shop.event.id"
    with pytest.raises(ValueError):
        attribute("event.ids")


def test_a_processor_turns_events_into_decided_commands(spark, tmp_path):
    from tidelog.streaming.subscribe import Subscriptions, processor

    store = LogStore(spark, str(tmp_path / "log"))
    store.append([{"stream_id": "order-1", "event_type": t} for t in ("Failed", "Paid", "Failed", "Failed")])
    bus = CommandBus(2)

    def at_most_two(state, command):
        if state >= 2:
            raise RuleViolation("two are enough")
        return [{"event_type": "Opened", "payload": str(command.n)}]

    bus.register(Add, CommandHandler(store, lambda: 0, lambda state, event: state + 1, at_most_two))
    calls = []
    subscriptions = Subscriptions(store)
    subscriptions.use(lambda handler: lambda rows, batch: (calls.append(batch), handler(rows, batch))[1])
    react = lambda event: [Add(f"case-{event['stream_id']}", event["global_version"])]
    subscriptions.run("cases", processor(react, bus.dispatch), types=("Failed",))
    bus.stop()
    made = store.read().load_stream("case-order-1").collect()
    assert [(r["event_type"], r["payload"]) for r in made] == [("Opened", "1"), ("Opened", "3")] and calls
    assert subscriptions.listening() == [] and subscriptions.errors() == {}


def test_memory_store(spark):
    from tidelog.errors import InvalidBatch, StoreClosed
    from tidelog.plans.commit import MemoryStore

    store = MemoryStore(spark)
    assert store.append([{"stream_id": "a", "event_type": "x"}, {"stream_id": "a", "event_type": "y"}], NO_STREAM).next_version == 2
    assert store.append([{"stream_id": "b", "event_type": "z", "metadata": {"k": "v"}}]).next_version == 1 and store.append([]).successful
    for state, error in ((NO_STREAM, StreamAlreadyExists), (Revision(1), RevisionConflict)):
        with pytest.raises(error):
            store.append([{"stream_id": "a", "event_type": "x"}], state)
    with pytest.raises(StreamNotFound):
        store.append([{"stream_id": "none", "event_type": "x"}], STREAM_EXISTS)
    with pytest.raises(InvalidBatch):
        store.append([{"stream_id": "a", "event_type": "x"}, {"stream_id": "b", "event_type": "x"}])
    rows = store.read().load_all().collect()
    assert [(r["stream_id"], r["version"], r["global_version"]) for r in rows] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)] and store.head("a") == 2 and store.position() == 3
    assert CommandHandler(store, lambda: 0, lambda s, e: s + 1, lambda s, c: [{"event_type": str(s)}])(Add("a")).next_version == 3
    store.close()
    with pytest.raises(StoreClosed):
        store.append([{"stream_id": "a", "event_type": "x"}])


def test_relational_tables(spark, tmp_path):
    from tidelog.sources.logs import from_jdbc, to_jdbc

    log = in_memory(spark, [{"event_id": f"e{i}", "stream_id": f"s{i % 3}", "aggregate_id": None, "version": i // 3 + 1, "global_version": i + 1, "event_type": "T", "payload": f'{{"i": {i}}}', "metadata": {"k": str(i)}} for i in range(20)])
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    to_jdbc(log, url)
    for options in ({}, {"partitions": 4, "upper": 20}):
        back = from_jdbc(spark, url, **options)
        key = lambda df: sorted((r["event_id"], r["stream_id"], r["version"], r["global_version"], r["event_type"], r["payload"], r["metadata"]["k"]) for r in df.collect())
        assert key(back.events) == key(log.events)
    assert [r["global_version"] for r in from_jdbc(spark, url).load_stream_from("s1", Revision(5)).collect()] == [17, 20]


def test_generators_end_and_fail(spark):
    from tidelog.sources.logs import generated

    rows = generated(spark, lambda i: ({"a": i, "b": str(k)} for k in range(i * 7)), 5, "a long, b string", batch=4).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted((i, str(k)) for i in range(5) for k in range(i * 7))

    def broken(i):
        yield {"a": i}
        raise RuntimeError("out of rows")

    with pytest.raises(Exception, match="out of rows"):
        generated(spark, broken, 2, "a long").collect()
