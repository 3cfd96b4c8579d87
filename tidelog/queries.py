"""Every operator of the log as a query over a folder of tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.envelope import STREAM_EXISTS, Revision
from tidelog.errors import RuleViolation
from tidelog.operators import decide, fold, windows
from tidelog.plans.scratch import keep, scratch_path
from tidelog.registry import EventRegistry
from tidelog.sources.logs import EventLog, envelope_defaults, generated
from tidelog.sources.tables import conversation_log, order_log, table, user_log
from tidelog.telemetry import counters, histogram, in_flight, trace_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_L = """WITH l AS (SELECT 'event-' || event_id AS event_id, 'user-' || user_id AS stream_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version,
event_id + 1 AS global_version, event_type, props AS payload, ts AS occurred_at, value FROM events) """


def query(sql: str | None, log: bool = True) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (_L if log else "") + sql
        return f

    return register


# scans, positions, filters


def _committed(spark: SparkSession, d: str) -> EventLog:
    """The user log in a store, sorted by stream and version, so that a stream's scan skips what other files hold."""
    from tidelog.plans.commit import LogStore

    store = LogStore(spark, scratch_path(spark, "store"))
    store.restore(user_log(spark, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")))
    return store.read()


@query("SELECT stream_id, version, global_version, event_type, occurred_at FROM l WHERE stream_id = 'user-3'")
def load_stream(spark: SparkSession, d: str) -> DataFrame:
    return _committed(spark, d).load_stream("user-3").select("stream_id", "version", "global_version", "event_type", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query("SELECT stream_id, version, global_version, event_type FROM l WHERE stream_id = 'user-3' AND version > 20")
def load_stream_from(spark: SparkSession, d: str) -> DataFrame:
    return _committed(spark, d).load_stream_from("user-3", Revision(20)).select("stream_id", "version", "global_version", "event_type")


@query("SELECT stream_id, version, global_version, event_type, value FROM l WHERE global_version > 300")
def load_from_all(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).load_all(Revision(300)).select("stream_id", "version", "global_version", "event_type", "value")


@query("SELECT stream_id, CASE WHEN 66 > max(version) THEN 'invalid_revision' WHEN 66 = max(version) THEN 'empty' ELSE 'rows' END AS outcome FROM l GROUP BY stream_id")
def load_beyond_head(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).outcomes(Revision(66))


@query("SELECT stream_id, max(version) AS head, count(*) AS events FROM l GROUP BY stream_id")
def stream_heads(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).heads()


@query("SELECT max(global_version) AS last_position, count(*) AS events FROM l")
def last_position(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).extent()


@query("SELECT global_version, stream_id, event_type FROM l WHERE global_version > 500 AND event_type IN ('purchase', 'signup') ORDER BY global_version LIMIT 100")
def poll_batch(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).poll(500, ["purchase", "signup"], 100).select("global_version", "stream_id", "event_type")


def registry() -> EventRegistry:
    """The types of the user log; ``click`` was called ``tap`` and ``view`` was called ``look`` before."""
    out = EventRegistry()
    out.register("click", "k long", ("tap",))
    out.register("view", "k long", ("look",))
    for name in ("error", "purchase", "signup"):
        out.register(name, "k long")
    return out


@query("SELECT CASE event_type WHEN 'tap' THEN 'click' ELSE event_type END AS event_type, count(*) AS events FROM (SELECT CASE WHEN event_type = 'click' AND version % 2 = 0 THEN 'tap' ELSE event_type END AS event_type FROM l) WHERE event_type IN ('click', 'tap', 'error') GROUP BY 1")
def type_filter_alias(spark: SparkSession, d: str) -> DataFrame:
    reg = registry()
    old = user_log(spark, d).withColumn("event_type", F.when((F.col("event_type") == "click") & (F.col("version") % 2 == 0), "tap").otherwise(F.col("event_type")))
    return reg.check(EventLog(old).of_types(reg.names_for("click", "error")).events).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT stream_id, count(*) AS events FROM l WHERE starts_with(stream_id, 'user-1') OR starts_with(stream_id, 'user-7') GROUP BY stream_id")
def stream_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).with_prefixes(["user-1", "user-7"]).events.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_type, count(*) AS events FROM l WHERE event_type <> 'error' GROUP BY event_type")
def system_event_skip(spark: SparkSession, d: str) -> DataFrame:
    marked = user_log(spark, d).withColumn("event_type", F.when(F.col("event_type") == "error", "$error").otherwise(F.col("event_type")))
    return EventLog(marked).without_system_events().events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


_ASKED = "SELECT DISTINCT 'user-' || (user_id * 2) AS stream_id FROM events"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.concat(F.lit("user-"), F.col("user_id") * 2).alias("stream_id")).distinct()


@query(f"SELECT stream_id FROM ({_ASKED}) WHERE stream_id IN (SELECT stream_id FROM l)")
def stream_exists(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).existing(_asked(spark, d))


@query(f"SELECT stream_id FROM ({_ASKED}) WHERE stream_id NOT IN (SELECT stream_id FROM l)")
def no_stream(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).missing(_asked(spark, d))


@query("SELECT event_id, stream_id, CAST(user_id AS VARCHAR) AS aggregate_id, version, global_version, event_type, payload, CAST(user_id AS VARCHAR) AS user_meta, occurred_at FROM l")
def envelope_log(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d).select("event_id", "stream_id", "aggregate_id", "version", "global_version", "event_type", "payload", F.element_at("metadata", "user").alias("user_meta"), "occurred_at")


@query("SELECT event_id, '' AS aggregate_id, CAST(0 AS BIGINT) AS version, global_version, CAST(0 AS INTEGER) AS entries FROM l")
def envelope_accessors(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the envelope that a row lacks have defined values."""
    bare = envelope_defaults(user_log(spark, d).select("event_id", "global_version", F.lit(None).cast("string").alias("aggregate_id")))
    return bare.select("event_id", "aggregate_id", "version", "global_version", F.size("metadata").alias("entries"))


@query("SELECT stream_id, version, event_type FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY version DESC) AS r FROM l) WHERE r <= 3")
def per_stream_topk(spark: SparkSession, d: str) -> DataFrame:
    return EventLog(user_log(spark, d)).top_per_stream(3).select("stream_id", "version", "event_type")


@query("SELECT 'conv-' || conv_id AS stream_id, turn + 1 AS version, role AS event_type, text AS payload FROM conversations", log=False)
def conversation_stream(spark: SparkSession, d: str) -> DataFrame:
    return conversation_log(spark, d)


@query(
    """WITH o AS (SELECT o_orderkey AS k, 'OrderCreated' AS event_type, 0 AS kind, 0 AS line, 0 AS part, 0 AS supp, 0.0::DOUBLE AS qty, o_totalprice AS price, o_orderdate AS occurred_at FROM orders UNION ALL
SELECT l_orderkey, 'ItemAdded', 1, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem)
SELECT 'order-' || k AS stream_id, CAST(row_number() OVER (PARTITION BY k ORDER BY kind, line, part, supp, qty, price, occurred_at) AS BIGINT) AS version, event_type, CAST(part AS BIGINT) AS part, qty, price, occurred_at FROM o""",
    log=False,
)
def order_stream(spark: SparkSession, d: str) -> DataFrame:
    return order_log(spark, d)


@query(
    """SELECT event_type, count(*) AS events, count(DISTINCT stream_id) AS streams FROM (SELECT stream_id, event_type FROM l WHERE global_version % 2 = 0 UNION ALL SELECT stream_id, event_type FROM l WHERE global_version % 2 = 1) GROUP BY event_type"""
)
def log_union(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    both = EventLog(log.where("global_version % 2 = 0")).union(EventLog(log.where("global_version % 2 = 1")))
    return both.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("stream_id").alias("streams"))


# folds


@query("SELECT stream_id, max(version) AS version, arg_max(event_type, version) AS last_type, arg_max(value, version) AS last_value, coalesce(bool_or(event_type = 'signup'), false) AS signed_up, count(*) FILTER (event_type = 'purchase') AS purchases FROM l GROUP BY stream_id")
def fold_last_write(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_aggregate(
        user_log(spark, d),
        last_type=fold.last("event_type"),
        last_value=fold.last("value"),
        signed_up=fold.ever(F.col("event_type") == "signup"),
        purchases=fold.count_of(F.col("event_type") == "purchase"),
    )


_MACHINE = "coalesce(arg_max(event_type = 'signup', version) FILTER (event_type IN ('signup', 'error')), false)"


def _machine() -> tuple:
    initial = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("open"))

    def evolve(state, event):  # noqa: ANN001, ANN202
        opened = F.when(event["event_type"] == "signup", True).when(event["event_type"] == "error", False).otherwise(state["open"])
        return F.struct((state["n"] + 1).alias("n"), opened.alias("open"))

    return initial, evolve


@query(f"SELECT stream_id, count(*) AS n, {_MACHINE} AS open FROM l GROUP BY stream_id")
def fold_machine(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_ordered(user_log(spark, d), *_machine(), ["event_type"]).select("stream_id", "state.n", "state.open")


@query(f"SELECT stream_id, count(*) AS n, {_MACHINE} AS open, max(version) AS version FROM l GROUP BY stream_id")
def snapshot_plus_tail(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    first = keep(fold.fold_ordered(log.where("version <= 30"), *_machine(), ["event_type"]), "snapshot")
    return fold.fold_ordered(log, *_machine(), ["event_type"], snapshot=first).select("stream_id", "state.n", "state.open", "version")


def _run_start() -> dict:
    return {"last": None, "runs": 0}


def _run_step(state: dict, event: dict) -> dict:
    return {"last": event["event_type"], "runs": state["runs"] + (event["event_type"] != state["last"])}


def _run_result(state: dict) -> dict:
    return {"runs": state["runs"]}


@query("SELECT stream_id, max(version) AS version, count(*) FILTER (before IS NULL OR before <> event_type) AS runs FROM (SELECT *, lag(event_type) OVER (PARTITION BY stream_id ORDER BY version) AS before FROM l) GROUP BY stream_id")
def fold_any_code(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_python(user_log(spark, d), _run_start, _run_step, _run_result, "runs long", ["event_type"])


@query("SELECT event_type, count(*) AS events, count(DISTINCT stream_id) AS streams, round(sum(value), 2) AS total FROM l GROUP BY event_type")
def fold_all_streams(spark: SparkSession, d: str) -> DataFrame:
    out = fold.fold_aggregate(user_log(spark, d), "event_type", events=F.count(F.lit(1)), streams=F.countDistinct("stream_id"), total=F.round(F.sum("value"), 2))
    return out.drop("version")


@query("SELECT stream_id, string_agg(event_type, ',' ORDER BY version) AS types FROM l GROUP BY stream_id")
def fold_list(spark: SparkSession, d: str) -> DataFrame:
    """Every event of a stream, in order; a row is as long as its stream."""
    ordered = F.array_sort(F.collect_list(F.struct("version", "event_type")))
    return user_log(spark, d).groupBy("stream_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("types"))


@query("SELECT s.stream_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT 'user-' || (user_id * 2) AS stream_id FROM events) s LEFT JOIN (SELECT stream_id, count(*) AS n FROM l GROUP BY stream_id) c USING (stream_id)")
def initial_state(spark: SparkSession, d: str) -> DataFrame:
    state = fold.fold_aggregate(user_log(spark, d), n=F.count(F.lit(1)))
    return fold.with_initial(state, _asked(spark, d), n=F.lit(0).cast("long")).select("stream_id", "n")


@query(
    """SELECT stream_id, version, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) OVER w, 2) AS spent, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors
FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY version ROWS UNBOUNDED PRECEDING)"""
)
def running_state(spark: SparkSession, d: str) -> DataFrame:
    spent = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(F.lit(0.0))
    errors = F.when(F.col("event_type") == "error", 1).otherwise(0)
    out = fold.running(user_log(spark, d), spent=lambda w: F.round(F.sum(spent).over(w), 2), errors=lambda w: F.sum(errors).over(w))
    return out.select("stream_id", "version", "spent", "errors")


@query("SELECT stream_id, max(version) AS version, arg_max(event_type, version) AS last_type FROM l WHERE occurred_at <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY stream_id")
def asof_state(spark: SparkSession, d: str) -> DataFrame:
    then = fold.as_of(user_log(spark, d), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return fold.fold_aggregate(then, last_type=fold.last("event_type"))


# payloads, names, hashes


@query("SELECT global_version, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM l")
def decode_payload(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d).select("global_version", fn.field("payload", "$.k", "long").alias("k"))


@query("SELECT stream_id, version, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k FROM l WHERE event_type = 'purchase'")
def decode_typed(spark: SparkSession, d: str) -> DataFrame:
    return registry().view(user_log(spark, d), "purchase").select("stream_id", "version", "k")


@query("SELECT global_version, '{\"event_type\":\"' || event_type || '\",\"version\":' || version || ',\"note\":null}' AS payload FROM l")
def encode_payload(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d).select("global_version", fn.encode("event_type", "version", F.lit(None).cast("string").alias("note")).alias("payload"))


@query(
    """SELECT DISTINCT stream_id, CAST(h % 8 AS BIGINT) AS shard FROM (SELECT stream_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(stream_id, ''), lambda x: ord(x)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT stream_id FROM l))"""
)
def shard_fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return user_log(spark, d).select("stream_id").distinct().select("stream_id", fn.shard("stream_id", 8).alias("shard"))


@query("SELECT global_version, event_type || '[a.b.C]' AS name FROM l")
def type_names(spark: SparkSession, d: str) -> DataFrame:
    """The name of every event of the log."""
    full = F.concat(F.lit("*pkg/path.v2."), F.col("event_type"), F.lit("[a.b.C]"))
    return user_log(spark, d).select("global_version", fn.type_name(full).alias("name"))


@query("SELECT global_version, lpad(CAST(version AS VARCHAR), 10, '0') || '-' || event_type || '.json' AS name, version AS parsed FROM l")
def sequence_names(spark: SparkSession, d: str) -> DataFrame:
    named = user_log(spark, d).withColumn("name", fn.padded_name("version", "event_type"))
    return named.select("global_version", "name", fn.file_version(F.concat(F.lit("/log/"), F.col("name"))).alias("parsed"))


@query("SELECT DISTINCT 'tenant-' || (user_id % 3) || '-' || user_id AS stream_id, user_id FROM events", log=False)
def stream_naming(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select(fn.stream_name(F.lit("tenant"), (F.col("user_id") % 3).cast("string"), F.col("user_id").cast("string")).alias("stream_id"), "user_id")


@query("SELECT stream_id, CASE max(version) % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN -2 ELSE max(version) END AS code FROM l GROUP BY stream_id")
def revision_codes(spark: SparkSession, d: str) -> DataFrame:
    heads = EventLog(user_log(spark, d)).heads()
    kind = F.when(F.col("head") % 4 == 0, "any").when(F.col("head") % 4 == 1, "no_stream").when(F.col("head") % 4 == 2, "stream_exists").otherwise("revision")
    return heads.select("stream_id", fn.revision_code(kind, "head").alias("code"))


@query("SELECT global_version, CAST(user_id AS VARCHAR) AS user_meta, CASE WHEN version % 2 = 0 THEN 'b' ELSE 'a' END AS source_meta, CAST(2 AS INTEGER) AS entries FROM l")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    one = F.create_map(F.lit("source"), F.lit("a"))
    two = F.when(F.col("version") % 2 == 0, F.create_map(F.lit("source"), F.lit("b")))
    merged = user_log(spark, d).withColumn("m", fn.merge_metadata("metadata", one, two))
    return merged.select("global_version", F.element_at("m", "user").alias("user_meta"), F.element_at("m", "source").alias("source_meta"), F.size("m").alias("entries"))


@query(
    """SELECT p.event_type AS cause, c.event_type AS effect, count(*) AS n FROM (SELECT *, lag(event_id) OVER (PARTITION BY stream_id ORDER BY version) AS causation_id FROM l) c JOIN l p ON p.event_id = c.causation_id GROUP BY 1, 2"""
)
def causation_join(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    before = F.coalesce(F.lag("event_id").over(Window.partitionBy("stream_id").orderBy("version")), F.lit(""))
    caused = log.withColumn("metadata", fn.with_causation("metadata", before))
    child = caused.select(fn.causation_id("metadata").alias("cause_id"), F.col("event_type").alias("effect")).where("cause_id != ''")
    parent = log.select(F.col("event_id").alias("cause_id"), F.col("event_type").alias("cause"))
    return child.join(parent, "cause_id").groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trace, event_id, global_version, first_value(event_id) OVER (PARTITION BY trace ORDER BY global_version) AS producer_id FROM (SELECT *, user_id || '/' || CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS trace FROM l WHERE event_type <> 'view')")
def trace_join(spark: SparkSession, d: str) -> DataFrame:
    """Events of one trace with the event that began it."""
    log = user_log(spark, d)
    trace = F.when(F.col("event_type") != "view", F.concat_ws("/", "aggregate_id", F.col("occurred_at").cast("date").cast("string"))).otherwise("")
    return trace_links(log.withColumn("metadata", fn.merge_metadata("metadata", F.create_map(F.lit("correlation_id"), trace))))


def _counted(partition: int) -> Iterator[dict]:
    for i in range(partition * 3):
        yield {"stream_id": f"gen-{partition}", "version": i + 1, "event_type": "Counted"}


@query("SELECT 'gen-' || p AS stream_id, CAST(unnest(range(1, p * 3 + 1)) AS BIGINT) AS version, 'Counted' AS event_type FROM range(8) t(p)", log=False)
def generated_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that a user's generator makes, partition by partition."""
    return generated(spark, _counted, 8, "stream_id string, version long, event_type string")


# commands

_COMMANDS = """, c AS (SELECT command_id, 'user-' || command_id AS stream_id, CASE command_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 60 ELSE -2 END AS expected
FROM (SELECT DISTINCT user_id AS command_id FROM events UNION SELECT DISTINCT user_id + 1000000 FROM events)),
j AS (SELECT c.*, coalesce(h.head, 0) AS head, coalesce(h.last_type, '') AS last_type FROM c LEFT JOIN (SELECT stream_id, max(version) AS head, arg_max(event_type, version) AS last_type FROM l GROUP BY stream_id) h USING (stream_id)),
k AS (SELECT *, CASE WHEN expected = 0 AND head > 0 THEN 'stream_exists' WHEN expected = -2 AND head = 0 THEN 'stream_not_found' WHEN expected > 0 AND expected <> head THEN 'conflict' WHEN last_type = 'error' THEN 'rule' END AS kind FROM j) """


def _commands(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("command_id")).distinct()
    both = users.union(users.select(F.col("command_id") + 1000000))
    part = F.col("command_id") % 4
    return both.select("command_id", F.concat(F.lit("user-"), F.col("command_id")).alias("stream_id"), F.when(part == 0, -1).when(part == 1, 0).when(part == 2, 60).otherwise(-2).cast("long").alias("expected"))


def _decided(spark: SparkSession, d: str) -> decide.Decisions:
    state = fold.fold_aggregate(user_log(spark, d), last_type=fold.last("event_type"))
    ready = decide.with_state(_commands(spark, d), state, last_type=F.lit(""))
    noted = F.struct(F.lit("Noted").alias("event_type"), fn.encode("head").alias("payload"))
    closed = F.struct(F.lit("Closed").alias("event_type"), fn.encode("head").alias("payload"))
    made = F.when(F.col("head") % 2 == 0, F.array(noted, closed)).otherwise(F.array(noted))
    return decide.decide_batch(ready, made, F.when(F.col("last_type") == "error", F.lit("the last event is an error")))


@query(
    _COMMANDS
    + """SELECT stream_id, command_id, head + 1 + p AS version, CASE p WHEN 0 THEN 'Noted' ELSE 'Closed' END AS event_type, '{"head":' || head || '}' AS payload
FROM k, (SELECT unnest([0, 1]) AS p) WHERE kind IS NULL AND (p = 0 OR head % 2 = 0)"""
)
def decide_batch(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).events.select("stream_id", "command_id", "version", "event_type", "payload")


@query(_COMMANDS + "SELECT command_id, stream_id, kind FROM k WHERE kind IS NOT NULL")
def decide_rejections(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).rejections.select("command_id", "stream_id", "kind")


def _at_most_five(state: int, command: dict) -> list[dict]:
    if state >= 5:
        raise RuleViolation("five are enough")
    return [{"event_type": "Clicked"}]


def _three_cases(state: int, command: dict) -> list[dict]:
    if state >= 3:
        raise RuleViolation("three open cases are enough")
    return [{"event_type": "Opened"}]


def _count_up(state: int, event: dict) -> int:
    return state + 1


def _zero() -> int:
    return 0


@query("SELECT stream_id, global_version AS command_id, CASE WHEN r <= 5 THEN r END AS version, CASE WHEN r > 5 THEN 'rule' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY global_version) AS r FROM l WHERE event_type = 'click')")
def decide_serial(spark: SparkSession, d: str) -> DataFrame:
    clicks = user_log(spark, d).where("event_type = 'click'").select("stream_id", F.col("global_version").alias("command_id"), F.col("global_version").alias("seq"))
    return decide.serial_decisions(clicks, _at_most_five, _count_up, _zero, []).select("stream_id", "command_id", "version", "kind")


@query("SELECT 'case-' || user_id AS stream_id, global_version AS command_id, CASE WHEN r <= 3 THEN r END AS version, CASE WHEN r > 3 THEN 'rule' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY global_version) AS r FROM l WHERE event_type = 'error')")
def process_events(spark: SparkSession, d: str) -> DataFrame:
    """A processor: each error event becomes a command on another stream, decided against the state of that stream."""
    errors = EventLog(user_log(spark, d)).of_types(["error"]).events
    name = fn.stream_name(F.lit("case"), "aggregate_id")
    commands = errors.select(name.alias("stream_id"), F.col("global_version").alias("command_id"), F.col("global_version").alias("seq"))
    return decide.serial_decisions(commands, _three_cases, _count_up, _zero, []).select("stream_id", "command_id", "version", "kind")


@query("SELECT stream_id, due_at FROM (SELECT stream_id, max(occurred_at) FILTER (event_type = 'signup') + INTERVAL 3 DAY AS due_at, bool_or(event_type = 'error' AND value > 90) AS over FROM l GROUP BY stream_id) WHERE NOT over AND due_at <= TIMESTAMP '2024-02-01 00:00:00'")
def delayed_actions(spark: SparkSession, d: str) -> DataFrame:
    from tidelog.streaming.projections import due

    log = user_log(spark, d).withColumn("event_type", F.when((F.col("event_type") == "error") & (F.col("value") > 90), "stop").otherwise(F.col("event_type")))
    return due(log, "signup", "stop", "3 days", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


# telemetry


@query("SELECT b AS le, count(*) FILTER (value <= b) AS n FROM l, (SELECT unnest([10.0, 50.0, 100.0]::DOUBLE[]) AS b) GROUP BY b UNION ALL SELECT NULL, count(value) FROM l")
def duration_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(user_log(spark, d), "value", (10.0, 50.0, 100.0))


def _records(spark: SparkSession, d: str) -> DataFrame:
    failed = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return user_log(spark, d).select(F.col("event_type").alias("kind"), failed.alias("result"), (F.col("event_type") == "error").alias("conflict"), F.col("version").alias("events"), F.col("global_version").cast("double").alias("started"), F.col("value").alias("seconds"))


@query("SELECT event_type AS kind, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') AS conflicts, CAST(sum(version) AS BIGINT) AS events FROM l GROUP BY 1")
def counters_by_label(spark: SparkSession, d: str) -> DataFrame:
    return counters(_records(spark, d), "kind")


@query(
    """SELECT kind, moment, step, CAST(sum(step) OVER (PARTITION BY kind ORDER BY moment, step DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM (SELECT event_type AS kind, CAST(global_version AS DOUBLE) AS moment, 1 AS step FROM l UNION ALL SELECT event_type, CAST(global_version AS DOUBLE) + value, -1 FROM l)"""
)
def in_flight_calls(spark: SparkSession, d: str) -> DataFrame:
    return in_flight(_records(spark, d), "kind")


# time windows and duplicates (beyond the log's own order)


@query("SELECT date_trunc('day', occurred_at) AS window_start, event_type, count(*) AS events FROM l GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(user_log(spark, d), "1 day", "event_type")


@query("SELECT s AS window_start, count(*) AS events FROM (SELECT unnest([date_trunc('hour', occurred_at), date_trunc('hour', occurred_at) - INTERVAL 1 HOUR]) AS s FROM l) GROUP BY s")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding(user_log(spark, d), "2 hours", "1 hour")


@query(
    """, s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY stream_id ORDER BY occurred_at) AS BIGINT) AS g FROM (SELECT *, CASE WHEN occurred_at >= lag(occurred_at) OVER (PARTITION BY stream_id ORDER BY occurred_at) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM l))
SELECT min(occurred_at) AS session_start, max(occurred_at) + INTERVAL 6 HOUR AS session_end, stream_id, count(*) AS events FROM s GROUP BY stream_id, g"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(user_log(spark, d), "6 hours")


@query("SELECT event_type, count(DISTINCT event_id) AS events FROM (SELECT * FROM l UNION ALL SELECT * FROM l WHERE version % 2 = 0) GROUP BY event_type")
def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    log = user_log(spark, d)
    return windows.once_each(log.unionByName(log.where("version % 2 = 0"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_type, date_trunc('day', occurred_at) AS day, count(*) AS events FROM l GROUP BY ROLLUP (1, 2)")
def type_day_rollup(spark: SparkSession, d: str) -> DataFrame:
    return windows.rollup(user_log(spark, d).withColumn("day", F.date_trunc("day", "occurred_at").cast("timestamp_ntz")), "event_type", "day")


# stores and streams


def _store(spark: SparkSession, d: str):  # noqa: ANN202
    """A store with the user log in two commits, split in the middle of all streams."""
    from tidelog.plans.commit import LogStore

    log = user_log(spark, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withColumn("__order", F.col("global_version"))
    store = LogStore(spark, scratch_path(spark, "store"))
    for part in (log.where("version <= 25"), log.where("version > 25")):
        store.append_all(part, ["__order"])
    return store


@query("SELECT stream_id, max(version) AS head, count(*) AS events, CAST(arg_max(event_type, version) AS VARCHAR) AS last_type FROM l GROUP BY stream_id")
def committed_log(spark: SparkSession, d: str) -> DataFrame:
    return fold.fold_aggregate(_store(spark, d).read().events, events=F.count(F.lit(1)), last_type=fold.last("event_type")).withColumnRenamed("version", "head")


@query("SELECT stream_id, version, event_type, payload FROM l WHERE stream_id = 'user-5'")
def committed_stream(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    store.compact()
    return store.read().load_stream_from("user-5", STREAM_EXISTS).select("stream_id", "version", "event_type", "payload")


@query("SELECT stream_id, max(version) AS version, arg_max(event_type, version) AS last_type FROM l WHERE event_type IN ('purchase', 'signup') GROUP BY stream_id")
def projection_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A cached read model kept by a filtered subscription, one commit a batch."""
    from tidelog.streaming.projections import Projection
    from tidelog.streaming.subscribe import Subscriptions

    store = _store(spark, d)
    model = Projection(spark, scratch_path(spark, "model"), "stream_id string, version long, last_type string")
    Subscriptions(store).run("last-types", lambda rows, batch: model.upsert(fold.fold_aggregate(rows, last_type=fold.last("event_type")), batch), types=("purchase", "signup"), commits_per_batch=1)
    return model.read()


def _spend(state: tuple, event: dict) -> tuple:
    return (state[0] + (event["event_type"] == "purchase"), state[1] or event["event_type"] == "signup")


def _spent(state: tuple) -> dict:
    return {"purchases": int(state[0]), "signed_up": bool(state[1])}


@query("SELECT stream_id, max(version) AS version, count(*) FILTER (event_type = 'purchase') AS purchases, bool_or(event_type = 'signup') AS signed_up FROM l GROUP BY stream_id")
def stateful_projection(spark: SparkSession, d: str) -> DataFrame:
    """A read model folded in the state store of a stream, event file by event file."""
    from tidelog.streaming.projections import Projection, rocks_state, stateful

    source = scratch_path(spark, "events")
    log = user_log(spark, d).select("stream_id", "version", "event_type")
    for part in ("version <= 25", "version > 25"):  # each in so many files as a trigger takes
        log.where(part).repartition(4, "stream_id").write.mode("append").parquet(source)
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(source)
    model = Projection(spark, scratch_path(spark, "model"), "stream_id string, version long, purchases long, signed_up boolean")
    folded = stateful(events, "stream_id", "purchases long, signed_up boolean", "purchases long, signed_up boolean", (0, False), _spend, _spent)
    with rocks_state(spark):
        stream = folded.writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "checkpoint")).foreachBatch(lambda rows, batch: model.upsert(rows, batch)).trigger(availableNow=True).start()
        stream.awaitTermination()
    return model.read()


@query("""SELECT stream_id, moment + INTERVAL 3 DAY AS due_at FROM (SELECT stream_id, event_type, occurred_at AS moment, lead(occurred_at) OVER (PARTITION BY stream_id ORDER BY version) AS following
FROM l WHERE event_type IN ('signup', 'error')) WHERE event_type = 'signup' AND (following IS NULL OR following >= moment + INTERVAL 3 DAY) AND moment + INTERVAL 3 DAY <= (SELECT max(occurred_at) FROM l)""")
def delayed_timers(spark: SparkSession, d: str) -> DataFrame:
    """Delayed actions by timers of a running stream: a signup is followed up after three days without an error or another signup."""
    from datetime import timedelta

    from tidelog.streaming.projections import delayed, rocks_state

    source, sink = scratch_path(spark, "events"), scratch_path(spark, "actions")
    log = user_log(spark, d).select("stream_id", "version", "event_type", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    log.repartition(4, "stream_id").write.parquet(source)
    events = spark.readStream.schema(log.schema).parquet(source)
    with rocks_state(spark):
        stream = delayed(events, "signup", "error", timedelta(days=3)).writeStream.outputMode("append").format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint")).option("path", sink).trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.schema("stream_id string, due_at timestamp").parquet(sink).select("stream_id", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


@query("SELECT name, count(*) AS events FROM l JOIN (SELECT 'all' AS name, NULL AS kind UNION ALL SELECT 'errors', 'error' UNION ALL SELECT 'sales', 'purchase') s ON s.kind IS NULL OR s.kind = l.event_type GROUP BY name")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Each event to every subscription whose types it matches; no types are all."""
    from tidelog.streaming.subscribe import Subscription, fan_out as dealt

    wanted = {"all": (), "errors": ("error",), "sales": ("purchase",)}
    subscriptions = [Subscription(name, lambda rows, batch: None, types=kinds) for name, kinds in wanted.items()]
    return dealt(user_log(spark, d), subscriptions).groupBy("name").agg(F.count(F.lit(1)).alias("events"))


def _halves(spark: SparkSession, d: str):  # noqa: ANN202
    """An empty store, and the user log in two parts that cut every stream."""
    from tidelog.plans.commit import LogStore

    log = user_log(spark, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withColumn("__order", F.col("global_version"))
    return LogStore(spark, scratch_path(spark, "store")), (log.where("version <= 25"), log.where("version > 25"))


@query("SELECT event_type AS kind, count(*) AS n, min(version) AS low, max(version) AS high FROM l GROUP BY 1 UNION ALL SELECT 'unreadable', 2, NULL, NULL")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A log written as JSON lines and read again, beside two lines that are none: these are shown, not skipped."""
    from tidelog.sources.logs import from_json, to_json

    path = scratch_path(spark, "lines")
    to_json(EventLog(user_log(spark, d).drop("value")), path)
    spark.createDataFrame([("{broken",), ('{"no": "event"}',)], "value string").write.mode("append").text(path)
    log, bad = from_json(spark, path)
    good = log.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("version").alias("low"), F.max("version").alias("high"))
    none = F.lit(None).cast("long")
    return good.unionByName(bad.agg(F.lit("unreadable").alias("kind"), F.count(F.lit(1)).alias("n"), none.alias("low"), none.alias("high")))


@query("SELECT 1 AS run, count(*) AS events, min(version) AS low, max(version) AS high FROM l WHERE version <= 25 UNION ALL SELECT 2, count(*), min(version), max(version) FROM l WHERE version > 25")
def resumed_subscription(spark: SparkSession, d: str) -> DataFrame:
    """A subscription that ran before goes on where it was: the second run gets what came since, and nothing twice."""
    from tidelog.streaming.subscribe import Subscriptions

    store, parts = _halves(spark, d)
    path = scratch_path(spark, "delivered")
    for run, part in enumerate(parts, 1):
        store.append_all(part, ["__order"])
        Subscriptions(store).run("reader", lambda rows, batch, run=run: rows.select(F.lit(run).alias("run"), "version").write.mode("append").parquet(path))
    got = spark.read.schema("run int, version long").parquet(path)
    return got.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.min("version").alias("low"), F.max("version").alias("high"))


@query("SELECT 'handled' AS way, event_type, count(*) AS events FROM l WHERE version <= 25 GROUP BY event_type UNION ALL SELECT 'dead letter', event_type, count(*) FROM l WHERE version > 25 GROUP BY event_type")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Batches that a handler fails on go to a table with the error, and the subscription goes on."""
    from tidelog.streaming.subscribe import Subscriptions

    store, parts = _halves(spark, d)
    for part in parts:
        store.append_all(part, ["__order"])
    path, dead = scratch_path(spark, "handled"), scratch_path(spark, "dead")

    def handler(rows: DataFrame, batch: int) -> None:
        if batch:
            raise ValueError("not this one")
        rows.write.mode("overwrite").parquet(path)

    Subscriptions(store).run("careful", handler, commits_per_batch=1, dead_letters=dead)
    both = spark.read.parquet(path).select(F.lit("handled").alias("way"), "event_type").unionByName(spark.read.parquet(dead).where("error = 'not this one'").select(F.lit("dead letter").alias("way"), "event_type"))
    return both.groupBy("way", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(payload, '$.k') AS BIGINT)) AS BIGINT) AS k FROM l WHERE event_type IN ('purchase', 'signup') GROUP BY 1")
def routed_types(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows to the handler of their type; the subscription reads the types that have one."""
    from tidelog.registry import Router
    from tidelog.streaming.subscribe import Subscriptions

    store, parts = _halves(spark, d)
    store.append_all(parts[0].unionByName(parts[1]), ["__order"])
    path, router = scratch_path(spark, "routed"), Router(registry())
    for name in ("purchase", "signup"):
        router.on(name, lambda rows, name=name: rows.agg(F.lit(name).alias("event_type"), F.count(F.lit(1)).alias("events"), F.sum("k").alias("k")).write.mode("append").parquet(path))
    Subscriptions(store).run("router", router, types=router.stream_filter())
    return spark.read.parquet(path)


@query("SELECT CASE WHEN version <= 25 THEN 0 ELSE 1 END AS batch, event_type, count(*) AS events FROM l GROUP BY 1, 2")
def drained_spool(spark: SparkSession, d: str) -> DataFrame:
    """Batches left as files by a subscription, handled by another program and deleted."""
    from tidelog.streaming.subscribe import Subscriptions, drain_spool, spooled

    store, parts = _halves(spark, d)
    for part in parts:
        store.append_all(part, ["__order"])
    path, out = scratch_path(spark, "spool"), scratch_path(spark, "drained")
    Subscriptions(store).run("spool", spooled(path), commits_per_batch=1)
    drain_spool(spark, path, lambda rows, batch: rows.select(F.lit(batch).alias("batch"), "event_type").write.mode("append").parquet(out))
    return spark.read.parquet(out).groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT stream_id, version, event_type FROM l WHERE event_type = 'error' AND global_version > 100")
def log_source(spark: SparkSession, d: str) -> DataFrame:
    """The log as a source of a stream, with filters that reach its files."""
    from tidelog.streaming.source import register

    register(spark)
    store, parts = _halves(spark, d)
    store.restore(parts[0].unionByName(parts[1]))
    sink = scratch_path(spark, "sink")
    rows = spark.readStream.format("tidelog").option("path", store.path).option("types", "error").option("after", "100").load()
    stream = rows.select("stream_id", "version", "event_type").writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint")).option("path", sink).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("stream_id string, version long, event_type string").parquet(sink)


@query(
    """SELECT * FROM (VALUES ('any', 'new', 'written'), ('no_stream', 'new', 'written'), ('stream_exists', 'new', 'StreamNotFound'), ('revision 2', 'new', 'RevisionConflict'), ('unknown', 'new', 'InvalidRevision'),
('any', 'old', 'written'), ('no_stream', 'old', 'StreamAlreadyExists'), ('stream_exists', 'old', 'written'), ('revision 2', 'old', 'written'), ('unknown', 'old', 'InvalidRevision')) t(expected, stream, outcome)""",
    log=False,
)
def append_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What an append to a stream with two events, or with none, gives for each expectation."""
    from tidelog.envelope import ANY, NO_STREAM, StreamState
    from tidelog.errors import LogError
    from tidelog.plans.commit import MemoryStore

    states, out = {"any": ANY, "no_stream": NO_STREAM, "stream_exists": STREAM_EXISTS, "revision 2": Revision(2), "unknown": StreamState(-9)}, []
    for name, state in states.items():
        store = MemoryStore(spark)
        store.append([{"stream_id": "old", "event_type": "E"}] * 2)
        for stream in ("new", "old"):
            try:
                store.append([{"stream_id": stream, "event_type": "E"}], state)
                out.append((name, stream, "written"))
            except LogError as e:
                out.append((name, stream, type(e).__name__))
    return spark.createDataFrame(out, "expected string, stream string, outcome string")
