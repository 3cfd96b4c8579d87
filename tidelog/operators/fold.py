"""Folds: events of a stream, in order, into one state.

Four forms, cheapest first. Use the first that is right:

- ``fold_aggregate``: the state does not depend on order, or is the last value of something: partial aggregates.
- ``fold_ordered``: a fold written with column expressions over the ordered events of a stream (one array a stream).
- ``fold_python``: any Python function; a stream's events pass one task through Arrow.
- ``running``: the state after every event, as window aggregates.

Streams without events have no row; ``with_initial`` adds their initial state. A fold of a prefix continues with the tail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def last(column: Column | str, when: Column | None = None) -> Column:
    """The latest value in stream order, of events that satisfy ``when``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.max_by(column, F.col("version") if when is None else F.when(when, F.col("version")))


def ever(condition: Column) -> Column:
    """Whether any event satisfies it."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def count_of(condition: Column) -> Column:
    return F.count_if(condition)


def fold_aggregate(log: DataFrame, by: str | list[str] = "stream_id", **state: Column) -> DataFrame:
    """State columns as aggregates, with the version that the state is as of."""
    keys = [by] if isinstance(by, str) else by
    return log.groupBy(*keys).agg(F.max("version").alias("version"), *(c.alias(n) for n, c in state.items()))


def fold_ordered(log: DataFrame, initial: Column, evolve: Callable[[Column, Column], Column], columns: list[str], by: str = "stream_id", name: str = "state", snapshot: DataFrame | None = None) -> DataFrame:
    """``evolve(state, event)`` in version order; ``event`` has version and ``columns``.

    ``initial`` must have the type of the result. With ``snapshot`` (by, state, version) each stream goes on from its
    snapshot and only later events are read.
    """
    if snapshot is not None:
        known = snapshot.select(F.col(by).alias("__s"), F.col(name).alias("__state"), F.col("version").alias("__at"))
        log = log.join(known, F.col(by) == F.col("__s"), "left").where(F.col("__at").isNull() | (F.col("version") > F.col("__at")))
    events = F.array_sort(F.collect_list(F.struct("version", *columns)))
    if snapshot is None:
        return log.groupBy(by).agg(F.max("version").alias("version"), events.alias("__e")).select(by, F.aggregate("__e", initial, evolve).alias(name), "version")
    tail = log.groupBy(by).agg(F.max("version").alias("__last"), events.alias("__e"), F.first("__state", ignorenulls=True).alias("__from"))
    moved = tail.select(by, F.aggregate("__e", F.coalesce("__from", initial), evolve).alias(name), F.col("__last").alias("version"))
    still = snapshot.join(moved, by, "left_anti").select(by, name, "version")
    return moved.unionByName(still)


def fold_python(log: DataFrame, initial: Callable[[], Any], evolve: Callable[[Any, dict], Any], result: Callable[[Any], dict], schema: str, columns: list[str], by: str = "stream_id") -> DataFrame:
    """Any fold: ``evolve(state, event)`` on dicts. ``schema`` describes ``result(state)``; ``by`` and version are added."""

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = initial()
        ordered = pdf.sort_values("version")
        for event in ordered.to_dict("records"):
            state = evolve(state, event)
        return pd.DataFrame([{by: key[0], "version": int(ordered["version"].iloc[-1]), **result(state)}])

    kind = log.schema[by].dataType.simpleString()
    return log.select(by, "version", *columns).groupBy(by).applyInPandas(whole, f"{by} {kind}, version long, {schema}")


def fold_stream_rows(rows: Iterator[Any], initial: Any, evolve: Callable[[Any, Any], Any]) -> Any:
    """The fold of one stream at the driver, as a command handler needs it."""
    state = initial
    for row in rows:
        state = evolve(state, row)
    return state


def with_initial(state: DataFrame, streams: DataFrame, by: str = "stream_id", **initial: Column) -> DataFrame:
    """One row for each of ``streams``: its state, or the initial one where it has no events."""
    out = streams.select(by).distinct().join(state, by, "left")
    fill = {"version": F.lit(0).cast("long"), **initial}
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items() if c in out.columns})


def running(log: DataFrame, by: str = "stream_id", order: str = "version", **state: Callable[[Window], Column]) -> DataFrame:
    """Every event with the state after it; each state is a function of the window up to the event."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumns({n: f(upto) for n, f in state.items()})


def as_of(log: DataFrame, moment: Column | str) -> DataFrame:
    """The log as it was at a moment: fold it for the state of then."""
    return log.where(F.col("occurred_at") <= (F.lit(moment) if isinstance(moment, str) else moment))


def snapshot(state: DataFrame, path: str) -> DataFrame:
    """Store a state with its versions, for folds that go on from it."""
    state.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.schema(StructType(state.schema.fields)).parquet(path)
