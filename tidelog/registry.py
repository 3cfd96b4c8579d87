"""Registered event types: stored names, their aliases and versions, and the schema each is decoded with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidelog.errors import DuplicateHandler
from tidelog.functions.payload import decode_strict


@dataclass
class EventType:
    name: str
    schema: StructType
    names: list[str] = field(default_factory=list)


class EventRegistry:
    """Stored name -> type. A name is registered once; a type may have several names (renames)."""

    def __init__(self) -> None:
        self._by_name: dict[str, EventType] = {}
        self._types: dict[str, EventType] = {}

    def register(self, name: str, schema: StructType | str, aliases: tuple[str, ...] = ()) -> EventType:
        if not name:
            raise ValueError("an event type needs a name")
        parsed = schema if isinstance(schema, StructType) else DataType.fromDDL(schema)
        known = self._types.get(name) or EventType(name, parsed)
        for stored in (name, *aliases):
            if stored in self._by_name:
                raise DuplicateHandler(f"event type {stored!r} is registered already")
        for stored in (name, *aliases):
            self._by_name[stored] = known
            known.names.append(stored)
        self._types[name] = known
        return known

    def alias(self, name: str, *aliases: str) -> None:
        """Further stored names of a registered type."""
        for stored in aliases:
            if stored in self._by_name:
                raise DuplicateHandler(f"event type {stored!r} is registered already")
            self._by_name[stored] = self._types[name]
            self._types[name].names.append(stored)

    def names_for(self, *types: str) -> list[str]:
        """All stored names of the types, sorted; a type that is not registered stands for itself."""
        return sorted({n for t in types for n in (self._types[t].names if t in self._types else [t])})

    def canonical(self, event_type: Column | str = "event_type") -> Column:
        """The registered type of a stored name; the query fails on a name that nobody registered."""
        event_type = F.col(event_type) if isinstance(event_type, str) else event_type
        if not self._by_name:
            return F.raise_error(F.concat(F.lit("event not registered: "), event_type)).cast("string")
        pairs = [F.lit(x) for stored, kind in sorted(self._by_name.items()) for x in (stored, kind.name)]
        found = F.element_at(F.create_map(*pairs), event_type)
        return F.coalesce(found, F.raise_error(F.concat(F.lit("event not registered: "), event_type)).cast("string"))

    def decode(self, log: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
        """One typed DataFrame for each type: the envelope and the payload's own columns."""
        return {name: self.view(log, name, strict) for name in self._types}

    def view(self, log: DataFrame, name: str, strict: bool = True) -> DataFrame:
        kind = self._types[name]
        body = decode_strict("payload", kind.schema) if strict else F.from_json("payload", kind.schema)
        rest = [c for c in log.columns if c != "payload"]
        return log.where(F.col("event_type").isin(kind.names)).withColumn("__body", body).select(*rest, "__body.*")

    def check(self, log: DataFrame) -> DataFrame:
        """The log with canonical type names; reading it fails on an unregistered name, which the message says."""
        return log.withColumn("event_type", self.canonical())


class Router:
    """Handlers by event type: one for each, given the typed rows; events of other types are skipped."""

    def __init__(self, registry: EventRegistry) -> None:
        self.registry, self._handlers = registry, {}

    def on(self, event_type: str, handler: Callable[[DataFrame], None]) -> Router:
        if not event_type:
            raise ValueError("a handler needs an event type")
        if event_type in self._handlers:
            raise DuplicateHandler(f"{event_type} has a handler already")
        self._handlers[event_type] = handler
        return self

    def stream_filter(self) -> list[str]:
        """Stored names of all that is handled, sorted: what a subscription has to read."""
        return self.registry.names_for(*self._handlers)

    def __call__(self, events: DataFrame, batch_id: int = 0) -> None:
        for event_type, handler in self._handlers.items():
            names = self.registry.names_for(event_type)
            own = events.where(F.col("event_type").isin(names))
            handler(self.registry.view(own, event_type) if event_type in self.registry._types else own)


def any_of(conditions: list[Column]) -> Column | None:
    """Or of all; None of none."""
    return reduce(lambda a, b: a | b, conditions) if conditions else None
