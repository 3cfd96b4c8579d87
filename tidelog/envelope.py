"""The envelope: the one row type of a log, and positions in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("stream_id", T.StringType(), False),
        T.StructField("aggregate_id", T.StringType(), True),
        T.StructField("version", T.LongType(), False),
        T.StructField("global_version", T.LongType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("payload", T.StringType(), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("occurred_at", T.TimestampType(), True),
    ]
)
COLUMNS = ENVELOPE.fieldNames()


@dataclass(frozen=True)
class StreamState:
    """An expectation on a stream's head when appending, a start position when loading."""

    code: int

    def __int__(self) -> int:
        return self.code


ANY = StreamState(-1)
NO_STREAM = StreamState(0)
STREAM_EXISTS = StreamState(-2)


@dataclass(frozen=True)
class Revision(StreamState):
    """Exactly this version; versions count from 1, so ``Revision(n)`` loads what comes after n events."""


@dataclass(frozen=True)
class AppendResult:
    successful: bool
    stream_id: str
    next_version: int
