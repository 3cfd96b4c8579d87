"""Registries of query and command handlers, with middleware.

Middleware is baked in when a handler is registered: what is added later does not reach it. The first one added is outermost.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future
from concurrent.futures import wait as futures_wait
from typing import Any

from tidelog.envelope import AppendResult
from tidelog.errors import BusClosed, DispatchCancelled, DuplicateHandler, HandlerFailed, HandlerNotFound, LogError
from tidelog.functions.hashing import OFFSET_BASIS, PRIME

Handler = Callable[[Any], Any]
Middleware = Callable[[Handler], Handler]


def wrapped(handler: Handler, middleware: list[Middleware]) -> Handler:
    for layer in reversed(middleware):
        handler = layer(handler)
    return handler


class QueryBus:
    """Query type and result type -> handler. A handler usually plans a DataFrame: a live read model over a log, or a cached table."""

    def __init__(self) -> None:
        self._handlers: dict[tuple[type, str], Handler] = {}
        self._asked: list[tuple[type, str]] = []
        self._middleware: list[Middleware] = []

    def use(self, *middleware: Middleware) -> None:
        self._middleware += middleware

    def register(self, query: type, handler: Handler, result: str = "DataFrame") -> None:
        if (query, result) in self._handlers:
            raise DuplicateHandler(f"{query.__name__} -> {result} has a handler already")
        self._handlers[query, result] = wrapped(handler, list(self._middleware))

    def gateway(self, query: type, result: str = "DataFrame") -> Handler:
        """A callable for one query type; ``validate`` tells of gateways that nothing answers."""
        self._asked.append((query, result))

        def ask(q: Any) -> Any:
            handler = self._handlers.get((query, result))
            if handler is None:
                raise HandlerNotFound(f"{query.__name__} -> {result}")
            return handler(q)

        return ask

    def validate(self) -> None:
        """Raise for all gateways without a handler at once."""
        missing = [f"{q.__name__} -> {r}" for q, r in self._asked if (q, r) not in self._handlers]
        if missing:
            raise HandlerNotFound("; ".join(missing))


def shard_of(key: str, shards: int) -> int:
    """The shard of an aggregate, as the column function gives it."""
    h = OFFSET_BASIS
    for b in key.encode():
        h = (h ^ b) * PRIME & 0xFFFFFFFF
    return h % max(1, shards)


class _Shard:
    """The waiting commands of a shard, at most ``depth``. Who waits for a place waits for this shard alone."""

    def __init__(self, depth: int) -> None:
        self.depth, self.jobs, self.closed, self.changed = max(1, depth), deque(), False, threading.Condition()

    def put(self, job: Any, until: float | None, cancelled: Callable[[], bool] | None) -> None:
        with self.changed:
            while len(self.jobs) >= self.depth and not self.closed:
                _wait(self.changed.wait, until, cancelled)
            if self.closed:
                raise BusClosed("the command bus was stopped")
            self.jobs.append(job)
            self.changed.notify_all()

    def get(self) -> Any:
        """The next command; None when the shard is closed and empty."""
        with self.changed:
            while not self.jobs and not self.closed:
                self.changed.wait()
            job = self.jobs.popleft() if self.jobs else None
            self.changed.notify_all()
            return job

    def close(self) -> None:
        with self.changed:
            self.closed = True
            self.changed.notify_all()


#: How often a wait looks whether it was cancelled.
_LOOK = 0.02


def _wait(wait: Callable[[float | None], Any], until: float | None, cancelled: Callable[[], bool] | None) -> None:
    """Wait once, for a while: until the deadline, or until it is time to look at ``cancelled`` again."""
    if cancelled and cancelled():
        raise DispatchCancelled("the caller gave up")
    left = None if until is None else until - time.monotonic()
    if left is not None and left <= 0:
        raise TimeoutError("no answer in time; the command may still run if it was taken")
    wait(left if not cancelled else _LOOK if left is None else min(left, _LOOK))


class CommandBus:
    """Commands by aggregate, serial within a shard, shards side by side; a full shard makes its own callers wait, no others.

    This is the path for single commands. Bulk commands are a DataFrame: see ``operators.decide``.
    """

    def __init__(self, shards: int = 1, depth: int = 1024) -> None:
        self._handlers: dict[type, Handler] = {}
        self._middleware: list[Middleware] = []
        self._shards = [_Shard(depth) for _ in range(max(1, shards))]
        self._workers = [threading.Thread(target=self._work, args=(s,), daemon=True) for s in self._shards]
        for w in self._workers:
            w.start()

    def use(self, *middleware: Middleware) -> None:
        self._middleware += middleware

    def register(self, command: type, handler: Handler) -> None:
        if command in self._handlers:
            raise DuplicateHandler(f"{command.__name__} has a handler already")
        self._handlers[command] = wrapped(handler, list(self._middleware))

    def dispatch(self, command: Any, timeout: float | None = None, cancelled: Callable[[], bool] | None = None) -> AppendResult:
        """Run a command and wait. ``timeout`` covers the wait for a place in the shard and for the result, and so does
        ``cancelled``, which is asked while waiting. After either the outcome is unknown: the command may still run if it was taken."""
        until, done = None if timeout is None else time.monotonic() + timeout, Future()
        self._shards[shard_of(command.aggregate_id, len(self._shards))].put((command, done), until, cancelled)
        while not done.done():
            _wait(lambda left: futures_wait([done], left), until, cancelled)
        return done.result()

    def _work(self, shard: _Shard) -> None:
        while (job := shard.get()) is not None:
            command, done = job
            handler = self._handlers.get(type(command))
            try:
                if handler is None:
                    raise HandlerNotFound(f"no handler for {type(command).__name__}")
                done.set_result(handler(command))
            except LogError as e:
                done.set_exception(e)
            except Exception as e:  # noqa: BLE001  a worker outlives its handlers' mistakes
                failed = HandlerFailed(f"{type(command).__name__}: {e}")
                failed.__cause__ = e
                done.set_exception(failed)

    def stop(self) -> None:
        """Take no more commands (who waits for a place is told), finish those that were taken. Again: nothing."""
        for s in self._shards:
            s.close()
        for w in self._workers:
            w.join()
