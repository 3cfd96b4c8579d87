"""What can go wrong, as exceptions that callers can tell apart."""

from __future__ import annotations


class LogError(Exception):
    """Any error of the log."""

    #: Whether the error is a handler's verdict on a command. Workers may hold a copy of these classes beside the imported
    #: ones, so code that runs there asks for this and not for the class.
    rejects = False


class StreamNotFound(LogError):
    """A stream had to exist."""


class StreamAlreadyExists(LogError):
    """A stream had to be new."""


class InvalidBatch(LogError):
    """The events of one append belong to several streams."""


class InvalidRevision(LogError):
    """A position lies beyond the head, or is none that the log knows."""


class EventNotRegistered(LogError):
    """A stored event type has no entry in the registry."""


class UndecodableEvent(LogError):
    """A payload does not fit the registered schema."""


class HandlerNotFound(LogError):
    """No handler for a query or command type."""


class DuplicateHandler(LogError):
    """A second handler or subscription of one name."""


class HandlerFailed(LogError):
    """A command handler raised something that is not one of these errors."""


class BusClosed(LogError):
    """The bus was stopped."""


class DispatchCancelled(LogError):
    """The caller of a dispatch gave up waiting."""


class LeaseLost(LogError):
    """Another process runs the subscription."""


class StoreClosed(LogError):
    """The store was closed."""


class RevisionConflict(LogError):
    """The head of a stream is not where the writer expected it."""

    def __init__(self, stream: str, expected: int, actual: int) -> None:
        super().__init__(f"stream {stream!r} is at {actual}, expected {expected}")
        self.stream, self.expected, self.actual = stream, expected, actual


class SkippedEvent(LogError):
    """A handler declined an event; counts as handled."""

    def __init__(self, event_type: str) -> None:
        super().__init__(f"skipped event of type {event_type}")
        self.event_type = event_type


class RuleViolation(LogError):
    """A command was rejected by a business rule; ``cause`` says by which."""

    rejects = True

    def __init__(self, cause: BaseException | str | None = None) -> None:
        super().__init__("business rule violation" + (f": {cause}" if cause else ""))
        self.cause = cause
        if isinstance(cause, BaseException):
            self.__cause__ = cause
