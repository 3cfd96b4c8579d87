"""Names of streams, types and files."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def type_name(column: Column | str) -> Column:
    """A qualified type name without pointer mark and package path; arguments in brackets are kept whole."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(column, r"^\*?(?:[^\[]*\.)?([^.\[]+)", "$1")


def stream_name(*parts: Column | str) -> Column:
    """Deterministic name of a stream: its parts, such as tenant and aggregate, joined by a dash; nulls are left out."""
    return F.concat_ws("-", *parts)


def padded_name(version: Column | str, event_type: Column | str, width: int = 10) -> Column:
    """File name that sorts as the version does, up to ``width`` digits."""
    return F.concat(F.lpad(F.col(version).cast("string") if isinstance(version, str) else version.cast("string"), width, "0"), F.lit("-"), event_type if isinstance(event_type, Column) else F.col(event_type), F.lit(".json"))


def file_version(name: Column | str) -> Column:
    """The version in a file name or path; null where there is none."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_extract(name, r"(?:^|/)0*(\d{1,18})(?:-[^/]*)?\.json$", 1).try_cast("long")


def revision_code(kind: Column | str, version: Column | str) -> Column:
    """The integer of a stream state: any -1, new 0, existing -2, or the version itself."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    version = F.col(version) if isinstance(version, str) else version
    return F.when(kind == "any", F.lit(-1)).when(kind == "no_stream", F.lit(0)).when(kind == "stream_exists", F.lit(-2)).otherwise(version).cast("long")
