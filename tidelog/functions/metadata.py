"""Metadata maps."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_metadata(*maps: Column | str) -> Column:
    """One map of all keys; a later map wins. Null maps are empty. Does not depend on the session's duplicate-key setting."""
    columns = [F.coalesce(F.col(m) if isinstance(m, str) else m, F.create_map().cast("map<string,string>")) for m in maps]

    def over(left: Column, right: Column) -> Column:
        return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)

    return reduce(over, columns)


def causation_id(metadata: Column | str) -> Column:
    """What caused the event; empty where nothing is said."""
    return F.coalesce(F.element_at(metadata, F.lit("causation_id")), F.lit(""))


def with_causation(metadata: Column | str, cause: Column | str) -> Column:
    return merge_metadata(metadata, F.create_map(F.lit("causation_id"), F.col(cause) if isinstance(cause, str) else cause))
