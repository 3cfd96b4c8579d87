"""Scalar functions on columns: hashing to shards, names, payloads, metadata."""

from tidelog.functions.hashing import fnv1a_32, shard
from tidelog.functions.metadata import causation_id, merge_metadata, with_causation
from tidelog.functions.names import file_version, padded_name, revision_code, stream_name, type_name
from tidelog.functions.payload import decode_strict, encode, field

__all__ = ["causation_id", "decode_strict", "encode", "field", "file_version", "fnv1a_32", "merge_metadata", "padded_name", "revision_code", "shard", "stream_name", "type_name", "with_causation"]
