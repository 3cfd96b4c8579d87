"""Rule bitmask ledger: every rule is evaluated once, its failure is a bit, its measurement a column.

A ledger row holds what was measured and ``failures`` (bit i: rule i failed). Policies are versioned sets of
rules, applied to a ledger with one bitwise and; ablations (what a policy would keep without one rule) are
bitwise aggregates of the same ledger. No text is read again for either.

Defined cases: a null or empty text has no words, all measures 0, and fails ``few_words``; repeated rows each
get a row; of equal lines or windows the first is counted by the rule that names it, so there are no ties; an empty table gives an empty ledger; columns of the input other than the id and the text are
not carried, so clashing names do no harm; texts are measured whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidelog.llm.batches import bounded_batches
from tidelog.llm.words import Hasher, Windows, Words, chunks, covered, mix, repeated

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", "n_distinct_words", "longest_word", "n_window_kinds"]
#: Distinct words are counted in windows of so many words, as their share of a text falls with its length.
WINDOW = 32_768


def measured(batches: Iterator[pa.RecordBatch], column: str = "text", carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> Iterator[pa.RecordBatch]:
    """The columns of ``carry`` and MEASURES, all int64, of each row."""
    hasher, windows = Hasher(), Windows()
    for batch in batches:
        for part, data, offsets in chunks(batch, column):
            n = part.num_rows
            w = Words(data, offsets)
            owner, size = w.owner(), np.diff(w.first)
            lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
            chars = lead[w.ends] - lead[w.starts]
            hashes = hasher(data, w.starts, w.ends)
            at, owner_of, keys = windows(hashes, w.first, 8)
            twice = repeated(keys ^ mix(owner_of.astype(np.uint64)))
            again = covered(at[twice], 8, len(hashes))

            cut = np.zeros(len(data) + 1, bool)
            cut[offsets] = True
            cut[1:][data == 10] = True  # a line begins after each line feed and with each text
            begins = np.flatnonzero(cut[:-1])
            ends = np.concatenate((begins[1:], [len(data)])) if len(begins) else begins
            full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
            begins, ends = begins[full], ends[full]
            ends = ends - (data[ends - 1] == 10)
            line_of = np.searchsorted(offsets, begins, side="right") - 1
            _, once = np.unique(hasher(data, begins, ends) ^ mix(line_of.astype(np.uint64)), return_index=True)
            dup = np.ones(len(begins), bool)
            dup[once] = False
            _, kinds = np.unique(hashes ^ mix(owner.astype(np.uint64)), return_index=True)
            kinds_near = kinds
            if len(size) and size.max() > WINDOW:
                window = (np.arange(len(hashes)) - w.first[owner]) // WINDOW
                _, kinds_near = np.unique(hashes ^ mix((owner.astype(np.uint64) << np.uint64(32)) + window.astype(np.uint64)), return_index=True)
            longest = np.zeros(n, np.int64)
            np.maximum.at(longest, owner, chars)
            by = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
            symbols = np.flatnonzero(_SYMBOLS[data])
            out = {
                "n_words": size,
                "word_chars": by(owner, chars),
                "n_symbols": by(np.searchsorted(offsets, symbols, side="right") - 1),
                "n_lines": by(line_of),
                "n_dup_lines": by(line_of[dup]),
                "dup_line_chars": by(line_of[dup], (lead[ends] - lead[begins])[dup]),
                "n_repeat_words": by(owner[again]),
                "n_distinct_words": by(owner[kinds]),
                "longest_word": longest,
                "n_window_kinds": by(owner[kinds_near]),
            }
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array(out[k].astype(np.int64)) for k in MEASURES)], names=[*carry, *(prefix + k for k in MEASURES)])


#: Rule i sets bit i of ``failures``. Order and meaning are fixed once published: new rules are appended.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("repeated_line_chars", "2 * dup_line_chars > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("few_kinds", "n_words >= 100 and 20 * n_window_kinds < n_words"),
]

#: Versioned policies: names of the rules whose failure rejects a text.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[name] for name in set(names))


def failure_bits(prefix: str = "") -> Column:
    """Bits of the rules that fail, from columns of measures."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        failed = F.expr(re.sub(r"[a-z]\w*", lambda m: m[0] if m[0] == "and" else prefix + m[0], rule))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measures and ``failures``: one row for each row of docs."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return found.withColumn("failures", failure_bits())


def apply_policy(book: DataFrame, policy: str | tuple[str, ...], name: str = "kept") -> DataFrame:
    """Add whether a text passes all rules of the policy."""
    return book.withColumn(name, F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablations(book: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail it alone, and that the policy keeps without it."""
    mask = policy_mask(policy)
    by_mask = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, 1 << i) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    aggs = []
    for name, bit in rules:
        b = F.lit(bit).cast("long")
        hit = F.col("f").bitwiseAND(b) != 0
        alone = F.col("f") == b
        none = F.col("f") == 0
        total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
        aggs.append(F.struct(F.lit(name).alias("rule"), total(hit).alias("failed"), total(alone).alias("failed_alone"), total(none | alone).alias("kept_without")))
    return by_mask.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with their own columns; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    carry, prefix = tuple(docs.columns), "__rule_"
    schema = StructType([*docs.schema.fields, *(StructField(prefix + m, LongType()) for m in MEASURES)])
    found = docs.mapInArrow(lambda batches: measured(batches, text, carry, prefix), schema)
    passed = failure_bits(prefix).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0
    return found.where(passed).select(*docs.columns)
