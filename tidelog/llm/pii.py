"""Personal data: four fixed patterns, and contextual extraction bootstrapped from what they find.

Base spans (email, ip, card, phone) are the seeds. Every token that looks like an identifier, seed or not, every run of adjacent
groups of digits, and every address written apart (``jo @ mail.com``, ``jo(at)mail.com``) is an instance. It induces lexical patterns: the two
words before, the word before, the word after, and the words on both sides, each with what the instance is made of (digits and signs,
an address, or letters with digits), so that a hash after "call" is no phone. A label in the token (``tel:555...``) is its word before.

Patterns and instances form a bipartite graph that Spark scores in rounds, to the fixed point. A pattern scores its precision for
a kind: the share of its distinct instances that are known, of which there have to be ``MIN_SEEDS``. An instance is known if it is a
seed, or if the noisy-or of the scores (``SUPPORT`` or more) of its patterns reaches ``ACCEPTED``; known instances are seeds of the next round.
What is known only grows, so the rounds end. Patterns that end at ``ACCEPTED`` or more turn their other instances into spans
of that kind, as does every instance whose text is that of a seed elsewhere.

Offsets are code points, ends are exclusive. A null or empty text has no spans. Base spans stay as they are, also where
they overlap across kinds; added spans never touch base ones. An instance of several kinds gets that of the highest score, among equals the
first listed. Rows that share id and text get the same spans; an empty table gives no rows. Other columns are not carried by ``find``,
and kept whatever their names by ``redact``. Texts are searched whole in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.plans.scratch import keep
from tidelog.plans.skew import spread_join

KINDS = ("email", "ip", "card", "phone")
#: Distinct known instances that a pattern needs, the score from which it is trusted, and from which it counts for an instance.
MIN_SEEDS, ACCEPTED, SUPPORT = 5, 0.9, 0.6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
#: Part of an identifier written in groups, and the most digits that one has (those of a card).
_GROUP, MAX_DIGITS = re.compile(r"[0-9().+-]+"), 19
_TRIM = ".,;:!?\"'()[]{}<>|=*#&%$"
#: An @ written apart or spelt, and a label in front of an identifier in one token.
_AT, _LABEL = re.compile(r"[(\[{]at[)\]}]|@"), re.compile(r"[^\W\d_]{2,}[:=]+(?=.)")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end), in order. Every kind is searched on its own, leftmost first and not overlapping."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # the part before @ is the longest run of its characters, down to the last match
        found = _DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, found.end()))
                free = found.end()
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def looks_identifying(token: str) -> bool:
    """A token worth asking about: four digits or more, or an @ (or ``(at)``) inside."""
    return len(_DIGIT.findall(token)) >= 4 or bool(_AT.search(token, 1, len(token) - 1))


def made_of(token: str) -> str:
    """What an identifier is made of: an address (m), digits and signs (d), or letters too (x)."""
    return "m" if _AT.search(token) else "x" if any(c.isalpha() for c in token) else "d"


def key(what: str, most: int) -> str:
    """what, or a hash of all of it if it is longer than ``most``."""
    return what if len(what) <= most else "#" + hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def grouped(text: str, tokens: list[tuple[int, int]], first: int, taken: set[int]) -> int:
    """The last token of the groups of digits that begin with token ``first``, joined by spaces while they have ``MAX_DIGITS`` or fewer."""
    token = text[slice(*tokens[first])].lstrip(_TRIM)
    if not _GROUP.fullmatch(token) or not (digits := len(_DIGIT.findall(token))):
        return first
    last = first
    for i in range(first + 1, len(tokens)):
        if i in taken or text[tokens[i - 1][1] : tokens[i][0]].strip(" "):
            break
        token = text[slice(*tokens[i])]
        core = token if _GROUP.fullmatch(token) else token.rstrip(_TRIM)
        digits += len(_DIGIT.findall(core))
        if not _GROUP.fullmatch(core) or digits > MAX_DIGITS:
            break
        if _DIGIT.search(core):
            last = i
        if core != token:
            break
    return last


def apart(text: str, tokens: list[tuple[int, int]], i: int, taken: set[int]) -> bool:
    """Whether tokens i, i + 1 and i + 2 are an address written apart, on one line."""
    if i + 2 >= len(tokens) or taken & {i, i + 1, i + 2}:
        return False
    if not _AT.fullmatch(text[slice(*tokens[i + 1])]) or text[tokens[i][1] : tokens[i + 2][0]].count("\n"):
        return False
    return text[tokens[i][1] - 1] in _LOCAL and bool(_DOMAIN.match(text, tokens[i + 2][0]))


def instances(text: str, spans: list[Span]) -> list[tuple[int, int, int | None, str, list[str]]]:
    """(start, end, kind of a seed or None, what it is, its patterns)."""
    if not spans and "@" not in text and not _DIGIT.search(text) and not _AT.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts, out, seeds = [a for a, _ in tokens], [], sorted(spans)
    word = lambda i: key(text[tokens[i][0] : tokens[i][1]].lower().strip(_TRIM), 40) if 0 <= i < len(tokens) else ""

    def patterns(start: int, end: int, first: int, last: int) -> list[str]:
        label = key(text[tokens[first][0] : start].lower().strip(_TRIM), 40)
        a, b = (word(first - 1), label) if label else (word(first - 2), word(first - 1))
        c, kind = word(last + 1), made_of(text[start:end])
        return [f"{p} {kind}" for p, full in ((f"{a} {b} _", a and b), (f"{b} _", b), (f"_ {c}", c), (f"{b} _ {c}", b and c)) if full]

    import bisect

    taken: set[int] = set()
    for start, kind, end in seeds:
        first, last = bisect.bisect_right(starts, start) - 1, bisect.bisect_left(starts, end) - 1
        taken.update(range(first, last + 1))
        out.append((start, end, kind, key(text[start:end].lower(), 80), patterns(start, end, first, last)))
    last = -1
    for i in range(len(tokens)):
        if i in taken or i <= last:
            continue
        last = i + 2 if apart(text, tokens, i, taken) else grouped(text, tokens, i, taken)
        start, end = tokens[i][0], tokens[last][1]
        label = _LABEL.match(text, start, end)
        token = text[label.end() if label else start : end]
        core = token.strip(_TRIM)
        if core and looks_identifying(core):
            a = end - len(token) + token.index(core)
            b = a + len(core)
            if a > start and text[a - 1] == "(" and core.count(")") > core.count("("):
                a -= 1
            out.append((a, b, None, key(text[a:b].lower(), 80), patterns(a, b, i, last)))
    return out


_SCAN = "base array<struct<start: long, kind: int, end: long>>, seen array<struct<start: long, end: long, kind: int, what: string, patterns: array<string>>>"


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    seen_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("what", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        base, seen = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            seen.append([{"start": a, "end": b, "kind": k, "what": w, "patterns": p} for a, b, k, w, p in instances(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(base, base_type), pa.array(seen, seen_type)], names=["doc_id", "fp", "base", "seen"])


def bootstrapped(seen: DataFrame, min_seeds: int = MIN_SEEDS, accepted: float = ACCEPTED, support: float = SUPPORT) -> DataFrame:
    """seen: kind, what, pattern (one row an occurrence) to the trusted patterns: pattern, kind, score.

    Only patterns with ``min_seeds`` distinct instances can be trusted, so the graph is cut down to these first. Joins
    deal the edges of a pattern or instance that has very many over several tasks.
    """
    edges = seen.select("pattern", "what").distinct()
    sizes = keep(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds), "sizes")
    edges = keep(spread_join(edges, sizes.withColumn("w", F.col("n")).drop("n"), ["pattern"], "w", F.col("what"), "left_semi"), "graph")
    degrees = keep(edges.groupBy("what").agg(F.count(F.lit(1)).alias("w")), "degrees")
    known = keep(seen.where("kind is not null").select("what", "kind").distinct(), "known")
    while True:
        hits = spread_join(edges, known.join(degrees, "what"), ["what"], "w", F.col("pattern"))
        found = hits.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= min_seeds)
        scores = found.join(sizes, "pattern").select("pattern", "kind", (F.col("found") / F.col("n")).alias("score"), F.col("n").alias("w"))
        scores = keep(scores.where(F.col("score") >= support), "scores")
        doubt = F.sum(F.log1p(-F.least("score", F.lit(0.999))))
        belief = spread_join(edges, scores, ["pattern"], "w", F.col("what")).groupBy("what", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("belief"))
        new = keep(belief.where(F.col("belief") >= accepted).select("what", "kind").join(known, ["what", "kind"], "left_anti"), "new")
        if new.isEmpty():
            return scores.where(F.col("score") >= accepted).select("pattern", "kind", "score")
        known = keep(known.unionByName(new), "known")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: float) -> DataFrame:
    """doc_id, fp (a hash of the text), base and added spans (arrays of start, kind, end)."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    scan = keep(slim.mapInArrow(scanned, f"doc_id {kind}, fp long, {_SCAN}"), "scan")
    found = scan.select("doc_id", "fp", F.explode("seen").alias("s")).select("doc_id", "fp", "s.start", "s.end", "s.kind", "s.what", "s.patterns")
    rows = found.select("kind", "what", F.explode("patterns").alias("pattern"))
    good = bootstrapped(rows, **limits).select("pattern", F.col("kind").alias("as_kind"), "score")
    seeds = found.where("kind is not null").groupBy("what", F.col("kind").alias("as_kind")).agg(F.lit(1.0).alias("score"))
    open_ = found.where("kind is null")
    place, shown = ["doc_id", "fp", "start", "end"], F.struct("doc_id", "fp", "start")
    in_context = open_.select(*place, F.explode("patterns").alias("pattern"))
    counted = lambda df, by: df.groupBy(by).agg(F.count(F.lit(1)).alias("w"))
    in_pattern = spread_join(in_context, keep(good.join(counted(in_context, "pattern"), "pattern"), "good"), ["pattern"], "w", shown)
    as_seed = spread_join(open_, keep(seeds.join(counted(open_, "what"), "what"), "seeds"), ["what"], "w", shown)
    best = F.max(F.struct("score", (-F.col("as_kind")).alias("first")))
    new = in_pattern.select(*place, "as_kind", "score").unionByName(as_seed.select(*place, "as_kind", "score")).groupBy(*place).agg((-best["first"]).cast("int").alias("kind"))
    added = keep(new.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")), "added").withColumnRenamed("fp", "__fp").withColumnRenamed("doc_id", "__id")
    joined = scan.drop("seen").join(added, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp")), "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    return joined.select("doc_id", "fp", "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, out = batch.schema.get_field_index(text), []
        for t, added in zip(batch.column(at).to_pylist(), batch.column("__added").to_pylist(), strict=True):
            if t is not None:
                spans = sorted(base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in added or []])
                parts, free = [], 0
                for start, kind, end in spans:
                    if start >= free:
                        parts += [t[free:start], f"<{KINDS[kind].upper()}>"]
                    free = max(free, end)
                t = "".join(parts) + t[free:] if parts else t
            out.append(t)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind, such as <EMAIL>; overlapping spans by the first one's. Columns are those of docs."""
    added = find(docs, text=text).where(F.size("added") > 0).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), F.col("added").alias("__added")).dropDuplicates(["__id", "__fp"])
    added = keep(added, "redact")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__fp"))
    joined = docs.join(added, on, "left").select(*docs.columns, "__added")
    out = joined.mapInArrow(lambda batches: _redacted(batches, text), joined.schema).select(*docs.columns)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
