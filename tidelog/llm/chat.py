"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that begin with ``>`` are quotes; the number of ``>`` before the text is the level. Consecutive lines of one level are a
passage; blank lines end one. The text of a line is normalised (markers and repeated white space away, lower case) and hashed, and so
is that of a passage, with its lines folded into one. Each quoted line is linked to the latest earlier message of its conversation that has
the line as its own: as a line, a paragraph or its whole body; a line that none has goes where its passage is found, so a quotation that was
wrapped anew is linked too. The message that most lines of level 1 link to (ties: the later) is
the one replied to. Messages lose their quotes and are put in reply order: by the first message of the chain of
replies they are in, then by turn; a reply stands after what it replies to.

The latest earlier message is a running maximum, in blocks of turns with the maximum of the blocks before, so neither a
common line nor a long conversation makes pairs or one task. Positions come from a range-partitioned layout.

Null texts are empty; a null role is ``unknown``; rows without conversation or turn are formatted and get a position, but are not
linked (null conversations count as one, null turns stand last). Messages of any length are read whole, in time that grows with their lines. Repeated
rows each stay. An empty table gives no rows. Columns of other names are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.ranks import rank_sorted
from tidelog.plans.scratch import keep

#: Turns of one block of the running maximum.
BLOCK_TURNS = 256


def _marks(line: Column) -> Column:
    return F.regexp_extract(line, r"^[\s>]*", 0)


def level(line: Column) -> Column:
    """How deep a line is quoted: the > in its leading run of > and white space."""
    marks = _marks(line)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"^[\s>]*", ""), r"\s+", " ")))


#: Consecutive lines of one level, written as level, tab, text; without backtracking, so that very long ones need no deep stack.
_PASSAGE = r"(?md)^(\d+)\t[^\n]++(?:\n\1\t[^\n]++)*+"


def parse(messages: DataFrame) -> DataFrame:
    """uid, conv_id, turn, role, lines (level and text of each line), passages (level, hash of each line, hash of all), body (hash of the own text)."""
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: F.struct(level(x).alias("level"), x.alias("line")))
    marked = F.array_join(F.transform("lines", lambda x: F.concat(x["level"].cast("string"), F.lit("\t"), normalised(x["line"]))), "\n")
    folded = lambda run: F.replace(F.regexp_replace(run, r"(?md)^\d+\t", ""), F.lit("\n"), F.lit(" "))
    hashes = lambda run: F.transform(F.split(run, "\n"), lambda x: F.xxhash64(F.regexp_replace(x, r"^\d+\t", "")))
    passages = F.transform("runs", lambda run: F.struct(F.regexp_extract(run, r"^(\d+)", 1).cast("int").alias("level"), hashes(run).alias("lines"), F.xxhash64(folded(run)).alias("whole")))
    body = F.xxhash64(F.array_join(F.transform(F.filter("runs", lambda run: run.startswith("0\t")), folded), " "))
    own = messages.select(F.monotonically_increasing_id().alias("uid"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), lines.alias("lines"))
    found = own.withColumn("runs", F.regexp_extract_all(marked, F.lit(_PASSAGE), 0))
    return found.withColumn("passages", passages).withColumn("body", body).drop("runs")


def link_quotes(parsed: DataFrame) -> DataFrame:
    """uid, conv_id, turn, level, n, to_turn: quoted lines by the turn they link to (null: to none)."""
    place = ["uid", "conv_id", "turn"]
    known = parsed.where("conv_id is not null and turn is not null")
    passages = known.select(*place, "body", F.posexplode("passages").alias("run", "p")).select(*place, "body", "run", "p.level", "p.lines", "p.whole")
    passages = keep(passages, "units")  # read several times below
    lines = passages.select(*place, "run", "level", "whole", F.size("lines").alias("k"), F.posexplode("lines").alias("i", "h"))
    quoted = lines.where("level > 0")
    line = [*place, "level", "run", "i"]
    asked = quoted.select(*line, F.lit(0).alias("by"), "h").unionByName(quoted.where("k > 1").select(*line, F.lit(1).alias("by"), F.col("whole").alias("h")))
    mine = passages.where("level = 0")
    own = lines.where("level = 0").select("conv_id", "turn", "h").unionByName(mine.select("conv_id", "turn", F.col("whole").alias("h"))).unionByName(mine.select("conv_id", "turn", F.col("body").alias("h")).distinct())
    own = own.join(asked.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").withColumn("own_turn", F.col("turn"))
    both = asked.withColumn("own_turn", F.lit(None).cast("long")).unionByName(own, allowMissingColumns=True).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    key = ["conv_id", "h"]
    ends = both.groupBy(*key, "block").agg(F.max("own_turn").alias("top"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*key, "block", F.max("top").over(before).alias("ahead"))
    inside = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("within", F.max("own_turn").over(inside)).where("level > 0").join(ahead, [*key, "block"], "left").withColumn("to", F.greatest("within", "ahead"))
    way = lambda by: F.max(F.when(F.col("by") == by, F.col("to")))
    found = seen.groupBy(*line).agg(F.coalesce(way(0), way(1)).alias("to_turn"))
    return found.groupBy(*place, "level", "to_turn").agg(F.count(F.lit(1)).alias("n"))


def reply_roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, parent to conv_id, turn, root: links are followed twice as far in each round, so rounds are few."""
    now = keep(replies.groupBy("conv_id", "turn").agg(F.min("parent").alias("root"), F.lit(False).alias("done")), "replies")
    while not now.where("not done").isEmpty():
        further = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"))
        step = now.join(further, (F.col("conv_id") == F.col("c")) & (F.col("root") == F.col("t")), "left")
        now = keep(step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done")), "roots")
    return now.select("conv_id", "turn", "root")


def conversations(messages: DataFrame, role_open: str = "<|", role_close: str = "|>\n", end: str = "<|end|>\n") -> DataFrame:
    """conv_id, turn, role, text of messages to the same without quotes, in reply order, with

    position (0, 1, 2 ... in the conversation), parent_turn (null: replies to none), root_turn, max_level, n_quoted, n_linked
    (quoted lines, and those linked) and formatted (the message in the chat template).
    """
    parsed = keep(parse(messages), "parsed")
    links = keep(link_quotes(parsed), "quotes")
    stats = links.groupBy("uid").agg(
        F.max("level").alias("max_level"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("to_turn").isNotNull(), F.col("n"))).alias("n_linked"),
        F.max(F.when((F.col("level") == 1) & F.col("to_turn").isNotNull(), F.struct("n", "to_turn"))).alias("best"),
        F.first("conv_id").alias("c"), F.first("turn").alias("t"),
    )
    stats = keep(stats.withColumn("parent_turn", F.col("best.to_turn")).drop("best"), "stats")
    roots = reply_roots(stats.where("parent_turn is not null").select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.col("parent_turn").alias("parent")))
    stats = stats.join(roots, (F.col("c") == F.col("conv_id")) & (F.col("t") == F.col("turn")), "left").drop("conv_id", "turn", "c", "t").withColumnRenamed("uid", "__uid")
    joined = parsed.join(stats, F.col("uid") == F.col("__uid"), "left").drop("__uid").withColumn("root_turn", F.coalesce("root", "turn"))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"])
    text = F.array_join(own, "\n")
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0))
    trimmed = F.when(quoted > 0, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)
    slim = joined.select("uid", "conv_id", "root_turn", "turn")
    ranked = rank_sorted(slim, ["conv_id"], ["root_turn", "turn", "uid"], "position").select(F.col("uid").alias("__uid"), "position")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = joined.withColumn("text", trimmed).join(ranked, F.col("uid") == F.col("__uid"))
    formatted = F.concat(F.lit(role_open), F.col("role"), F.lit(role_close), F.col("text"), F.lit(end))
    return out.select("conv_id", "position", "turn", "role", "parent_turn", "root_turn", zero("max_level").alias("max_level"), zero("n_quoted").alias("n_quoted"), zero("n_linked").alias("n_linked"), "text", formatted.alias("formatted"))
