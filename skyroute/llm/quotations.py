"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotations; the marks count the level.  Runs of lines of one level are passages.
A passage is normalised (case, white space and punctuation left out) and hashed, as are the whole own text, the paragraphs
and the lines of every message; joining the hashes within a conversation finds the message that first said what is
quoted.  A message replies to the latest message found for its least nested quotation, or, without any, to the message
before it.  Conversations then come out without quotations, replies after what they reply to, branch by branch.

Everything is DataFrame functions.  Hashes are reduced to the first message that has them before the join, so a sentence
that very many messages share is one row of its conversation; and no conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroute.llm.tables import staged

#: The marks before a quoted line.  Possessive classes, so that neither time nor stack follows more than the number of marks.
_MARKS = r"^[ \t]*+>[> \t]*+"
#: A line that introduces a quotation: it ends in a colon, speaks of writing, and goes with the quotation.
_INTRODUCTION = r"(?i)^.{0,200}\b(wrote|writes|schrieb|écrit|escribió)\s*+:\s*+$"
#: What is trimmed at the end of a text without its quotations.
_BLANKS = " \t\n\x0b\f\r"


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARKS, 0), " \t", ""))


def normalised(text: Column) -> Column:
    """Lower case, letters and digits of any script only, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(text: Column) -> Column:
    """128 bits of hash; null for a passage without letters or digits."""
    plain = normalised(text)
    return F.when(F.length(plain) > 0, F.substring(F.sha2(plain, 256), 1, 32))


def _unix(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, with ``own`` (the text without quotations) and ``passages`` (level, text)."""
    lines = F.transform(
        F.split(_unix(F.coalesce("text", F.lit(""))), "\n"),
        lambda x: F.struct(_level(x).alias("level"), F.when(_level(x) > 0, F.regexp_replace(x, _MARKS, "")).otherwise(x).alias("line")),
    )
    with_lines = messages.withColumn("lines", lines)
    is_intro = lambda i: (
        (F.element_at("lines", i + 1)["level"] == 0)
        & F.element_at("lines", i + 1)["line"].rlike(_INTRODUCTION)
        & F.coalesce(F.try_element_at("lines", i + 2)["level"] > 0, F.lit(False))
    )
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~is_intro(i))
    changes = F.filter(
        F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.element_at("lines", i)["level"] != F.element_at("lines", F.greatest(i - 1, F.lit(1)))["level"])
    )
    passages = F.transform(
        "changes",
        lambda at, k: F.struct(
            F.element_at("lines", at)["level"].alias("level"),
            F.array_join(
                F.transform(F.slice("lines", at, F.coalesce(F.try_element_at("changes", k + 2), F.size("lines") + 1) - at), lambda x: x["line"]), "\n"
            ).alias("text"),
        ),
    )
    unquoted = F.ltrim(F.rtrim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit(_BLANKS)), F.lit("\n"))
    return with_lines.withColumn("changes", changes).select(
        "conv_id",
        "turn",
        "role",
        F.when(F.exists("lines", lambda x: x["level"] > 0), unquoted).otherwise(F.coalesce("text", F.lit(""))).alias("own"),
        F.filter(passages, lambda p: p["level"] > 0).alias("passages"),
    )


def _parts(text: Column) -> Column:
    """The text, its paragraphs and its lines."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")))


def linked_conversations(messages: DataFrame, *, most_rounds: int = 64) -> DataFrame:
    """One row per message: conv_id, turn, role, text, n_quotes, n_linked, parent_turn, depth, branch.

    ``text`` is without quotations and the lines that introduce them, nor blanks and line ends around what is left; a text without quotations stays as it is.
    Texts, lines, marks and runs of blanks of any length will do.  ``n_quotes`` counts quoted passages and
    ``n_linked`` those whose original was found earlier in the conversation.  ``parent_turn`` is null for the first message.
    ``branch`` is the list of turns at which the path from the first message left the plain order, ``depth`` its length;
    rows come sorted by conv_id, branch and turn, which is reply order.  A null text is empty; rows with a null
    conv_id or turn are left out; of rows that repeat a turn the one with the least (role, text) counts.
    An empty table gives an empty one; other columns are ignored, whatever their names.
    """
    rows = (
        messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .where("conv_id is not null and turn is not null")
        .groupBy("conv_id", "turn")
        .agg(F.min(F.struct("role", "text")).alias("m"))
        .select("conv_id", "turn", "m.role", "m.text")
    )
    said = staged(parsed(rows), "messages")

    originals = (
        said.select("conv_id", "turn", F.explode(_parts(_unix(F.col("own")))).alias("part"))
        .select("conv_id", _key(F.col("part")).alias("key"), "turn")
        .where("key is not null")
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("original"))
    )
    quotes = said.select("conv_id", "turn", F.posexplode("passages").alias("nth", "p")).select("conv_id", "turn", "nth", "p.level", F.col("p.text").alias("passage"))
    keys = quotes.select("conv_id", "turn", "nth", "level", F.explode(_parts(F.col("passage"))).alias("part")).select(
        "conv_id", "turn", "nth", "level", _key(F.col("part")).alias("key"), F.length("part").alias("size")
    )
    found = (
        keys.join(originals, ["conv_id", "key"])
        .where("original < turn")
        .groupBy("conv_id", "turn", "nth", "level")
        .agg(F.max_by("original", F.struct("size", "original")).alias("original"))  # the longest part that is found decides
    )
    replies = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("original")).alias("late"))).alias("best"))
    replies = replies.select("conv_id", "turn", "n_linked", (-F.col("best.late")).alias("quoted"))

    # the message before: turns are first grouped in ranges, so that no conversation is one window
    width = 1024
    step = said.select("conv_id", "turn", F.floor(F.col("turn") / width).alias("range"))
    ends = step.groupBy("conv_id", "range").agg(F.max("turn").alias("last"))
    from pyspark.sql import Window

    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("conv_id").orderBy("range"))).select("conv_id", "range", "before")
    step = step.withColumn("previous", F.lag("turn").over(Window.partitionBy("conv_id", "range").orderBy("turn")))
    step = step.join(ends, ["conv_id", "range"]).select("conv_id", "turn", F.coalesce("previous", "before").alias("previous"))

    linked = staged(
        step.join(replies, ["conv_id", "turn"], "left").withColumn("parent_turn", F.coalesce("quoted", "previous")),
        "replies",
    )
    # messages that answer another than the one before begin a branch
    starts = linked.where("quoted is not null and quoted <> previous").select("conv_id", F.col("turn").alias("start"), F.col("quoted").alias("leaves"))
    branches = staged(_branches(starts, most_rounds), "branches")
    chains = _chain(linked.select("conv_id", "turn"), starts.select("conv_id", "start"), width)
    placed = chains.join(branches, ["conv_id", "start"], "left").select("conv_id", "turn", F.coalesce("branch", F.array().cast("array<long>")).alias("branch"))
    out = (
        said.select("conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_quotes"))
        .join(linked.select("conv_id", "turn", "n_linked", "parent_turn"), ["conv_id", "turn"])
        .join(placed, ["conv_id", "turn"])
        .select(
            "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn",
            F.size("branch").cast("long").alias("depth"), "branch",
        )
    )
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(parts, "conv_id", "branch", "turn").sortWithinPartitions("conv_id", "branch", "turn")


def _chain(turns: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(conv_id, turn, start): the latest branch start at or before each turn, null without one."""
    from pyspark.sql import Window

    both = turns.select("conv_id", "turn", F.lit(None).cast("long").alias("start")).union(starts.select("conv_id", "start", "start"))
    both = both.groupBy("conv_id", "turn").agg(F.max("start").alias("start")).withColumn("range", F.floor(F.col("turn") / width))
    ends = both.groupBy("conv_id", "range").agg(F.max("start").alias("last"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.max("last").over(before)).select("conv_id", "range", "before")
    upto = Window.partitionBy("conv_id", "range").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("start", F.max("start").over(upto)).join(ends, ["conv_id", "range"]).select("conv_id", "turn", F.coalesce("start", "before").alias("start"))


def _branches(starts: DataFrame, most_rounds: int) -> DataFrame:
    """(conv_id, start, branch): the turns where the path to each branch start leaves the plain order.

    Each round joins every open branch with that from which it leaves; paths double with each.
    """
    parents = _chain(starts.select("conv_id", F.col("leaves").alias("turn")).distinct(), starts.select("conv_id", "start"), 1024)
    state = starts.join(parents.select("conv_id", F.col("turn").alias("leaves"), F.col("start").alias("up")), ["conv_id", "leaves"])
    state = staged(state.select("conv_id", "start", F.array("start").alias("branch"), "up"), "branch-starts")
    for _ in range(most_rounds):
        if not state.where("up is not null").limit(1).count():
            break
        above = state.select("conv_id", F.col("start").alias("up"), F.col("branch").alias("b2"), F.col("up").alias("u2"))
        state = staged(
            state.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "start", F.when(F.col("b2").isNotNull(), F.concat("b2", "branch")).otherwise(F.col("branch")).alias("branch"), F.col("u2").alias("up")
            ),
            "branch-starts",
        )
    return state.select("conv_id", "start", "branch")
