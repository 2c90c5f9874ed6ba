"""Quotation linking: replies found by what they quote.

Quote levels (leading ``>`` signs) are parsed, and each message's own text is what stands at level 0. Quoted text is cut into
units (whole passages of one level and their single lines), normalised and hashed, and each unit is joined to
the nearest earlier message of its conversation whose own text has the same unit. The source of a quote level is the message that most of its quoted
characters come from, and a message replies to the source of its shallowest level that has one; following replies gives threads, and threads in order
give the conversation without quotes.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import stored
from bizlens.operators.ordering import running_total

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
PARSED = "struct<own:string,units:array<struct<level:int,hash:binary,chars:int>>,quoted:int>"
SOURCES = "array<struct<level:int,source:bigint>>"
NO_CONVERSATION = -(1 << 63)


def normalised(line: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(line.lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, str]], int]:
    """Own text; the units as (level, normalised text), level 0 for own ones; number of quoted lines."""
    own, units, quoted, passages = [], [], 0, []
    for line in text.split("\n"):
        found = MARKS.match(line)
        level = found.group(1).count(">") if found else 0
        rest = line[found.end():] if found else line
        quoted += level > 0
        if not level:
            own.append(line)
        clean = normalised(rest)
        if not clean:
            if passages and passages[-1][0] == level:
                passages.append((level, []))  # a blank line ends a passage
            continue
        if not passages or passages[-1][0] != level:
            passages.append((level, []))
        passages[-1][1].append(clean)
    for level, lines in passages:
        if lines:
            units.append((level, " ".join(lines)))
            if len(lines) > 1:
                units += [(level, x) for x in lines]
    return "\n".join(own).strip("\n"), units, quoted


def parsed(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        own, units, quoted = parse(t.as_py())
        seen = dict.fromkeys(units)
        out.append({"own": own, "quoted": quoted,
                    "units": [{"level": v, "hash": hashlib.sha256(u.encode("utf-8", "replace")).digest(), "chars": len(u)} for v, u in seen]})
    kind = pa.struct([("own", pa.string()), ("units", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("chars", pa.int32())]))), ("quoted", pa.int32())])
    return pa.array(out, kind)


def replies(messages: DataFrame) -> DataFrame:
    """``conv, turn, reply_to, sources`` of the messages that quote an earlier one, from ``conv, turn, units``; ``sources`` has the message each level comes from.

    Own units are kept only where something quotes them; each quoted unit meets the nearest earlier one by a running maximum, so no pairs
    are built where a line is repeated over and over.
    """
    units = messages.select("conv", "turn", F.explode("units").alias("u")).select("conv", "turn", "u.*").filter(F.col("turn").isNotNull())
    asked = units.filter("level > 0").groupBy("conv", "hash", "turn").agg(F.max("chars").alias("chars"), F.collect_set("level").alias("levels"))
    asked = stored(asked, "quoted-units")
    if asked.isEmpty():
        return asked.select("conv", "turn", F.col("turn").alias("reply_to"), F.lit(None).cast(SOURCES).alias("sources"))
    given = units.filter("level = 0").join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").groupBy("conv", "hash", "turn").agg(F.lit(True).alias("given"))
    both = asked.join(given, ["conv", "hash", "turn"], "full_outer")
    before = Window.partitionBy("conv", "hash").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("source", F.max(F.when(F.col("given"), F.col("turn"))).over(before)).filter("chars IS NOT NULL AND source IS NOT NULL")
    weights = met.withColumn("level", F.explode("levels")).groupBy("conv", "turn", "level", "source").agg(F.sum("chars").alias("w"))
    best = Window.partitionBy("conv", "turn", "level").orderBy(F.col("w").desc(), F.col("source").desc())
    chosen = weights.withColumn("k", F.row_number().over(best)).filter("k = 1")
    return chosen.groupBy("conv", "turn").agg(F.min_by("source", "level").alias("reply_to"), F.array_sort(F.collect_list(F.struct("level", "source"))).cast(SOURCES).alias("sources"))


def threads(links: DataFrame) -> DataFrame:
    """``conv, turn, reply_to, sources, thread, depth``: the first message each chain of replies leads to, and how many replies lie between.

    Each round doubles the distance that a message looks ahead, so rounds grow with the logarithm of the longest chain.
    """
    now = stored(links.select("conv", "turn", "reply_to", "sources", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select(F.col("conv"), F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv", "thread"], "left")
        now = stored(step.select("conv", "turn", "reply_to", "sources", F.coalesce("next", "thread").alias("thread"),
                                 (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Per message: ``conv_id, turn, role, text`` (without quotes), ``reply_to``, ``thread``, ``depth``, ``position``, ``n_quoted``, ``sources``.

    ``position`` (from 1) puts a conversation's threads in order of their first turn and messages of a thread by turn. ``sources`` lists
    (level, turn) for each quote level whose text an earlier message has as its own (null where none has). A message that quotes nothing known at any level starts a thread of its own (``reply_to`` null, ``depth`` 0). A null text counts as empty. A null turn comes last,
    quotes nothing and is quoted by nothing. Messages of a null conversation form one. Repeated rows stay, next to each other; of equal
    (conversation, turn) the order follows the text. An empty table gives an empty table; other columns are not read.
    """
    rows = messages.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_CONVERSATION)).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                           F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    read = stored(rows.select("conv", "turn", "role", F.arrow_udf(parsed, PARSED)("raw").alias("p")).select("conv", "turn", "role", "p.*"), "messages")
    found = threads(replies(read))
    placed = read.select("conv", "turn", "role", "own", "quoted").join(found, ["conv", "turn"], "left").withColumns({
        "thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0)), "one": F.lit(1), "tie": F.xxhash64("own", "role")})
    ordered = running_total(placed, [("thread", False), ("turn", False), ("tie", False)], {"position": "one"}, by=["conv"])
    return ordered.select(F.nullif("conv", F.lit(NO_CONVERSATION)).alias("conv_id"), "turn", "role", F.col("own").alias("text"), "reply_to", "thread", "depth",
                          "position", F.col("quoted").alias("n_quoted"), "sources")
