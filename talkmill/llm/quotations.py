"""Conversations from quotations.

Messages are parsed for nested quote levels. Quoted passages (paragraphs, and their single lines for
partial quotes) are normalised, hashed and joined to the message of the same conversation that first wrote
them. The message that wrote most of the first quote level is the parent; parents give threads,
and a thread lists its messages in reply order, without quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkmill.llm.common import by_value, numbered, same, staged

by_value(__name__)

_QUOTE = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?(.*)$")
_SAID = re.compile(r"^\s*(on|le|am|el)\b.*(wrote|écrit|schrieb|escribió)\s*:\s*$", re.IGNORECASE)

UNITS = "array<struct<level:int,hash:long,words:int>>"
PARSED = f"own string, quoted {UNITS}, written {UNITS}, n_passages int, max_level int"
_UNITS = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))


def levels(text: str) -> list[tuple[int, str]]:
    """Lines with their quote level; an attribution line right before a quote goes with the quote."""
    out = []
    for line in text.split("\n"):
        found = _QUOTE.match(line)
        out.append((found[1].count(">"), found[2]) if found else (0, line))
    kept = []
    for i, (level, line) in enumerate(out):
        if _SAID.match(line) and next((out[j][0] for j in range(i + 1, len(out)) if out[j][1].strip()), 0) > level:
            continue
        kept.append((level, line))
    return kept


def passages(lines: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Paragraphs: neighbouring lines of one level between blank lines, each with normalised lines."""
    out: list[tuple[int, list[str]]] = []
    last = None
    for level, line in lines:
        words = " ".join(line.lower().split())
        if not words:
            last = None
        elif level == last:
            out[-1][1].append(words)
        else:
            out.append((level, [words]))
            last = level
    return out


def units(found: list[tuple[int, list[str]]]) -> list[dict]:
    """Hashed units of passages: the paragraph as one, and every line."""
    out = []
    for level, lines in found:
        for kind, text in [("p", " ".join(lines)), *(("l", line) for line in lines)]:
            out.append({"level": level, "hash": xxhash.xxh64_intdigest(f"{kind}:{text}") - (1 << 63), "words": text.count(" ") + 1})
    return out


def parse(text: str | None) -> tuple[str, list[dict], list[dict], int, int]:
    lines = levels(text or "")
    found = passages(lines)
    quoted = [p for p in found if p[0]]
    own = "\n".join(line for level, line in lines if not level).strip()
    return own, units(quoted), units([p for p in found if not p[0]]), len(quoted), max((p[0] for p in quoted), default=0)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, quoted, written, n, deepest = zip(*map(parse, batch.column(2).to_pylist())) if batch.num_rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(quoted, _UNITS), pa.array(written, _UNITS),
            pa.array(n, pa.int32()), pa.array(deepest, pa.int32()),
        ], names=["scope", "at", "own", "quoted", "written", "n_passages", "max_level"])


def _roots(parents: DataFrame) -> DataFrame:
    """(scope, at, root, depth) of every message with a parent, by pointer doubling.

    A message that points to a root is done; only the others look further, up to the pointers
    of all as they are now, so a round joins those deeper than twice the depth of the one before.
    """
    up = moving = staged(parents.select("scope", "at", F.col("parent").alias("root"), F.lit(1).alias("depth")), "ancestors")
    done: DataFrame | None = None
    while not moving.isEmpty():
        further = up.select(F.col("scope").alias("_s"), F.col("at").alias("_a"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        looked = staged(
            moving.join(further, same([F.col("scope"), F.col("root")], [F.col("_s"), F.col("_a")]), "left").select(
                "scope", "at", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved"),
            ), "ancestors",
        )
        ended, moving = looked.filter("NOT moved").drop("moved"), looked.filter("moved").drop("moved")
        done = ended if done is None else done.union(ended)
        up = done.union(moving)
    return up if done is None else done


def linked_conversations(
    messages: DataFrame, scope_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
) -> DataFrame:
    """One row per message: (scope, at, parent, root, depth, position, n_passages, n_linked, max_level, text).

    ``at`` is the order of a message inside its scope. A quoted unit belongs to the earliest message
    of the scope that wrote it (not quoted it), which must be earlier than the quoting one. The
    parent wrote most words of the first quote level; ties go to the later message. Without a parent a message is
    the root of its thread at depth 0. ``position`` counts a thread's messages from 0; answers come
    after what they answer. ``text`` is the message without quotes and attribution lines.
    A null scope is a scope; a message without an order neither finds nor becomes a parent and comes
    first. A null text is empty. Rows that repeat (scope, order) are kept and get the same parent.
    """
    rows = messages.select(
        F.col(f"`{scope_col}`").cast("long").alias("scope"), F.col(f"`{order_col}`").cast("long").alias("at"), F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    parsed = staged(rows.mapInArrow(_parse, f"scope long, at long, {PARSED}"), "messages")
    # One row per unit and conversation, so neither a frequent phrase nor a long conversation multiplies rows.
    first = (
        parsed.select("scope", "at", F.explode("written").alias("u")).groupBy("scope", F.col("u.hash").alias("hash")).agg(F.min("at").alias("origin"))
        .filter("origin IS NOT NULL").withColumnRenamed("scope", "_scope").withColumnRenamed("hash", "_hash")
    )
    quoted = parsed.select("scope", "at", F.explode("quoted").alias("u")).select("scope", "at", "u.*")
    found = quoted.join(first, same([F.col("scope"), F.col("hash")], [F.col("_scope"), F.col("_hash")])).filter("origin < at")
    votes = found.groupBy("scope", "at", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("words")).otherwise(0)).alias("words"), F.count("*").alias("n"))
    parents = staged(
        votes.groupBy("scope", "at").agg(
            F.max(F.when(F.col("words") > 0, F.struct("words", "origin"))).alias("best"), F.count("*").cast("int").alias("n_linked"),
        ).select("scope", "at", F.col("best.origin").alias("parent"), "n_linked"), "parents",
    )
    roots = _roots(parents.filter("parent IS NOT NULL"))
    keys = [F.col("scope"), F.col("at")]
    placed = staged(
        parsed.select("scope", "at", "own", "n_passages", "max_level")
        .join(parents.select(F.col("scope").alias("_ps"), F.col("at").alias("_pa"), "parent", "n_linked"), same(keys, [F.col("_ps"), F.col("_pa")]), "left")
        .join(roots.select(F.col("scope").alias("_rs"), F.col("at").alias("_ra"), "root", "depth"), same(keys, [F.col("_rs"), F.col("_ra")]), "left")
        .select(
            "scope", "at", "parent", F.coalesce("root", "at").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
            "n_passages", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "max_level", F.col("own").alias("text"),
        )
        .withColumn("_thread", F.struct("scope", "root")).withColumn("_cell", F.floor(F.coalesce("at", F.lit(0)) / 1024)), "threads",
    )
    return numbered(placed, "_thread", "_cell", ["at", "text"], "position").drop("_thread", "_cell")


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Mail-like messages derived from plain conversations: turns that quote what they answer.

    Every third turn answers the turn before the last, the others the last one; the answered turn
    is quoted at level 1 and what it answered at level 2, as mail programs do. One message per
    row: where turns repeat, the one whose text sorts first is quoted; rows without a turn quote
    nothing and are not quoted. A null conv_id is a conversation, a null text is empty.
    """
    def answered(turn: Column) -> Column:
        return F.when(turn % 3 == 2, turn - 2).otherwise(turn - 1)

    turns = conversations.select("conv_id", "turn", "text")
    written = turns.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))

    def quoted(name: str) -> DataFrame:
        return written.select(F.col("conv_id").alias(f"_c{name}"), F.col("turn").alias(f"_t{name}"), F.coalesce("text", F.lit("")).alias(f"_x{name}"))

    def quote(text: str, mark: str):
        return F.concat(F.lit(mark), F.regexp_replace(F.col(text), "\n", f"\n{mark}"), F.lit("\n"))

    near = answered(F.col("turn"))
    joined = turns.withColumns({"_near": near, "_far": answered(near)}).join(
        quoted("1"), F.col("conv_id").eqNullSafe(F.col("_c1")) & (F.col("_near") == F.col("_t1")), "left",
    ).join(quoted("2"), F.col("conv_id").eqNullSafe(F.col("_c2")) & (F.col("_far") == F.col("_t2")) & F.col("_t1").isNotNull(), "left")
    return joined.select("conv_id", "turn", F.concat(
        F.when(F.col("_x1").isNotNull(), F.lit("On some day someone wrote:\n")).otherwise(""), F.coalesce(quote("_x2", "> > "), F.lit("")),
        F.coalesce(quote("_x1", "> "), F.lit("")), F.coalesce("text", F.lit("")),
    ).alias("text"))
