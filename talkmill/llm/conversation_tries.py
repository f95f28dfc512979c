"""The prefix trie of all conversations, built from burst containers.

A conversation is the sequence of its turns, a turn the digest of its role and text; equal
sequences are counted once. All sequences start in one container under the root. A container that
holds too many suffixes bursts: its trie head grows to where its suffixes part, and each next turn
gets a container of its own; sequences that end at the head stay there. When no container is
oversized, each is sorted, and one sweep with a stack of open nodes writes its nodes. What a sweep
keeps is the open path and the finished children of its nodes. Heads are few; their numbers are
summed from the containers below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkmill.llm.common import by_value, same, staged

by_value(__name__)

#: Bytes of a turn digest.
STEP = 16
#: Different suffixes a container holds before it bursts.
CONTAINER = 4096
#: Conversation ids that share the start of one of them, when conversations are rebuilt, and the most turns shared.
BLOCK, SHARED = 20, 3
#: Oversized containers of one round, up to which they are sent to all executors.
FEW = 10_000
#: Characters of ids hashed in one go.
CHUNK = 1 << 20

WORDS = r"[^\x20\x09-\x0D]+"
NODE = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, turn_id string, path binary, words array<int>"
)
_NAMES = [f.split()[0] for f in NODE.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32())]
_PUBLIC = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
#: Digest of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, id, words): turns with the digest of role and text, in hexadecimal; null role or text is empty.

    Rows without a conversation id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    return conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("id"),
        F.regexp_count(text, F.lit(WORDS)).cast("int").alias("words"),
    )


def _in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) by turn, null first; turns of one number by digest."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "words"))).alias("turns"))


def _paths(sequences: DataFrame) -> DataFrame:
    return sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"),
    )


def as_written(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): the turn digests of each conversation in order, joined, and the words of its turns."""
    return _paths(_in_order(turns))


def sharing_starts(turns: DataFrame) -> DataFrame:
    """As :func:`as_written`, after h turns of each conversation c gave way to the first h of conversation c - c % BLOCK.

    h is crc32 of the decimal id modulo SHARED + 1. Where that conversation is shorter, all its
    turns come; where it is absent, none. A conversation may be left without turns.
    """
    def h(c: str) -> Column:
        return (F.crc32(F.col(c).cast("string").cast("binary")) % (SHARED + 1)).cast("int")

    starts = _in_order(turns.where(F.col("conv_id") % BLOCK == 0)).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, SHARED).alias("_start"),
        F.explode(F.sequence(F.col("conv_id") - (BLOCK - 1), F.col("conv_id") + (BLOCK - 1))).alias("_conv"),
    ).where((F.col("_conv") - F.col("_conv") % BLOCK == F.col("_base")) & (F.col("_conv") != F.col("_base")))
    own = _in_order(turns)
    joined = own.join(starts, F.col("conv_id") == F.col("_conv"), "left")
    # What conversations with an id divisible by BLOCK would give away is what they get.
    start = F.when(F.col("conv_id") % BLOCK == 0, F.slice("turns", F.lit(1), h("conv_id"))).otherwise(F.slice("_start", F.lit(1), h("conv_id")))
    rest = F.slice("turns", h("conv_id") + 1, F.size("turns"))
    return _paths(joined.select("conv_id", F.when(start.isNull(), rest).otherwise(F.concat(start, rest)).alias("turns")))


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (digest, id) to pieces of their comma-joined list."""
    def out(rows: list) -> pa.RecordBatch:
        k, first, ids = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.string())], names=["k", "first_id", "ids"])

    own, ids, size = None, [], 0
    rows, total = [], 0
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != own or size >= CHUNK:
                if ids:
                    rows.append((own, ids[0], ",".join(map(str, ids))))
                    total += size + 64
                own, ids, size = k, [], 0
                if total >= CHUNK:
                    yield out(rows)
                    rows, total = [], 0
            ids.append(i)
            size += 8
    if ids:
        rows.append((own, ids[0], ",".join(map(str, ids))))
    if rows:
        yield out(rows)


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, sha = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == own:
                sha.update(b",")
            else:
                if sha is not None:
                    done.append((own, sha.hexdigest()))
                own, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], names=["k", "ends"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([sha.hexdigest()])], names=["k", "ends"])


def _different(sequences: DataFrame) -> DataFrame:
    """(k, conv_id, n, path, words, ends): each sequence once, its smallest id, rows and the digest of its ids.

    A list of ids is written in pieces by the tasks that sort the ids; only those pieces meet, one
    after the other, in the task that hashes them.
    """
    keyed = sequences.withColumn("k", F.unhex(F.md5("path")))
    once = keyed.groupBy("k").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("words").alias("words"))
    pieces = keyed.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(_id_chunks, "k binary, first_id long, ids string")
    ends = pieces.repartition("k").sortWithinPartitions("k", "first_id").mapInArrow(_id_digests, "k binary, ends string")
    return once.join(ends, "k")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share at the start, by halving."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * STEP:middle * STEP] == b[low * STEP:middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


def _start(path: str, depth: str | Column) -> Column:
    """The first ``depth`` turns of a path."""
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.substring(F.col(path), F.lit(1), (depth * STEP).cast("int"))


def _burst(open_: DataFrame, container: int) -> DataFrame:
    """One round: rows with their new ``depth`` and ``state`` (closed, ended or open)."""
    @F.pandas_udf("int")
    def parting(first, last):
        return first.combine(last, _shared)

    sizes = open_.groupBy(_start("path", "depth").alias("_key")).agg(F.count("*").alias("_n"), F.min("path").alias("_first"), F.max("path").alias("_last"))
    over = staged(sizes.where(F.col("_n") > container).select("_key", parting("_first", "_last").alias("_parting")), "oversized")
    sent = F.broadcast(over) if over.limit(FEW + 1).count() <= FEW else over
    joined = open_.join(sent, _start("path", "depth") == F.col("_key"), "left")
    ends = F.length("path") == F.col("_parting") * STEP
    return joined.select(
        "conv_id", "n", "path", "words", "ends",
        F.when(F.col("_parting").isNull(), F.col("depth")).otherwise(F.col("_parting") + F.when(ends, 0).otherwise(1)).cast("int").alias("depth"),
        F.when(F.col("_parting").isNull(), "closed").when(ends, "ended").otherwise("open").alias("state"),
    )


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted containers to nodes (kind 0) and one row for the top of each container (kind 1)."""
    out: list[tuple] = []
    # An open node: [smallest id, members, children, leaves, saved below, digest of ends, words, finished children].
    stack: list[list] = []
    top, base, before = b"", 0, b""
    top_words: list[int] = []

    def finish() -> tuple:
        conv, n, children, leaves, saved, ends, words, below = stack.pop()
        depth = base + len(stack)
        leaves = leaves if children else 1
        saved += (n - 1) * words
        out.extend((*row[:3], conv, *row[4:]) for row in below)
        if stack:
            up = stack[-1]
            up[0], up[1], up[2], up[3], up[4] = min(up[0], conv), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved
            turn = before[(depth - 1) * STEP:depth * STEP].hex()
            up[7].append((0, conv, depth, None, n, children, leaves, saved, ends, turn, None, None))
        else:
            out.append((1, conv, depth, None, n, children, leaves, saved, ends, top[-STEP:].hex() or None, top, top_words))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    for batch in batches:
        for depth, path, words, conv, n, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if not stack or depth != base or path[:depth * STEP] != top:
                while stack:
                    finish()
                top, base, top_words = path[:depth * STEP], depth, words[:depth]
                stack.append([conv, 0, 0, 0, 0, NO_ENDS, words[depth - 1] if depth else 0, []])
                common = depth
            else:
                common = _shared(before, path)
            while len(stack) > common - base + 1:
                finish()
            before = path
            for d in range(common, len(words)):
                stack.append([conv, 0, 0, 0, 0, NO_ENDS, words[d], []])
            stack[-1][0], stack[-1][1], stack[-1][5] = min(stack[-1][0], conv), stack[-1][1] + n, ends
            if len(out) >= 8192:
                yield batch_of(out)
                out.clear()
    while stack:
        finish()
    if out:
        yield batch_of(out)


def _heads(tops: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes above the tops of containers, from what the containers and the sequences ending there bring."""
    brings = tops.select(
        "path", "words", (F.col("depth") - 1).alias("to"), F.col("n_convs").alias("n"), "conv_id", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("below"), F.lit(None).cast("string").alias("ends"),
    ).where("to >= 0").union(ended.select("path", "words", F.col("depth").cast("long"), "n", "conv_id", F.lit(0).cast("long"), F.lit(0).cast("long"), "ends"))
    each = brings.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to"))).alias("depth"))
    inner = staged(each.groupBy(_start("path", "depth").alias("head"), "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("below").alias("below"),
        F.max(F.when(F.col("depth") > 0, F.get("words", (F.col("depth") - 1).cast("int"))).otherwise(0)).alias("words"), F.max(F.when(F.col("depth") == F.col("to"), F.col("ends"))).alias("ends"),
    ), "heads")
    own = inner.select("head", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    saved = own.select("own", F.explode(F.sequence(F.lit(0).cast("long"), "depth")).alias("d"), "head").groupBy(_start("head", "d").alias("_s")).agg(F.sum("own").alias("_own"))
    under = inner.select("head", "depth").union(tops.select("path", "depth")).where("depth > 0")
    children = under.groupBy(_start("head", F.col("depth") - 1).alias("_h")).agg(F.count("*").alias("n_children"))
    parents = inner.select(F.col("head").alias("_p"), F.col("conv_id").alias("parent_conv_id"))
    nodes = inner.join(saved, F.col("head") == F.col("_s")).join(children, F.col("head") == F.col("_h")).select(
        "conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("below") + F.col("_own")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), F.col("head").alias("path"),
    ).unionByName(tops.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "path"))
    turn_id = F.when(F.col("depth") > 0, F.lower(F.hex(F.substring("path", -STEP, STEP))))
    up = F.when(F.col("depth") > 0, _start("path", F.col("depth") - 1))
    return nodes.withColumn("turn_id", turn_id).join(parents, up == F.col("_p"), "left").select(*_PUBLIC)


def prefix_trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_id).

    ``sequences`` has (conv_id, path, words) as :func:`as_written` gives them. A node is a different
    sequence of first turns, the root at depth 0 has none. conv_id is the smallest member, the
    parent's is null at the root; n_leaves counts the childless nodes of the subtree, saved_tokens
    sums (n_convs - 1) times the words of the last turn over it; ends_sha256 hashes the ids of the
    members that end at the node; turn_id is the digest of the last turn. Sequences without turns
    belong to the root alone; ids that repeat are members as often; without sequences there is no
    node. A whole sequence is one row: 20 bytes a turn, no texts.
    """
    different = staged(_different(staged(sequences, "sequences")), "different").drop("k")
    open_ = different.withColumn("depth", F.lit(0))
    closed: list[DataFrame] = []
    ended = different.withColumn("depth", F.lit(0)).limit(0)
    while not open_.isEmpty():
        round_ = staged(_burst(open_, container), "containers")
        closed.append(round_.where("state = 'closed'").drop("state"))
        ended = ended.union(round_.where("state = 'ended'").select(ended.columns))
        open_ = round_.where("state = 'open'").drop("state")
    rows = open_
    for more in closed:
        rows = rows.unionByName(more)
    sorted_ = rows.withColumn("_key", _start("path", "depth")).repartition("_key").sortWithinPartitions("_key", "path")
    swept = staged(sorted_.select("depth", "path", "words", "conv_id", "n", "ends").mapInArrow(_sweep, NODE), "nodes")
    return swept.where("kind = 0").select(*_PUBLIC).unionByName(_heads(swept.where("kind = 1"), ended))
