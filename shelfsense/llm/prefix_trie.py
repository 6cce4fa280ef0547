"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards, which are ranges of their ids with a bounded number of
conversations and turns. Within a shard every (position, turn) has a bitset of the conversations
that hold it. From the root, whose members are all, a node's children come by intersecting its
bitset with the posting of the next turn of its first remaining member, until no member remains;
that is one intersection per child. Popcounts and lists of the conversations that end at a node
are per shard, and meet under the node's key, a hash chained along its turns.

Sums over subtrees need no second look at the tree: a node belongs to its smallest member, the
nodes of a conversation's path that belong to it are the lowest ones, so a sum over a subtree is
the sum of its members' totals less the owner's part above the node.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import spread_join, stored

#: Conversations and turns of a shard at most; a longer conversation is a shard of its own.
CONVERSATIONS, TURNS = 4096, 65_536
#: Rows handed on together.
ROWS = 8192
ROOT = b"\0" * 16

NODE = "node binary, parent binary, depth bigint, words bigint, first bigint, members bigint, weight bigint, leaves bigint, ends string"


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``turn`` (128 bits over role and text) and ``words`` of every turn.

    Turns are ordered by ``turn``, null first, and equal ones by the hash of role and text. Null
    roles and texts are empty. Rows without a conversation id are no conversation's turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    narrow = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("place"),
        F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("turn"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("place").asc_nulls_first(), "turn")
    return narrow.select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), "turn", "words")


def branched(turns: DataFrame, family: int = 20, widest: int = 4) -> DataFrame:
    """Conversations that begin like the first of their family.

    Conversation c is the first h turns of c - c % family, then its own after its first h, with
    h = crc32(c) % widest. Sequences are ordered by ``part`` and ``pos``; every conversation also
    has a row with part 0 and no turn, so that one without turns is not lost.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % widest
    everyone = turns.where("pos = 1").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h")
    )
    # At most widest - 1 rows of a family's first conversation, at most 2 * family - 1 conversations to take them.
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < widest)).withColumnRenamed("conv_id", "base")
    borrowed = everyone.join(heads, "base").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "turn", "words")
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(2).alias("part"), "pos", "turn", "words")
    top = everyone.select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("pos"),
        F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("words"),
    )
    return top.union(borrowed).union(own)


def _child(node: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(node + turn, digest_size=16).digest()


class Conversation:
    """Turns (hash, words) of one id; ``weight`` and ``leaf`` are summed over the members of nodes."""

    __slots__ = ("conv_id", "turns", "weight", "leaf")

    def __init__(self, conv_id: int, weight: int, leaf: int):
        self.conv_id, self.turns, self.weight, self.leaf = conv_id, [], weight, leaf


def shard_nodes(shard: list[Conversation]):
    """Rows (as NODE) of the trie of some conversations, which are in ascending order of id."""
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    leaves = 0
    for rank, conversation in enumerate(shard):
        bit = 1 << rank
        for at, (turn, _) in enumerate(conversation.turns):
            postings[at, turn] = postings.get((at, turn), 0) | bit
        ending[len(conversation.turns)] = ending.get(len(conversation.turns), 0) | bit
        leaves |= bit * conversation.leaf
    found: list[list] = []
    open_nodes = [(0, (1 << len(shard)) - 1, ROOT, None, 0, -1)]
    while open_nodes:
        depth, members, node, parent, words, above = open_nodes.pop()
        ends = members & ending.get(depth, 0)
        weight, listed, rest = 0, [], ends
        while rest:
            low = rest & -rest
            last = shard[low.bit_length() - 1]
            weight += last.weight
            listed.append(last.conv_id)
            rest ^= low
        here, rest = len(found), members ^ ends
        first = shard[(members & -members).bit_length() - 1].conv_id
        text = ",".join(map(str, listed)) if listed else None
        found.append([node, parent, depth, words, first, members.bit_count(), weight, (members & leaves).bit_count(), text, above])
        while rest:
            turn, spoken = shard[(rest & -rest).bit_length() - 1].turns[depth]
            child = members & postings[depth, turn]
            rest ^= child
            open_nodes.append((depth + 1, child, _child(node, turn), node, spoken, here))
    for row in reversed(found):
        if row[9] >= 0:
            found[row[9]][6] += row[6]
    return (row[:9] for row in found)


def _path(head: Conversation, rest):
    """Rows of a conversation alone, a turn at a time: ``rest`` goes on where its turns stop."""
    node, parent, depth, words = ROOT, None, 0, 0
    for turns in (head.turns, rest):
        for turn, spoken in turns:
            yield [node, parent, depth, words, head.conv_id, 1, head.weight, head.leaf, None]
            node, parent, depth, words = _child(node, turn), node, depth + 1, spoken
    yield [node, parent, depth, words, head.conv_id, 1, head.weight, head.leaf, str(head.conv_id)]


def partition_nodes(rows):
    """NODE rows of all shards of a sorted partition of (conv_id, turn, words, weight, leaf)."""
    from itertools import chain, groupby

    shard, size = [], 0
    for conv_id, group in groupby(rows, key=lambda row: row[0]):
        _, _, _, weight, leaf = next(group)  # the row without a turn comes first
        conversation = Conversation(conv_id, weight, leaf)
        for _, turn, words, _, _ in group:
            conversation.turns.append((turn, words))
            if len(conversation.turns) > TURNS:
                break
        if shard and (len(shard) >= CONVERSATIONS or size + len(conversation.turns) > TURNS):
            yield from shard_nodes(shard)
            shard, size = [], 0
        if len(conversation.turns) > TURNS:
            yield from _path(conversation, ((turn, words) for _, turn, words, _, _ in chain(group)))
        else:
            shard.append(conversation)
            size += len(conversation.turns)
    if shard:
        yield from shard_nodes(shard)


def _nodes(sequences: DataFrame) -> DataFrame:
    """Partial nodes of all shards of ``sequences``, whose rows without a turn have weight and leaf."""

    def work(batches):
        import pyarrow as pa

        names = [field.split()[0] for field in NODE.split(", ")]
        types = [pa.binary()] * 2 + [pa.int64()] * 6 + [pa.string()]

        def rows():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        def packed(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        held = []
        for row in partition_nodes(rows()):
            held.append(row)
            if len(held) >= ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    ranged = sequences.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ranged.select("conv_id", "turn", "words", "weight", "leaf").mapInArrow(work, NODE)


def _digests(parts: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256``: the lists of a node's shards, hashed one after the other."""

    def work(batches):
        import pyarrow as pa

        def packed(done):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["node", "ends_sha256"])

        now, state, done = None, None, []
        for batch in batches:
            for node, ends in zip(*(column.to_pylist() for column in batch.columns)):
                if node != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
                if len(done) >= ROWS:
                    yield packed(done)
                    done = []
        if now is not None:
            done.append((now, state.hexdigest()))
        if done:
            yield packed(done)

    placed = parts.repartition("node").sortWithinPartitions("node", "first_end")
    return placed.select("node", "ends").mapInArrow(work, "node binary, ends_sha256 string")


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """A row per node of the trie of ``sequences`` (as ``branched`` makes them).

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null at the root). Equal
    sequences share all nodes. Without conversations there is no node. The list of the
    conversations that end at a node is hashed in one pass in one task, from one text per shard,
    as SHA-256 cannot be merged; nothing of it is held.
    """
    sequences = stored(sequences, "sequences")
    plain = sequences.withColumns({"weight": F.lit(0).cast("bigint"), "leaf": F.lit(0)})
    nodes = stored(
        _nodes(plain).groupBy("node", "parent", "depth", "words")
        .agg(F.min("first").alias("conv_id"), F.sum("members").alias("n_convs")),
        "nodes",
    )
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    before = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = stored(
        nodes.join(children.withColumnRenamed("parent", "node"), "node", "left")
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "saved": saved})
        .withColumn("above", F.coalesce(F.sum("saved").over(before), F.lit(0).cast("bigint"))),
        "nodes",
    )
    # The totals of an owner go to the one row of its conversation without a turn.
    owners = nodes.groupBy("conv_id").agg(F.sum("saved").alias("weight"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    none = {"weight": F.lit(0).cast("bigint"), "leaf": F.lit(0)}
    weighted = (
        sequences.where("part = 0").join(owners, "conv_id", "left").na.fill(0, ["weight", "leaf"])
        .unionByName(sequences.where("part > 0").withColumns(none))
    )
    parts = stored(_nodes(stored(weighted, "sequences")).select("node", "first", "weight", "leaves", "ends"), "parts")
    sums = parts.groupBy("node").agg(F.sum("weight").alias("weight"), F.sum("leaves").alias("n_leaves"))
    first_end = F.split("ends", ",", 2)[0].cast("bigint")
    ends = _digests(parts.where("ends is not null").select("node", first_end.alias("first_end"), "ends"))
    parents = nodes.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held")
    )
    named = spread_join(
        nodes.where("parent is not null").select("node", "parent"), parents, "parent", "held", nodes.count()
    ).select("node", "parent_conv_id")
    return (
        nodes.join(sums, "node").join(ends, "node", "left").join(named, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("weight") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, family: int = 20, widest: int = 4) -> DataFrame:
    """The trie of the branched conversations of a table of turns (conv_id, turn, role, text).

    Nulls, ties and rows without an id as in ``turns_of``; whole texts, however long, are hashed
    and counted where they lie. An empty table gives no nodes; other columns are ignored.
    """
    return trie_nodes(branched(stored(turns_of(conversations), "turns"), family, widest))
