"""Prefix trie of conversations in tables of minimal perfect hashes.

Every prefix of a conversation has a digest, chained turn by turn; equal
prefixes have equal digests, so the distinct digests are the trie's nodes and
one grouping counts who passes through each. Nodes that few conversations
share are dealt to shards by their topmost such ancestor, so a shard holds
whole subtrees; the nodes above, at most ``crown`` by choice of the threshold,
are one more shard. A shard gives its n digests the slots 0 to n - 1 by a
minimal perfect hash; the digest stored in a slot tells a member from any
other key. Counts go into flat arrays by slot, a parent is the slot of its
digest, and subtree sums are accumulated from the deepest level upwards. What
the topmost nodes of the shards sum up to is the crown's input.

Defined cases: null role and text are empty; a conversation without turns ends
at the root; rows without conversation id belong to none; turns of one number
are ordered by role, then by digest, and equal ones are all kept; very long
conversations stream through a task turn by turn; other columns are ignored;
an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.llm.common import map_batches, stored

WORD = r"[^\x20\x09-\x0D]+"
ROOT, NONE = bytes(16), b"\xff" * 16


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn's role and text."""
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


# ------------------------------------------------------------------ paths
PATH = "conv long, depth long, node binary, parent binary, words long, last boolean"


def paths(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conversation's prefixes, one row each: the root (depth 0) first.

    ``ids``: ``conv`` and ``skip``, how many of its own turns to pass over;
    ``turns``: ``conv, given, turn, role, text``, those ``given`` come first."""
    none = F.lit(None)
    heads = ids.select("conv", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
                       none.cast("binary").alias("digest"), F.col("skip").cast("long").alias("words"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.select("conv", F.when(F.col("given"), 1).otherwise(2).alias("part"), F.col("turn").cast("long"), role.alias("role"),
                       turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = heads.unionByName(own).repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "digest")
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv", "depth", "node", "parent", "words", "last"]

    def run(batches):
        now, skip = None, 0       # the row that waits to know whether it is its conversation's last
        for b in batches:
            out = []
            cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv", "part", "digest", "words"))
            for conv, part, digest, words in zip(*cols, strict=True):
                if part == 0:
                    if now:
                        out.append((*now, True))
                    now, skip = (conv, 0, ROOT, NONE, 0), words
                elif part == 2 and skip:
                    skip -= 1
                else:
                    out.append((*now, False))
                    now = (conv, now[1] + 1, hashlib.blake2b(now[2] + digest, digest_size=16).digest(), now[2], words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*now, True), kinds)], names=names)

    return map_batches(rows, run, PATH)


# ------------------------------------------------------------------ tables
class Slots:
    """Minimal perfect hash of distinct 128-bit keys (two columns of unsigned
    64 bits): keys that meet no other in a level's array take the next slots,
    the others go on to the next level. ``keys`` verifies who owns a slot."""

    def __init__(self, keys: np.ndarray, room: float = 1.5):
        self.levels: list[np.ndarray] = []
        self.keys = np.empty_like(keys)
        left, taken = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = max(4, int(room * len(left)))
            at = self.place(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.full(size, -1, np.int64)
            level[at[alone]] = taken + np.arange(int(alone.sum()))
            self.keys[level[at[alone]]] = keys[left[alone]]
            self.levels.append(level)
            taken += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table."""
        slot, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, level in enumerate(self.levels):
            got = level[self.place(keys[left], i, len(level))]
            slot[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        known = slot >= 0
        known[known] = (self.keys[slot[known]] == keys[known]).all(axis=1)
        return np.where(known, slot, -1)


def words128(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


NODE = "shard long, node binary, parent binary, depth long, conv long, n long, words long, kids long, leaves long, saved long"
DONE = ("conv long, depth long, node binary, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "up binary")


def accumulated(t: pa.Table) -> pa.Table:
    """Subtree sums of one shard. ``kids``, ``leaves`` and ``saved`` bring what
    subtrees in other shards hang below a node; ``up`` names a parent that is
    not in the shard."""
    col = lambda c: t.column(c).to_numpy()
    key = words128(t.column("node"))
    slots = Slots(key)
    slot, up = slots(key), slots(words128(t.column("parent")))
    n, inside = t.num_rows, up >= 0
    row = np.empty(n, np.int64)
    row[slot] = np.arange(n)                     # the row in each slot
    flat = lambda c: col(c)[row].copy()          # noqa: E731
    parent, depth, conv = up[row], flat("depth"), flat("conv")
    kids = flat("kids") + np.bincount(up[inside], minlength=n)
    leaves = flat("leaves") + (kids == 0)
    saved = flat("saved") + (flat("n") - 1) * flat("words")
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    none = parent < 0
    names = t.column("node").take(pa.array(row)), t.column("parent").take(pa.array(row))
    above = names[1].to_numpy(zero_copy_only=False)
    return pa.table({
        "conv": conv, "depth": depth, "node": names[0], "parent_conv": pa.array(conv[parent], mask=none), "n_convs": flat("n"),
        "n_children": kids, "n_leaves": leaves, "saved_tokens": saved,
        "up": pa.array(np.where(none & (depth > 0), above, None), pa.binary())})


def crown_size(rows: int, most: int = 65_536) -> int:
    """Nodes allowed above the shards: the square root balances the crown and
    the largest subtree below it; ``most`` bounds what is broadcast."""
    return min(most, max(64, 4 * math.isqrt(rows)))


def trie(own: DataFrame, crown: int | None = None, shard_rows: int = 250_000) -> DataFrame:
    """Nodes of the trie of stored :func:`paths`: smallest member, depth, the
    parent's smallest member, members, children, leaves and savings below."""
    spark = own.sparkSession
    one = [F.min(c).alias(c) for c in ("depth", "parent", "words")]
    sure = (F.min("depth") == F.max("depth")) & (F.min("parent") == F.max("parent")) & (F.min("words") == F.max("words"))
    nodes = own.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), *one, sure.alias("sure"))
    nodes = stored(nodes, "trie-nodes")
    rows, count, odd = nodes.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(~F.col("sure"))).first()
    if odd:
        raise ValueError("two prefixes have one digest")
    rows = rows or 0
    few = -(-rows // (crown or crown_size(rows)))       # at most rows / few nodes have more members
    high = nodes.where(F.col("n") > few)
    # the topmost low node of each conversation names the subtree of the nodes that the conversation stands for
    top = (own.join(F.broadcast(high.select("node")), "node", "left_anti").groupBy("conv")
           .agg(F.min_by("node", "depth").alias("top")))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // shard_rows)
    fresh = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    columns = [c.split()[0] for c in NODE.split(", ")]
    low = (nodes.where(F.col("n") <= few).join(top, "conv")
           .select("*", F.pmod(F.xxhash64("top"), F.lit(shards)).alias("shard"), *fresh).select(*columns))
    below = stored(low.groupBy("shard").applyInArrow(accumulated, DONE), "trie-low")
    sums = (below.where("up IS NOT NULL").groupBy(F.col("up").alias("node"))
            .agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    over = (high.join(sums, "node", "left").na.fill(0, ["kids", "leaves", "saved"])
            .withColumn("shard", F.lit(0).cast("long")).select(*columns))
    above = stored(over.groupBy("shard").applyInArrow(accumulated, DONE), "trie-high")
    names = F.broadcast(above.select(F.col("node").alias("up"), F.col("conv").alias("up_conv")))
    below = below.join(names, "up", "left").withColumn("parent_conv", F.coalesce("parent_conv", "up_conv"))
    return above.drop("up").unionByName(below.drop("up", "up_conv"))


# -------------------------------------------------------------------- ends
def end_digests(own: DataFrame, bits: int = 16) -> DataFrame:
    """For each node where conversations end, SHA-256 of their ids, ascending
    and comma-joined. Ids are joined by ranges of 2**bits of them, so a node
    where very many end is never one group; then the ranges stream through."""
    block = F.shiftright("conv", bits)
    ends = own.where("last").groupBy("node", block.alias("block")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    ends = ends.select("node", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ends = ends.repartition("node").sortWithinPartitions("node", "block")

    def run(batches: Iterator[pa.RecordBatch]):
        now, h = None, None
        for b in batches:
            out = []
            for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    return map_batches(ends, run, "node binary, ends_sha256 string")


# ------------------------------------------------------------------- query
def borrowed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's rebuilt conversations as input of :func:`paths`: the first
    h = crc32(id) % 4 turns come from the conversation with id - id % 20."""
    src = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                               F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    h = F.crc32(F.col("conv").cast("string")) % 4
    ids = src.select("conv").distinct().select("conv", h.alias("skip"))
    # turns that others may borrow: the first three of each giver, narrow until they are chosen
    giver = F.col("conv") % 20 == 0

    order = Window.partitionBy("conv").orderBy("turn", "role", turn_digest(F.col("role"), F.col("text")))
    first = src.where(giver).withColumn("place", F.row_number().over(order)).where("place <= 3")
    wide = F.explode(F.sequence(F.col("conv") - 19, F.col("conv") + 19))
    lent = first.select("place", "turn", "role", "text", F.col("conv").alias("giver"), wide.alias("conv"))
    lent = lent.where((F.col("conv") - F.col("conv") % 20 == F.col("giver")) & (F.col("place") <= h)).join(ids.select("conv"), "conv", "left_semi")
    return ids, (src.select("conv", F.lit(False).alias("given"), "turn", "role", "text")
                 .unionByName(lent.select("conv", F.lit(True).alias("given"), "turn", "role", "text")))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """Query view: one row per node of the rebuilt conversations."""
    own = stored(paths(*borrowed(conversations)), "trie-paths")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (trie(own).join(end_digests(own), "node", "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256")))
