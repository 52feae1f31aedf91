"""Prefix trie of conversations, from tables of nodes addressed by minimal perfect hashes.

A node is a distinct sequence of first turns. It is named by a digest: 128
bits, four sums modulo 2^32 over one 32-bit number per turn, each made from
the SHA-256 of the turn's place, role and text. Sums compose, so prefix
digests need no pass along a conversation, and a prefix less its last turn
names the parent.

**Shards.** Turns, without their texts, are range-partitioned by
(conversation, place) and written once. A range partition is a shard: about
as many turns in each, however long a conversation is or however many share
it. What a conversation has in earlier shards (its turns, the sums of its
digest) and in later ones (what its own nodes add to their ancestors) is
carried over from a table with one row per shard and conversation cut by its
borders.

**Node tables.** A shard enumerates its distinct prefix digests and gives
each a slot by a minimal perfect hash; the digest kept at the slot tells
whether a looked-up one is really there. Counts and smallest members are
scattered into flat numpy arrays by slot. The shards' nodes add up to the
nodes of the trie.

**Subtrees.** A node belongs to its smallest member; the nodes of one
conversation are the lower end of its path. Each shard scatters what its own
nodes add (leaves, saved tokens) into an array by slot and adds it up
through the array of parent slots, deepest nodes first. Every node of a
subtree is a member's own, and lies on that member's path, so the sum of the
shards' values is the subtree's.

Only shuffles of narrow rows are needed: one by range, and aggregates that
are combined in the shard before. The ids of the conversations that end in
a node are joined to text by the shards, in order, and streamed into the
node's SHA-256, which only one task can do; it reads one row per shard.

Turns are ordered by turn (NULL first), then by digest of role and text.
Null role or text is empty. Rows without conversation id belong to no
conversation. Repeated turns are turns of their own. An empty table has no
nodes. Very long texts only count words and make one digest. Other columns
are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshift.llm.common import SPACE, stored
from lakeshift.session import ship_package

HEADER, BASE, OWN = 0, 1, 2


# ---- the minimal perfect hash -------------------------------------------------------------------------------------

def mixed(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit hash per digest and level."""
    h = lo ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
    for part in (hi, np.uint64(level)):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27)) ^ part) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class NodeTable:
    """Slots 0 .. n-1 for n distinct 128-bit digests.

    Level by level, the keys left are hashed into two places each; those that
    are alone in theirs stay, the others go on. A key's slot is the rank of
    its place among the taken ones, so the table is minimal: no slot is free.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        """From digests that may repeat."""
        keys = np.unique(np.stack([hi, lo], 1), axis=0)
        hi, lo = keys[:, 0], keys[:, 1]
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        done, left = 0, np.arange(len(hi))
        while len(left):
            size = 2 * len(left) + 1
            place = (mixed(hi[left], lo[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(taken) - 1
            alone = taken[place]
            slots = done + rank[place[alone]]
            self.hi[slots], self.lo[slots] = hi[left[alone]], lo[left[alone]]
            self.levels.append((size, taken, rank, done))
            done += int(alone.sum())
            left = left[~alone]

    def __len__(self) -> int:
        return len(self.hi)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that the table does not hold."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (size, taken, rank, done) in enumerate(self.levels):
            place = (mixed(hi[left], lo[left], level) % np.uint64(size)).astype(np.int64)
            here = taken[place]
            out[left[here]] = done + rank[place[here]]
            left = left[~here]
        found = np.flatnonzero(out >= 0)
        wrong = (self.hi[out[found]] != hi[found]) | (self.lo[out[found]] != lo[found])
        out[found[wrong]] = -1
        return out


def accumulate(parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> None:
    """Add each slot's values to its parent's, deepest slots first."""
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        part = part[parent[part] >= 0]
        for v in values:
            np.add.at(v, parent[part], v[part])


# ---- turns ---------------------------------------------------------------------------------------------------------

def digest_parts(digest: Column) -> list[Column]:
    """Four 32-bit numbers from the first 32 hex digits of ``digest``."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv_id, turn, content, words)``: turns without their texts."""
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    framed = F.concat(F.length(plain(role)).cast("string"), F.lit(":"), plain(role), plain(text))
    return conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.substring(F.sha2(framed, 256), 1, 32).alias("content"),
        F.regexp_count(plain(text), F.lit(SPACE.replace("[", "[^") + "+")).cast("long").alias("words"))


def shared_turns(conv_id: Column, most: int) -> Column:
    """How many first turns a conversation takes from another."""
    return (F.crc32(conv_id.cast("string")) % (most + 1)).cast("int")


def rebuilt(turns: DataFrame, every: int, most: int) -> DataFrame:
    """``(conv_id, kind, turn, content, words)``: a header, the turns taken from the base, and all own turns.

    The base of ``c`` is ``c - c % every``. Only the first ``most`` turns of
    a base are ever taken; a rank limit keeps as many of each in a task
    before they are shuffled.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "content")
    heads = (turns.filter(F.col("conv_id") % every == 0).withColumn("at", F.row_number().over(first))
             .filter(F.col("at") <= most).select(F.col("conv_id").alias("base"), "at", "content", "words"))
    ids = turns.select("conv_id").distinct()
    given = (ids.withColumn("base", base).join(heads, "base").filter(F.col("at") <= shared_turns(F.col("conv_id"), most))
             .select("conv_id", F.lit(BASE).alias("kind"), F.col("at").cast("long").alias("turn"), "content", "words"))
    header = ids.select("conv_id", F.lit(HEADER).alias("kind"), F.lit(None).cast("long").alias("turn"),
                        F.lit("").alias("content"), F.lit(0).cast("long").alias("words"))
    own = turns.select("conv_id", F.lit(OWN).alias("kind"), "turn", "content", "words")
    return header.union(given).union(own)


def carried(pieces: DataFrame, names: list[str], later: bool = False) -> DataFrame:
    """``(shard, conv_id, names)``: sums over the other pieces of a conversation, earlier ones or later ones.

    ``pieces (shard, conv_id, names)`` may hold every conversation; rows are
    only made for those in several shards.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("shard") if later else F.asc("shard"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("shard", "conv_id", F.lag("shard").over(order).alias("_other"),
                         *[F.sum(n).over(before).alias(n) for n in names]).filter("_other is not null").drop("_other")


def cut_ids(rows: DataFrame) -> DataFrame:
    """Ids of the conversations that lie in more than one shard: fewer than there are shards."""
    ends = rows.groupBy("shard").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    both = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"), "shard")
    return both.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id")


def pieces_of(rows: DataFrame, *sums: Column) -> DataFrame:
    """``(shard, conv_id, sums)`` of the conversations that borders cut."""
    return rows.join(cut_ids(rows), "conv_id", "left_semi").groupBy("shard", "conv_id").agg(*sums)


def paths(turns: DataFrame, every: int, most: int, shard_rows: int) -> DataFrame:
    """``(shard, conv_id, depth, words, hi, lo, up_hi, up_lo)``: every prefix of every rebuilt conversation.

    ``hi, lo`` name the prefix, ``up_hi, up_lo`` its parent; the header is
    depth 0 and has the digest 0.
    """
    spark = turns.sparkSession
    rows = stored(rebuilt(turns, every, most), "turns")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard_rows))
    order = [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("content"), F.col("tie")]
    # equal turns are told apart, so that any number of them can be split
    ranged = stored(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order)
                    .withColumn("shard", F.spark_partition_id().cast("long")), "shards")

    along = Window.partitionBy("shard", "conv_id").orderBy(*order[1:])
    base, own = (F.col("kind") == BASE).cast("long"), (F.col("kind") == OWN).cast("long")
    before = carried(pieces_of(ranged, F.sum(base).alias("b"), F.sum(own).alias("o")), ["b", "o"])
    placed = (ranged.join(before, ["shard", "conv_id"], "left")
              .withColumn("b", F.coalesce("b", F.lit(0)) + F.sum(base).over(along))
              .withColumn("o", F.coalesce("o", F.lit(0)) + F.sum(own).over(along)))
    skip = shared_turns(F.col("conv_id"), most)
    kept = placed.filter((F.col("kind") != OWN) | (F.col("o") > skip))
    depth = F.col("b") + F.greatest(F.col("o") - skip, F.lit(0))
    kept = kept.select("shard", "conv_id", "words", depth.alias("depth"),
                       F.sha2(F.concat(depth.cast("string"), F.lit(":"), "content"), 256).alias("step"))
    steps = [F.when(F.col("depth") > 0, part).otherwise(F.lit(0)).alias(f"s{i}")
             for i, part in enumerate(digest_parts(F.col("step")))]
    kept = stored(kept.select("shard", "conv_id", "depth", "words", *steps), "steps")

    named = [f"s{i}" for i in range(4)]
    above = carried(pieces_of(kept, *[F.sum(s).alias(f"c{s}") for s in named]), [f"c{s}" for s in named])
    deep = Window.partitionBy("shard", "conv_id").orderBy("depth")
    whole = kept.join(above, ["shard", "conv_id"], "left")
    modulus = F.lit(1 << 32)
    lanes = [((F.coalesce(f"c{s}", F.lit(0)) + F.sum(s).over(deep)) % modulus).alias(f"l{i}")
             for i, s in enumerate(named)]
    out = whole.select("shard", "conv_id", "depth", "words", *named, *lanes)
    before_it = [F.pmod(F.col(f"l{i}") - F.col(s), modulus) for i, s in enumerate(named)]
    now = [F.col(f"l{i}") for i in range(4)]
    halves = [F.shiftleft(part[i], 32).bitwiseOR(part[i + 1]) for part in (now, before_it) for i in (0, 2)]
    return stored(out.select("shard", "conv_id", "depth", "words",
                             *[h.alias(n) for h, n in zip(halves, ("hi", "lo", "up_hi", "up_lo"))]), "paths")


# ---- shards --------------------------------------------------------------------------------------------------------

def digests(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of signed longs as unsigned numbers."""
    return [table[name].to_numpy().view(np.uint64) for name in names]


def last_rows(conv: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Row of the deepest node of each conversation, in ascending order of ids."""
    order = np.lexsort((depth, conv))
    return order[np.append(np.flatnonzero(np.diff(conv[order])), len(order) - 1)]


NODE_SCHEMA = ("shard long, hi long, lo long, up_hi long, up_lo long, depth long, words long, n long, conv_id long, "
               "ends string")


def shard_nodes(rows: pa.Table, goes_on: pa.Table) -> pa.Table:
    """The nodes of one shard: members, smallest member, ids that end there.

    ``goes_on (at, cut)`` has the conversation, if any, whose last turns are in a later shard.
    """
    hi, lo, up_hi, up_lo = digests(rows, "hi", "lo", "up_hi", "up_lo")
    conv, depth, words = (rows[c].to_numpy() for c in ("conv_id", "depth", "words"))
    table = NodeTable(hi, lo)
    slot, n = table.slots(hi, lo), len(table)
    members = np.bincount(slot, minlength=n)
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, conv)
    some = np.empty(n, np.int64)
    some[slot] = np.arange(len(slot))  # any row of a node has its depth, words and parent
    ends = last_rows(conv, depth)
    ends = ends[~np.isin(conv[ends], goes_on["cut"].to_numpy())]
    by_slot = ends[np.argsort(slot[ends], kind="stable")]
    text: list[str | None] = [None] * n
    for part in np.split(by_slot, np.flatnonzero(np.diff(slot[by_slot])) + 1):
        if len(part):
            text[slot[part[0]]] = ",".join(map(str, conv[part].tolist()))
    numbers = {"shard": rows["shard"].to_numpy()[some], "hi": table.hi.view(np.int64), "lo": table.lo.view(np.int64),
               "up_hi": up_hi[some].view(np.int64), "up_lo": up_lo[some].view(np.int64), "depth": depth[some],
               "words": words[some], "n": members, "conv_id": first}
    return pa.table({**numbers, "ends": pa.array(text, pa.string())})


def shard_subtrees(rows: pa.Table, added: pa.Table) -> pa.Table:
    """What the nodes of one shard hold below them, from ``added (at, owner, deep, leaves, saved)``.

    ``deep`` NULL marks what lies below a conversation's deepest turn here.
    A conversation that began in an earlier shard has a table of its own: its
    values go up to its first turn here, and the carry takes them on.
    """
    conv, depth = rows["conv_id"].to_numpy(), rows["depth"].to_numpy()
    hi, lo, up_hi, up_lo = digests(rows, "hi", "lo", "up_hi", "up_lo")
    order = np.lexsort((depth, conv))
    ids, start = np.unique(conv[order], return_index=True)
    stop = np.append(start[1:], len(order))
    which = np.searchsorted(ids, added["owner"].to_numpy())
    # a conversation's depths in a shard have no gaps
    place = added["deep"].fill_null(-1).to_numpy() - depth[order[start[which]]] + start[which]
    row = order[np.where(added["deep"].is_null().to_numpy(), stop[which] - 1, place)]
    values = np.zeros((2, len(conv)), np.int64)
    np.add.at(values[0], row, added["leaves"].to_numpy())
    np.add.at(values[1], row, added["saved"].to_numpy())
    began_before = (conv == ids[0]) & (depth[order[0]] > 0)
    out = []
    for chosen in (began_before, ~began_before):
        if not chosen.any():
            continue
        table = NodeTable(hi[chosen], lo[chosen])
        slot = table.slots(hi[chosen], lo[chosen])
        parent, deep = np.empty(len(table), np.int64), np.empty(len(table), np.int64)
        parent[slot], deep[slot] = table.slots(up_hi[chosen], up_lo[chosen]), depth[chosen]
        parent[deep == 0] = -1
        leaves, saved = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        np.add.at(leaves, slot, values[0, chosen])
        np.add.at(saved, slot, values[1, chosen])
        accumulate(parent, deep, leaves, saved)
        full = np.flatnonzero((leaves != 0) | (saved != 0))
        out.append(pa.table({"hi": table.hi[full].view(np.int64), "lo": table.lo[full].view(np.int64),
                             "n_leaves": leaves[full], "saved_tokens": saved[full]}))
    return pa.concat_tables(out)


# ---- the trie ------------------------------------------------------------------------------------------------------

def end_hashes(parts: DataFrame) -> DataFrame:
    """``(hi, lo, ends_sha256)`` from ``parts (hi, lo, shard, ends)``, streamed in order of shards."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def done(found: list[tuple]) -> pa.RecordBatch:
            hi, lo, hashes = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                               pa.array(hashes, pa.string())], ["hi", "lo", "ends_sha256"])

        for batch in batches:
            found = []
            for name, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                if name == node:
                    state.update(b",")
                else:
                    if node is not None:
                        found.append((*node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                state.update(text.as_py().encode())
            yield done(found)
        if node is not None:
            yield done([(*node, state.hexdigest())])

    return (parts.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "shard").select("hi", "lo", "ends")
            .mapInArrow(kernel, "hi long, lo long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 3, shard_rows: int = 500_000,
                conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Conversation ``c`` starts with the first ``crc32(c) % (most + 1)`` turns
    of conversation ``c - c % every``, in place of as many turns of its own.
    ``shard_rows`` bounds what one task holds in memory.
    """
    ship_package(conversations.sparkSession)
    rows = paths(turns_of(conversations, conv, turn, role, text), every, most, shard_rows)
    by_shard = rows.groupBy("shard")
    goes_on = carried(pieces_of(rows, F.count("*").alias("n")), ["n"], later=True).select(
        F.col("shard").alias("at"), F.col("conv_id").alias("cut"))
    parts = stored(by_shard.cogroup(goes_on.groupBy("at")).applyInArrow(shard_nodes, NODE_SCHEMA), "nodes")
    trie = stored(parts.groupBy("hi", "lo").agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min_by("shard", "conv_id").alias("shard"),
        *[F.min(c).alias(c) for c in ("depth", "words", "up_hi", "up_lo")]), "trie")
    children = (trie.filter("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"))
                .agg(F.count("*").alias("n_children")))
    nodes = stored(trie.join(children, ["hi", "lo"], "left")
                   .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "counted")

    own = nodes.select("shard", "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    # what a cut conversation's own nodes in later shards add, for each of its shards before
    inside = rows.join(cut_ids(rows), "conv_id", "left_semi").select("shard", "conv_id").distinct()
    owned = own.groupBy("shard", "conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    pieces = inside.join(owned, ["shard", "conv_id"], "left").fillna(0, ["leaves", "saved"])
    below = carried(pieces, ["leaves", "saved"], later=True).withColumn("depth", F.lit(None).cast("long"))
    added = own.filter("leaves > 0 or saved > 0").unionByName(below).select(
        F.col("shard").alias("at"), F.col("conv_id").alias("owner"), F.col("depth").alias("deep"), "leaves", "saved")
    held = (by_shard.cogroup(added.groupBy("at"))
            .applyInArrow(shard_subtrees, "hi long, lo long, n_leaves long, saved_tokens long")
            .groupBy("hi", "lo").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    ends = end_hashes(parts.filter("ends is not null").select("hi", "lo", "shard", "ends"))
    up = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    above_root = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return (nodes.join(held, ["hi", "lo"], "left").join(ends, ["hi", "lo"], "left")
            .join(up, ["up_hi", "up_lo"], "left")
            .select("conv_id", "depth", above_root, "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
