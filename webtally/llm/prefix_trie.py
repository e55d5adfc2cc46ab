"""The trie of conversations that begin alike, and totals over its subtrees by time-forward processing.

A node is a distinct beginning of conversations: the sequence of their first turns. It is
known by its depth and sums of hashes of (depth, turn), 128 bits of them; sums go on where a
block of turns ends, so that a conversation of any length is worked on in blocks. Nodes,
their members and children are counted by grouping.

Totals of subtrees go from the leaves up. The nodes of a *shard* are sorted from the deepest
level up (Spark's sort spills) and read in that order; every node takes the totals that
its children have sent to it from a priority queue, adds its own and sends the sum to its parent. The queue
keeps ``QUEUE`` messages in memory and spills sorted runs to anonymous files of the task. A shard is
the subtree below a *heavy* node, one with more members than ``max(HEAVY, turns / 100,000)``, cut again
where a block of ``max(BLOCK, turns / 100,000)`` levels ends. So there are at most 100,000 heavy nodes, and
no shard has more members than that. The totals of shards are added up per parent and passed on
the same way across the roots of shards and heavy nodes; what passes from block to block is
put into its shard, which is then read once more.

Defined results: turns are ordered by ``turn``, NULL first, equal ones by role and text; repeated
rows are turns of their own. NULL roles and texts are empty ones. Rows without a conversation id
belong to none and are left out. Texts of any length are hashed whole. A conversation without turns
is a member of the root alone. An empty table gives no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from webtally.llm.ordering import in_order, places_within
from webtally.llm.workspace import ship_package, slices, stored

BLOCK = 4096
HEAVY = 100
SHARE = 100_000
QUEUE = 100_000
# Characters of role and text by which turns of equal number are dealt to ranges.
SHORT = 32


class SpillingQueue:
    """A priority queue of ``(key, a, b)``; beyond ``most`` entries it writes them as a sorted run to a file of its own."""

    def __init__(self, most: int = QUEUE) -> None:
        self.most = most
        self.heap: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.heads: list[tuple] = []

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _write(self, entries: Iterator[tuple]) -> None:
        file = tempfile.TemporaryFile()  # without a name: it goes with the task
        part: list[tuple] = []
        for entry in entries:
            part.append(entry)
            if len(part) == 1000:
                pickle.dump(part, file)
                part = []
        if part:
            pickle.dump(part, file)
        file.seek(0)
        self.runs.append(self._read(file))
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        entry = next(self.runs[run], None)
        if entry is not None:
            heapq.heappush(self.heads, (entry, run))

    def _rest(self) -> Iterator[tuple]:
        """All entries of the runs in order."""
        while self.heads:
            entry, run = heapq.heappop(self.heads)
            self._advance(run)
            yield entry

    def push(self, key: tuple, a: int, b: int) -> None:
        if len(self.heap) >= self.most:
            spilled, self.heap = sorted(self.heap), []
            if len(self.heads) >= 16:  # few runs, so that their buffers stay small
                old = SpillingQueue(self.most)
                old.runs, old.heads = self.runs, self.heads
                self.runs, self.heads = [], []
                self._write(heapq.merge(old._rest(), spilled))
            else:
                self._write(iter(spilled))
        heapq.heappush(self.heap, (key, a, b))

    def pop(self, key: tuple) -> tuple[int, int]:
        """Sums of all entries with this key, which is the smallest of those that are left or smaller."""
        a = b = 0
        while self.heap and self.heap[0][0] == key:
            _, x, y = heapq.heappop(self.heap)
            a, b = a + x, b + y
        while self.heads and self.heads[0][0][0] == key:
            (_, x, y), run = heapq.heappop(self.heads)
            self._advance(run)
            a, b = a + x, b + y
        return a, b


# ``up`` is the depth of the parent.
COLUMNS = ("shard", "depth", "node", "up", "parent", "inside", "n_leaves", "saved")
FORWARD = "shard binary, node binary, top binary, n_leaves bigint, saved bigint"


def time_forward(most: int = QUEUE):
    """Function of ``mapInArrow``: totals of subtrees within shards.

    Rows come shard by shard, deepest first, with the node's own ``n_leaves`` and ``saved``, its parent, and
    whether that is ``inside`` the shard. They go out with totals; ``top`` is the parent of a node
    whose parent is elsewhere.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(most), None
        for part in slices(batches):
            columns = [part[c].to_pylist() for c in COLUMNS]
            tops, leaves, saves = [], [], []
            for place, depth, node, up, parent, inside, own_leaves, own_saved in zip(*columns):
                if place != shard:
                    queue, shard = SpillingQueue(most), place
                a, b = queue.pop((-depth, node))
                a, b = a + own_leaves, b + own_saved
                if inside:
                    queue.push((-up, parent), a, b)
                tops.append(None if inside else parent)
                leaves.append(a)
                saves.append(b)
            yield pa.record_batch(
                [part["shard"], part["node"], pa.array(tops, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saves, pa.int64())],
                names=["shard", "node", "top", "n_leaves", "saved"],
            )

    return rows


def _totals(nodes: DataFrame, most: int) -> DataFrame:
    """Time-forward processing of rows with :data:`COLUMNS`, shards side by side."""
    placed = nodes.select(*COLUMNS).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
    return placed.mapInArrow(time_forward(most), FORWARD)


# ---------------------------------------------------------------- turns


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv, place, turn, n_bytes``: digests of the turns of every conversation and their place, from 1."""
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    rows = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv"), conversations["turn"].alias("at"), role.alias("role"), text.alias("text")
    ).where("conv IS NOT NULL")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    placed = in_order(
        rows,
        [F.col("conv"), F.col("at"), F.left("role", F.lit(SHORT)), F.left("text", F.lit(SHORT))],
        [F.col("conv"), F.col("at"), F.col("role"), F.col("text")],
        [F.col("conv"), digest.alias("turn"), F.octet_length("text").cast("bigint").alias("n_bytes")],
        "trie-turns",
    )
    return stored(places_within(placed, "conv"), "trie-places")


def block_size(turns: DataFrame, block: int = BLOCK) -> int:
    """Turns of one conversation that are worked on together: ``block``, and more only in large tables."""
    return max(block, turns.count() // SHARE)


def rebuilt(turns: DataFrame, block: int, modulus: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one of their group: their turns, and ``conv, n_turns``.

    Conversation ``c`` starts with the first ``crc32(c) % modulus`` turns of ``c - c % group``, and
    goes on with its own turns after as many.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % modulus
    convs = lengths.select("conv", "n", head.alias("head"), (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    lent = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = stored(convs.join(bases, "base", "left").withColumn("lent", lent).drop("n_base"), "trie-conversations")

    first = turns.where(F.col("place") < modulus).withColumnRenamed("conv", "base")
    borrowed = first.join(convs.select("conv", "base", "head"), "base").where(F.col("place") <= F.col("head"))
    # a conversation of many blocks is matched block by block
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block)))).select(
        "conv", "block", "head", "lent"
    )
    own = turns.withColumn("block", F.floor((F.col("place") - 1) / block)).join(blocks, ["conv", "block"])
    own = own.where(F.col("place") > F.col("head"))
    rows = borrowed.select("conv", F.col("place").alias("depth"), "turn", "n_bytes").unionByName(
        own.select("conv", (F.col("lent") + F.col("place") - F.col("head")).alias("depth"), "turn", "n_bytes")
    )
    own_left = F.greatest(F.col("n") - F.col("head"), F.lit(0))
    return rows, convs.select("conv", (F.col("lent") + own_left).alias("n_turns"))


def _node(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def beginnings(turns: DataFrame, block: int) -> DataFrame:
    """``conv, depth, block, node, parent, n_bytes``: the node that each conversation reaches with each of its turns."""
    hashes = [F.xxhash64("depth", "turn", F.lit(i)) for i in (1, 2)]
    pieces = [p for h in hashes for p in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    names = [f"h{i}" for i in range(len(pieces))]
    rows = turns.select(
        "*", F.floor((F.col("depth") - 1) / block).alias("block"), *[p.alias(n) for p, n in zip(pieces, names)]
    )
    inner = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv", "block").agg(*[F.sum(n).alias(n) for n in names])
    before = whole.select("conv", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"b{n}") for n in names])
    summed = rows.select("*", *[F.sum(n).over(inner).alias(f"s{n}") for n in names]).join(before, ["conv", "block"])
    sums = [F.col(f"s{n}") + F.col(f"b{n}") for n in names]
    return summed.select(
        "conv",
        "depth",
        "block",
        _node(F.col("depth"), sums).alias("node"),
        _node(F.col("depth") - 1, [s - F.col(n) for s, n in zip(sums, names)]).alias("parent"),
        "n_bytes",
    )


# ---------------------------------------------------------------- digests of members


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``node, conv`` as pieces ``node, first, ids`` with the ids of one node in one batch."""
    for part in slices(batches):
        pieces: list[list] = []
        for node, conv in zip(part["node"].to_pylist(), part["conv"].to_pylist()):
            if not pieces or pieces[-1][0] != node:
                pieces.append([node, conv, []])
            pieces[-1][2].append(str(conv))
        yield pa.record_batch(
            [
                pa.array([p[0] for p in pieces], pa.binary()),
                pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([",".join(p[2]) for p in pieces], pa.string()),
            ],
            names=["node", "first", "ids"],
        )


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of its pieces, read in order and never put together."""
    node, state = None, None

    def batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.record_batch(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
            names=["node", "ends_sha256"],
        )

    for part in slices(batches):
        done = []
        for own, ids in zip(part["node"].to_pylist(), part["ids"].to_pylist()):
            if own != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield batch(done)
    if state is not None:
        yield batch([(node, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of ``node, conv``: the ids of a node in ascending order, joined by commas.

    Ids are put together where they lie in ranges, so the many ids of one node reach its task as a few pieces.
    """
    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = ranged.mapInArrow(_id_lists, "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _id_digests, "node binary, ends_sha256 string"
    )


# ---------------------------------------------------------------- the trie


def prefix_trie(
    turns: DataFrame, lengths: DataFrame, block: int = BLOCK, heavy: int = HEAVY, queue: int = QUEUE
) -> DataFrame:
    """One row per node of ``turns`` (``conv, depth, turn, n_bytes``) and ``lengths`` (``conv, n_turns``).

    Columns ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    spark = turns.sparkSession
    ship_package(spark)
    rows = stored(beginnings(turns, block), "trie-beginnings")
    root = _node(F.lit(0), [F.lit(0)] * 4)

    most = max(heavy, rows.count() // SHARE)
    members = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most).select("node")
    big = F.broadcast(stored(members, "trie-heavy").withColumn("is_heavy", F.lit(True)))  # at most SHARE rows
    flagged = rows.join(big, "node", "left").withColumn("is_heavy", F.col("is_heavy").isNotNull())
    light = F.min(F.when(~F.col("is_heavy"), F.struct("depth", "node")))
    shard = light.over(Window.partitionBy("conv", "block"))["node"]
    flagged = flagged.withColumn("shard", F.when(~F.col("is_heavy"), shard))
    grouped = flagged.groupBy("node", "depth", "parent").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.min("shard").alias("shard")
    )
    everyone = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = everyone.select(
        root.alias("node"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("binary").alias("parent"),
        "conv_id",
        "n_convs",
        F.lit(0).cast("bigint").alias("n_bytes"),
        F.lit(None).cast("binary").alias("shard"),
    )
    nodes = grouped.unionByName(top)
    children = grouped.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(
        nodes.join(children, "node", "left").select(
            *nodes.columns,
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
            # a shard's first node, or one at the start of a block, has its parent elsewhere
            (F.col("shard").isNotNull() & (F.col("node") != F.col("shard"))).alias("inside"),
            (F.col("depth") - 1).alias("up"),
        ),
        "trie-nodes",
    )
    totals = subtree_totals(nodes, block, queue)

    ends = lengths.join(rows.select("conv", "depth", "node"), (rows["conv"] == lengths["conv"]) & (F.col("depth") == F.col("n_turns")), "left")
    ends = stored(ends.select(lengths["conv"], F.coalesce("node", root).alias("node")), "trie-ends")

    parents = _parent_ids(nodes)
    none = hashlib.sha256(b"").hexdigest()
    result = nodes.select("node", "conv_id", "depth", "n_convs", "n_children")
    result = result.join(totals, "node").join(parents, "node", "left").join(end_digests(ends), "node", "left")
    return result.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _parent_ids(nodes: DataFrame) -> DataFrame:
    """``node, parent_conv_id``. Parents of many children, of which there are few, are broadcast; others are joined."""
    most = max(HEAVY, nodes.count() // SHARE)
    ids = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    own = nodes.where("parent IS NOT NULL").select("node", "parent")
    many = F.broadcast(ids.where(F.col("n_children") > most).select("parent", F.col("parent_conv_id").alias("_id")))
    marked = own.join(many, "parent", "left")
    few = marked.where("_id IS NULL").drop("_id").join(ids.where(F.col("n_children") <= most).drop("n_children"), "parent")
    return marked.where("_id IS NOT NULL").select("node", F.col("_id").alias("parent_conv_id")).unionByName(
        few.select("node", "parent_conv_id")
    )


def subtree_totals(nodes: DataFrame, block: int, queue: int = QUEUE) -> DataFrame:
    """``node, n_leaves, saved`` of whole subtrees: within shards, across their roots, and back where a block ends."""
    inner = stored(_totals(nodes.where("shard IS NOT NULL"), queue), "trie-shards")
    above = inner.where("top IS NOT NULL").select("shard", F.col("top").alias("parent"), "n_leaves", "saved")
    # the shard that a shard's root hangs on: none if its parent is heavy
    holds = nodes.where("shard IS NOT NULL").select(F.col("node").alias("parent"), F.col("shard").alias("holder"))
    depths = nodes.select(F.col("node").alias("holder"), F.col("depth").alias("holder_depth"))
    starts = nodes.where(F.col("node") == F.col("shard")).where((F.col("depth") - 1) % block == 0).where("depth > 1")
    crossing = starts.select("node", "parent").join(holds, "parent").join(depths, "holder")
    crossing = stored(crossing.select("node", "parent", "holder", "holder_depth"), "trie-crossings")
    tops = nodes.where("shard IS NULL")
    if crossing.isEmpty():
        return inner.select("node", "n_leaves", "saved").unionByName(_top_totals(tops, above, queue))

    # Shards between which totals pass are nodes of the tree across roots, beside the heavy ones.
    linked = crossing.select(F.col("node").alias("shard")).union(crossing.select("holder")).distinct()
    roots = nodes.where(F.col("node") == F.col("shard")).join(linked, "shard", "left_semi")
    roots = roots.select("node", "depth", "up", "parent").join(crossing.drop("parent"), "node", "left")
    # their own totals are those of the shard; what hangs on a shard in the middle counts for its root
    parent, up = F.coalesce("holder", "parent").alias("parent"), F.coalesce("holder_depth", "up").alias("up")
    own = roots.select("node", "depth", up, parent).join(
        above.select(F.col("shard").alias("node"), "n_leaves", "saved"), "node"
    )
    rest = above.join(linked, "shard", "left_anti")
    across = stored(_top_totals(tops, rest, queue, own), "trie-across")
    sent = crossing.join(across, "node").groupBy(F.col("parent").alias("node")).agg(
        F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
    )
    again = nodes.join(crossing.select(F.col("holder").alias("shard")).distinct(), "shard", "left_semi")
    again = again.join(sent, "node", "left")
    for own_total, more in (("n_leaves", "more_leaves"), ("saved", "more_saved")):
        again = again.withColumn(own_total, F.col(own_total) + F.coalesce(more, F.lit(0)))
    full = _totals(again, queue).select("node", "n_leaves", "saved")
    alone = inner.join(crossing.select(F.col("holder").alias("shard")).distinct(), "shard", "left_anti")
    heavy = across.join(tops.select("node"), "node", "left_semi")
    return full.unionByName(alone.select("node", "n_leaves", "saved")).unionByName(heavy)


def _top_totals(tops: DataFrame, above: DataFrame, queue: int, linked: DataFrame | None = None) -> DataFrame:
    """Time-forward processing of the heavy nodes, and of linked shards as one node each.

    ``above`` has the totals of the other shards, which are added up per parent first.
    """
    sums = above.groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    own = tops.select("node", "depth", "up", "parent", "n_leaves", "saved")
    if linked is not None:
        own = own.unionByName(linked)
    own = own.join(sums, "node", "left")
    own = own.select(
        F.lit(b"").alias("shard"),
        "depth",
        "node",
        "up",
        "parent",
        F.col("parent").isNotNull().alias("inside"),
        (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
    )
    return _totals(own, queue).select("node", "n_leaves", "saved")
