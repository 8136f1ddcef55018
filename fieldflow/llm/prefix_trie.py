"""A prefix trie of conversations: which openings they share, and what sharing saves.

Every distinct turn (role, text) has a fixed-width identifier of ``WIDTH`` bytes, so a conversation is a byte
string, big-endian in its turns. Conversations are numbered, digested and sorted by Spark; sorted runs of at
most ``CHUNK_KEYS`` distinct strings go into adaptive radix trees, whose nodes hold 4, 16, 48 or 256 children
and grow by need, and whose one-way stretches are compressed into a path. Inner byte depths are the trees' own
business: only depths that are whole turns give nodes.

As runs are sorted, a trie node lies in several runs only if it is a beginning of a run's first or last string.
Those few (the seams) leave with partial sums, are added up, and sums over their subtrees go up by doubling:
after k rounds a seam holds what lies less than 2^k turns below it. All other nodes are whole where they are.

Equal conversations are one string: identifiers that end at a node are joined in stretches of ``ID_RANGE``
identifiers, which a task then digests one after the other, so a conversation that a third of all repeat asks no
task to hold its identifiers. A single conversation's turns (40 bytes each, no texts) do meet in one row.

Defined results: rows without conv_id belong to no conversation; null roles and texts are empty; equal turn
numbers follow role, then text; repeated rows are turns of their own; no conversations give no nodes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldflow.llm import frames
from fieldflow.session import cut_lineage

WIDTH = 16  # bytes of a turn identifier
CHUNK_KEYS, CHUNK_TURNS = 8192, 1 << 18  # of one tree
ID_RANGE = 12  # bits: identifiers of one stretch share all but these
SHARED_EVERY, SHARED_MOST = 20, 4
NONE_SHA256 = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: a compressed path, a row that ends here, and children by their next byte.

    Up to 4 and 16 children lie beside a list of their bytes; up to 48 are found through a table of 256 places;
    more take a slot per byte.
    """

    __slots__ = ("path", "row", "some", "room", "bytes", "kids")

    def __init__(self, path: bytes, row: int, some: int):
        self.path, self.row, self.some = path, row, some
        self.room, self.bytes, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, node: Node) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room <= 16:
            self.bytes.append(byte)
            self.kids.append(node)
        elif self.room == 48:
            self.kids.append(node)
            self.bytes[byte] = len(self.kids)
        else:
            self.kids[byte] = node

    def _grow(self) -> None:
        held = list(self.items())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.bytes = bytearray(256)
            for place, (byte, _) in enumerate(held, 1):
                self.bytes[byte] = place
            self.kids = [kid for _, kid in held]
        elif self.room == 256:
            self.bytes, self.kids = bytearray(), [None] * 256
            for byte, kid in held:
                self.kids[byte] = kid

    def items(self):
        """(byte, child), bytes ascending."""
        if self.room <= 16:
            return sorted(zip(self.bytes, self.kids), key=lambda x: x[0])
        if self.room == 48:
            return [(byte, self.kids[at - 1]) for byte, at in enumerate(self.bytes) if at]
        return [(byte, kid) for byte, kid in enumerate(self.kids) if kid is not None]

    def split(self, at: int) -> None:
        """Cut the path: this node keeps what comes before ``at``, a new child has the rest."""
        low = Node(self.path[at + 1 :], self.row, self.some)
        low.room, low.bytes, low.kids = self.room, self.bytes, self.kids
        byte = self.path[at]
        self.path, self.row = self.path[:at], -1
        self.room, self.bytes, self.kids = 4, bytearray(), []
        self.add(byte, low)


def insert(root: Node, key: bytes, row: int) -> None:
    node, at = root, 0
    while True:
        path, rest = node.path, key[at : at + len(node.path)]
        if rest != path:
            same = next((i for i, (x, y) in enumerate(zip(path, rest)) if x != y), len(rest))
            node.split(same)
        at += len(node.path)
        if at == len(key):
            node.row = row
            return
        below = node.child(key[at])
        if below is None:
            node.add(key[at], Node(key[at + 1 :], row, row))
            return
        node, at = below, at + 1


def tree(keys: list[bytes]) -> Node:
    """The tree of distinct byte strings, rows numbered as they come."""
    root = Node(keys[0], 0, 0)
    for row, key in enumerate(keys[1:], 1):
        insert(root, key, row)
    return root


_SEEN = "node string, parent string, seam boolean, depth long, conv_id long, parent_conv_id long, n_convs long, words long"
_NODE = f"{_SEEN}, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _turn_nodes(keys, words, least, n_ends, ends) -> pa.RecordBatch:
    """The nodes at whole turns of one sorted run of distinct strings."""
    first, last = keys[0], keys[-1]
    # One entry per turn node, in the order of the walk.
    up, depth, digest, weight, seam_first, seam_last = [], [], [], [], [], []
    n_convs, low, n_children, leaves, saved, own_ends = [], [], [], [], [], []

    def open_node(parent: int, at: int, some: int) -> int:
        me = len(up)
        up.append(parent)
        depth.append(at // WIDTH)
        if parent < 0:
            digest.append(b"")
            weight.append(0)
            seam_first.append(True)
            seam_last.append(True)
        else:
            turn = keys[some][at - WIDTH : at]
            digest.append(hashlib.md5(digest[parent] + turn).digest())
            weight.append(words[some][at // WIDTH - 1])
            seam_first.append(seam_first[parent] and first[at - WIDTH : at] == turn)
            seam_last.append(seam_last[parent] and last[at - WIDTH : at] == turn)
        for column in (n_convs, n_children, leaves, saved):
            column.append(0)
        low.append(None)
        own_ends.append(None)
        return me

    def close_node(me: int) -> None:
        parent = up[me]
        seam = seam_first[me] or seam_last[me]
        if not seam:
            leaves[me] = leaves[me] or 1
            saved[me] += (n_convs[me] - 1) * weight[me]
        if parent < 0:
            return
        n_convs[parent] += n_convs[me]
        low[parent] = low[me] if low[parent] is None else min(low[parent], low[me])
        if not seam:
            n_children[parent] += 1
            leaves[parent] += leaves[me]
            saved[parent] += saved[me]

    work = [(tree(keys), 0, open_node(-1, 0, 0))]
    closing: list[tuple[Node | None, int, int]] = []
    while work:
        node, at, top = work.pop()
        if node is None:
            close_node(top)
            continue
        end = at + len(node.path)
        # A child's span starts at the byte that leads to it, one before ``at``.
        begin = at - 1 if at else 0
        for bound in range((begin // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            top = open_node(top, bound, node.some)
            closing.append((None, 0, top))
        work.extend(closing)  # the deepest closes first, after all children
        closing.clear()
        if node.row >= 0:
            n_convs[top] += n_ends[node.row]
            low[top] = least[node.row] if low[top] is None else min(low[top], least[node.row])
            own_ends[top] = ends[node.row]
        work.extend((kid, end + 1, top) for _, kid in node.items())
    close_node(0)
    parent = np.array(up)
    seam = np.array(seam_first) | np.array(seam_last)
    low_ = np.array(low, dtype=np.int64)
    open_parent = seam[parent] | seam  # its members may lie in other runs too
    open_parent[0] = True
    names = [d.hex() for d in digest]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names),
            pa.array([names[p] if o and p >= 0 else None for p, o in zip(up, open_parent.tolist())], pa.string()),
            pa.array(seam),
            pa.array(depth, pa.int64()),
            pa.array(low_),
            pa.array(low_[parent], pa.int64(), mask=open_parent),
            pa.array(n_convs, pa.int64()),
            pa.array(weight, pa.int64()),
            pa.array(n_children, pa.int64()),
            pa.array(leaves, pa.int64()),
            pa.array(saved, pa.int64()),
            pa.array(own_ends, pa.string()),
        ],
        [field.split()[0] for field in _NODE.split(", ")],
    )


def _runs(batches):
    """Sorted (key, words, conv_id, n_ends, ends) to the turn nodes of each run."""
    held: list = []
    turns = 0
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            held.append(row)
            turns += len(row[1])
            if len(held) >= CHUNK_KEYS or turns >= CHUNK_TURNS:
                yield _turn_nodes(*map(list, zip(*held)))
                held, turns = [], 0
    if held:
        yield _turn_nodes(*map(list, zip(*held)))


def _ends(batches):
    """Per digest of a string: SHA-256 over all stretches of identifiers, their number and the least."""
    now, state, n, least = None, None, 0, None

    def done():
        names = ["digest", "conv_id", "n_ends", "ends"]
        columns = [[now], pa.array([least], pa.int64()), pa.array([n], pa.int64()), [state.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    for batch in batches:
        for digest, joined, count, low in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
            if digest != now:
                if now is not None:
                    yield done()
                now, state, n, least = digest, hashlib.sha256(joined.encode()), count, low
            else:
                state.update(b"," + joined.encode())
                n += count
    if now is not None:
        yield done()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (identifier in hex, words)."""
    picked = frames.pick(conversations, conv_id="long", turn="long", role="string", text="string")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = picked.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    told_apart = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")  # where a role ends is part of it
    numbered = turns.select(
        "conv_id",
        F.row_number().over(place).alias("place"),
        F.md5(told_apart.cast("binary")).alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    listed = F.sort_array(F.collect_list(F.struct("place", "id", "words")))
    grouped = numbered.groupBy("conv_id").agg(listed.alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame, every: int = SHARED_EVERY, most: int = SHARED_MOST) -> DataFrame:
    """Each conversation behind the opening of the one at ``conv_id - conv_id % every``.

    The opening's length is crc32 of the identifier modulo ``most``; all of it if that one is shorter.
    """
    heads = turns.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")
    )
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    based = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h.cast("int"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return based.join(heads, "base", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _distinct(turns: DataFrame) -> DataFrame:
    """(key, words, conv_id, n_ends, ends) of every distinct sequence of turns."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    seqs = turns.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    seqs = cut_lineage(seqs.withColumn("digest", F.md5("key")), "trie-sequences")
    ids = F.sort_array(F.collect_list("conv_id"))
    stretches = seqs.groupBy("digest", F.shiftright("conv_id", ID_RANGE).alias("range")).agg(
        F.array_join(ids.cast("array<string>"), ",").alias("joined"), F.count("*").alias("n"), F.min("conv_id").alias("low")
    )
    dealt = stretches.repartition("digest").sortWithinPartitions("digest", "range")
    ends = dealt.mapInArrow(_ends, "digest string, conv_id long, n_ends long, ends string")
    return seqs.join(ends, ["digest", "conv_id"]).select("key", "words", "conv_id", "n_ends", "ends")


def _seams(nodes: DataFrame) -> DataFrame:
    """Seam nodes added up, with sums over their subtrees."""
    whole = nodes.where("seam").groupBy("node", "parent", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    whole = cut_lineage(whole, "trie-seams")
    kids = whole.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    whole = whole.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
    whole = cut_lineage(whole.drop("more").withColumn("n_leaves", leaf).withColumn("saved_tokens", saved), "trie-seams")
    sums = whole.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    while sums.where("up is not null").limit(1).count():
        lower = sums.groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        far = sums.select(F.col("node").alias("up"), F.col("up").alias("far"))
        sums = sums.join(lower.where("node is not null"), "node", "left").join(far, "up", "left").select(
            "node",
            F.col("far").alias("up"),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
        )
        sums = cut_lineage(sums, "trie-sums")
    named = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "node").join(named, "parent", "left")


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct opening of the conversations in ``turns`` (conv_id, turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree: words of a node's last text for each member but one) and ends_sha256 (of members that end here).
    """
    distinct = cut_lineage(_distinct(turns), "trie-strings")
    nodes = distinct.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_runs, _NODE)
    nodes = cut_lineage(nodes, "trie-nodes")
    seams = cut_lineage(_seams(nodes), "trie-seams")

    def shown(df: DataFrame, parent: Column) -> DataFrame:
        ends = F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256")
        kept = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
        return df.select("conv_id", "depth", parent.alias("parent_conv_id"), *kept, ends)

    inner = nodes.where("not seam")
    named = seams.select(F.col("node").alias("parent"), F.col("conv_id").alias("p"))
    below = inner.where("parent is not null").join(named, "parent")
    return (
        shown(inner.where("parent is null"), F.col("parent_conv_id"))
        .union(shown(below, F.col("p")))
        .union(shown(seams, F.col("parent_conv_id")))
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt with shared openings."""
    turns = cut_lineage(sequences(conversations), "trie-turns")
    return trie(rebuilt(turns))
