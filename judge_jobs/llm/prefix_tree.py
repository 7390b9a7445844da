"""The trie of conversation prefixes, built as ternary search trees over ranges of dictionary-encoded turns.

Turns (role, text) get ids in a dictionary whose order is that of role and text. Conversations become arrays of
ids and are range-partitioned by array and id, so that neighbours share prefixes. A task cuts its sorted
stream into blocks of bounded size and builds a ternary search tree for each: distinct sequences are inserted
median first, which keeps the sibling trees balanced, and one pass over the nodes in reverse order of creation
carries members, leaves and savings up to the parents, without recursion.

A node whose members lie in several blocks is a prefix of a block's first or last sequence, as long as what
that shares with the neighbouring block at most. Those boundary nodes leave their blocks with partial figures that add up: a
node counts as a child, and its text is taken off the savings, in the first block that has it; an end
counts as a leaf unless the next sequence goes on from it. A group of equal conversations, however large,
is cut into blocks like any other.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded, drop_table, sized_partitions, table

#: Turns and members that one block holds at most, but for its last conversation (bounds memory, not results).
BLOCK = 200_000
#: Boundary nodes up to which they are sent to every task; more go through shuffles.
SENT = 200_000
#: Characters of a text that order turns of one number and role; a hash decides between equal ones.
HEAD = 32

FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = "boundary boolean, node_key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_from long, ends string"


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids, sizes: each conversation's dictionary ids in the order of its turns, and the code points of their texts.

    A null turn comes first; turns of one number go by role, the first characters of the text, and its hash. Null role or text
    is empty. Rows that repeat a turn are turns of their own. Rows without a conversation are left out. A
    conversation's ids (not its texts) are one row. Other columns aren't read.
    """
    c = lambda name: conversations[f"`{name}`"]
    role, text = F.coalesce(c(role_col), F.lit("")), F.coalesce(c(text_col), F.lit(""))
    rows = conversations.where(c(conv_col).isNotNull()).select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    keyed = rows.select("conv_id", "turn", key.alias("key"), "role", F.substring("text", 1, HEAD).alias("head"), F.length("text").cast("long").alias("size"))
    found = keyed.groupBy("key").agg(F.min(F.struct("role", "head", "size")).alias("v"))
    order = ("v.role", "v.head", "key")
    ordered = found.repartitionByRange(sized_partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    dictionary = table(ordered.select("key", F.monotonically_increasing_id().alias("id"), F.col("v.size").alias("size")), "turns")
    turns = keyed.select("conv_id", "turn", "key").join(dictionary, "key")
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "size"))).alias("t"))
    return each.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def shared(a: str, b: str) -> Column:
    """How many leading elements two array columns have in common."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(a))


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


class SearchTree:
    """A ternary search tree of sequences. Node 0 is the root of all prefixes; a node's trie parent is older than itself."""

    def __init__(self):
        self.split, self.size, self.depth, self.parent = [None], [0], [0], [-1]
        self.less, self.more, self.next = [-1], [-1], [-1]

    def _node(self, turn, size, parent) -> int:
        for column, value in ((self.split, turn), (self.size, size), (self.depth, self.depth[parent] + 1), (self.parent, parent), (self.less, -1), (self.more, -1), (self.next, -1)):
            column.append(value)
        return len(self.split) - 1

    def insert(self, ids: list, sizes: list) -> int:
        """The node of a whole sequence, made if need be."""
        at, split, less, more = 0, self.split, self.less, self.more
        for turn, size in zip(ids, sizes):
            node = self.next[at]
            if node < 0:
                node = self.next[at] = self._node(turn, size, at)
            while split[node] != turn:
                side = less if turn < split[node] else more
                if side[node] < 0:
                    side[node] = self._node(turn, size, at)
                node = side[node]
            at = node
        return at

    def path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int):
    """The numbers under ``n``, the middle of each range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            ranges += [(mid + 1, b), (a, mid)]


def block_nodes(entries: list, before: int, after: int):
    """The nodes of one block, as rows of NODES.

    ``entries``: (ids, sizes, members ascending) of distinct sequences in order. ``before`` and ``after``: how many turns the first and
    the last have in common with the neighbouring sequences outside, -1 if there is none.
    """
    tree = SearchTree()
    ends = [0] * len(entries)
    for k in medians(len(entries)):
        ends[k] = tree.insert(*entries[k][:2])
    n = len(tree.split)
    convs, first, leaves, kids = [0] * n, [None] * n, [0] * n, [0] * n
    for k, (node, (ids, _, members)) in enumerate(zip(ends, entries)):
        convs[node], first[node] = len(members), members[0]
        follows = _common(ids, entries[k + 1][0]) if k + 1 < len(entries) else after
        leaves[node] = int(follows < len(ids))
    head, tail = tree.path(ends[0]), tree.path(ends[-1])
    known = set(head[: before + 1])
    meeting = known | set(tail[: after + 1])
    saved = [0] * n
    for node in range(n - 1, -1, -1):
        own = convs[node] * tree.size[node] - (0 if node in known else tree.size[node])
        saved[node] += own
        up = tree.parent[node]
        if up >= 0:
            convs[up] += convs[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            kids[up] += node not in known
            if first[up] is None or first[node] < first[up]:
                first[up] = first[node]
    keys = {}
    for path, reach in ((head, before), (tail, after)):
        digest = hashlib.blake2b(digest_size=16)
        for node in path[: reach + 1]:
            if node:
                digest.update(tree.split[node].to_bytes(8, "little"))
            keys[node] = digest.digest()
    members = {node: entry[2] for node, entry in zip(ends, entries)}
    for node in range(n):
        up, own = tree.parent[node], members.get(node)
        parent = None if up < 0 or up in meeting else first[up]
        text = ",".join(map(str, own)) if own else None
        yield node in meeting, keys.get(node), keys.get(up), first[node], tree.depth[node], parent, convs[node], kids[node], leaves[node], saved[node], own[0] if own else None, text


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conversations`` (conv_id, ids, sizes, as from :func:`sequences`).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256 of the members that end here. conv_id is unique and not null; empty sequences end
    at the root. Without conversations there is no node.
    """
    spark = conversations.sparkSession
    n = sized_partitions(spark)
    rows = conversations.select("conv_id", "ids", "sizes")
    stored = table(rows.repartitionByRange(n, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").withColumn("shard", F.spark_partition_id()), "ranges")
    # two numbers for each range reach the driver
    edges = stored.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    order = W.orderBy("shard")
    beside = edges.select("shard", "first", "last", F.lag("last").over(order).alias("prior"), F.lead("first").over(order).alias("next"))
    reach = beside.select("shard", F.when(F.col("prior").isNull(), -1).otherwise(shared("first", "prior")), F.when(F.col("next").isNull(), -1).otherwise(shared("last", "next")))
    meets = {shard: (a, b) for shard, a, b in reach.collect()}

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in NODES.split(", ")]
        kinds = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]

        def packed(nodes):
            rows, held = [], 0
            for row in nodes:
                rows.append(row)
                held += 1 + len(row[-1] or "") // 100
                if held >= 20_000:
                    yield rows
                    rows, held = [], 0
            yield rows

        def nodes(entries, before, after):
            for rows in packed(block_nodes(entries, before, after)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

        entries, held, now, before = [], 0, None, -1
        for batch in batches:
            for shard, conv, ids, sizes in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if shard != now:
                    if entries:
                        yield from nodes(entries, before, meets[now][1])
                    entries, held, now, before = [], 0, shard, meets[shard][0]
                elif held >= BLOCK:
                    after = _common(entries[-1][0], ids)
                    yield from nodes(entries, before, after)
                    entries, held, before = [], 0, after
                if entries and entries[-1][0] == ids:
                    entries[-1][2].append(conv)
                else:
                    entries.append((ids, sizes, [conv]))
                    held += len(ids)
                held += 1
        if entries:
            yield from nodes(entries, before, meets[now][1])

    dealt = stored.select("shard", "conv_id", "ids", "sizes").repartition(n, "shard").sortWithinPartitions("shard", "ids", "conv_id")
    found = table(dealt.mapInArrow(run, NODES), "nodes")
    drop_table(stored)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    inner = found.where(~F.col("boundary")).withColumn("ends_sha256", F.when(F.col("ends").isNull(), nothing).otherwise(F.sha2("ends", 256)))
    meeting = found.where("boundary")
    sums = meeting.groupBy("node_key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in FIGURES])
    ended = joined_hashes(meeting.where("ends is not null").select("node_key", "ends_from", "ends"))
    merged = table(sums.join(ended, "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)), "meeting")
    above = bounded(merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above")), SENT)
    out = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends_sha256"]
    under = inner.where("parent_key is not null").drop("parent_conv_id").select("parent_key", *[c for c in out if c != "parent_conv_id"])
    joined = under.unionByName(merged.drop("node_key").where("parent_key is not null")).join(above, "parent_key").withColumnRenamed("above", "parent_conv_id")
    rest = inner.where("parent_key is null").select(*out)
    top = merged.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out)
    return rest.unionByName(joined.select(*out)).unionByName(top)


def joined_hashes(parts: DataFrame) -> DataFrame:
    """node_key, ends_sha256 of the comma-joined ``ends`` of each node_key, in the order of ``ends_from``; parts are read as a stream."""

    def run(batches):
        import pyarrow as pa

        key, digest, done = None, None, []
        for batch in batches:
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if digest:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node_key", "ends_sha256"])
            done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["node_key", "ends_sha256"])

    dealt = parts.repartition(sized_partitions(parts.sparkSession), "node_key").sortWithinPartitions("node_key", "ends_from")
    return dealt.select("node_key", "ends").mapInArrow(run, "node_key binary, ends_sha256 string")


def with_borrowed_heads(own: DataFrame) -> DataFrame:
    """Sequences as conversations of families share them: each takes its first turns from the head of its hundred.

    Conversation c gets the first h turns of conversation c - c % 100 (all if that has fewer, none if it is absent), then its own
    turns after its first h, where h is the crc32 of its decimal id modulo 6.
    """
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(100))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = own.where(F.pmod("conv_id", F.lit(100)) == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head_ids"), F.slice("sizes", 1, 5).alias("head_sizes"))
    both = own.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    none = F.array().cast("array<bigint>")
    join = lambda head, tail: F.concat(F.slice(F.coalesce(head, none), 1, F.col("h")), F.slice(tail, F.col("h") + 1, F.greatest(F.size(tail), F.lit(1))))
    return both.select("conv_id", join("head_ids", "ids").alias("ids"), join("head_sizes", "sizes").alias("sizes"))
