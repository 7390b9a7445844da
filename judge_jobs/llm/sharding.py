"""Resharding at least cost: which blocks of documents move to which shard, and the rewritten shards.

Documents belong to blocks (ranges of a hash of their text, so equal texts share a block) and blocks
lie in old shards. From the old shards' sizes and the new shards' capacities, a minimum-cost flow says
how many bytes go from each old shard to each new one; bytes that stay cost nothing. Blocks then follow
the flow, largest first. Only one row for each block reaches the driver, and the number of blocks is a
parameter, so that table has a fixed size however large the corpus is.
"""

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, freeing, table, text_or_empty

BLOCKS = 4096
#: Rows that one task numbers at once, about.
CELL_ROWS = 20_000
#: Rows of block, cell and four numbers up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def block_of(text_col: str = "text", blocks: int = BLOCKS) -> Column:
    """The block of a text: equal texts (null as empty) share one."""
    return F.pmod(F.xxhash64(text_or_empty(text_col)), F.lit(blocks)).cast("int")


#: The order of a cell's rows; rows equal in all three are interchangeable.
IN_CELL = ("doc_id", "text_crc32", "size")


def cell_of() -> Column:
    """The cell of a row among the ``cells`` of its block, from its id and text alone."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("cells")).cast("int")


def transfers(sizes: list[int], capacities: list[int], cost=lambda i, j: 0 if i == j else 1) -> list[list[int]]:
    """Minimum-cost flow from old shards (sizes) to new ones (capacities), by successive shortest paths.

    ``cost(i, j)`` is the price of a byte from old shard i to new shard j. The capacities must hold
    all sizes. Returns the bytes on each pair. Exact for integers; its work depends on the number of
    shards, not on the data.
    """
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards can't hold the old ones")
    left, room, flow = list(sizes), list(capacities), [[0] * m for _ in range(n)]
    potential = [0] * (n + m)
    while any(left):
        far, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            edges = ((n + j, cost(u, j)) for j in range(m)) if u < n else ((i, -cost(i, u - n)) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                if (e := d + c + potential[u] - potential[v]) < far[v]:
                    far[v], back[v] = e, u
                    heapq.heappush(heap, (e, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: (far[v] + potential[v], v))
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        most = min(left[path[0]], room[end - n], *(flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[u][v - n] += most
            else:
                flow[v][u - n] -= most
        left[path[0]] -= most
        room[end - n] -= most
        known = [x for x in far if x < float("inf")]
        potential = [p + min(x, max(known)) for p, x in zip(potential, far)]
    return flow


def place(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> dict[int, int]:
    """A new shard for each block (block, old shard, bytes): largest first, to the shard it owes most.

    A block goes to the shard with the largest flow still open from its old shard; where the flow is
    used up (blocks don't divide), to the shard with the most room. Then, as long as it brings sizes
    nearer, the smallest fitting block moves from the fullest shard to the emptiest.
    """
    open_ = [list(f) for f in flow]
    m = len(flow[0])
    room = [sum(f[j] for f in flow) for j in range(m)]
    held: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for block, old, size in sorted(blocks, key=lambda x: (-x[2], x[0])):
        j = max(range(m), key=lambda j: (open_[old][j] >= size, min(room[j], open_[old][j]) if open_[old][j] >= size else room[j], j == old, -j))
        open_[old][j] -= size
        room[j] -= size
        held[j].append((size, block))
    for _ in range(len(blocks)):
        low, high = min(range(m), key=lambda j: (room[j], j)), max(range(m), key=lambda j: (room[j], -j))
        gap = room[high] - room[low]
        fit = [x for x in held[low] if 0 < x[0] < gap]
        if not fit:
            break
        best = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x))
        held[low].remove(best)
        held[high].append(best)
        room[low] += best[0]
        room[high] -= best[0]
    return {block: j for j, xs in enumerate(held) for _, block in xs}


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, capacities: list[int] | None = None, blocks: int = BLOCKS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Old and new place of each document: doc_id, size, text_crc32, block, old_shard, shard, slot, moved.

    ``old_shard`` gives each block's present shard (it must depend on the block alone; an expression
    over the column ``block``). The size of a document is its text's UTF-8 bytes plus 1. Without
    ``capacities`` the new shards are to be equal. A block that is itself larger than a shard (a hot
    text) stays whole, and the others even out around it.

    ``slot`` numbers a shard's rows from 0 without gaps: blocks in order, and within a block cells of
    some ``CELL_ROWS`` rows each, so that no task numbers a whole shard or a hot block.

    Null text: no bytes, crc 0. Null ids and repeated rows are placed like any other. A text of any length is one row of one
    block and is read whole, in one task. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), block_of(text_col, blocks).alias("block"))
    rows = table(rows, "blocks")
    found = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("old", old_shard.cast("int")).collect()
    old = sorted({x.old for x in found})
    sizes = [sum(x.bytes for x in found if x.old == o) for o in old]
    # both lists are indexed by shard number, so that staying where one is costs nothing
    total, reach = sum(sizes), (max(old) + 1 if old else 1)
    capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
    by_old = [dict(zip(old, sizes)).get(o, 0) for o in range(reach)]
    new = place([(x.block, x.old, x.bytes) for x in found], transfers(by_old, capacities))
    cells = {x.block: -(-x.n // CELL_ROWS) for x in found}
    plan = docs.sparkSession.createDataFrame([(x.block, x.old, new[x.block], cells[x.block]) for x in found], "block int, old_shard int, shard int, cells int")
    placed = rows.join(F.broadcast(plan), "block").withColumn("cell", cell_of())
    counts = placed.groupBy("shard", "block", "cell").agg(F.count("*").alias("n"))
    first = counts.select("block", "cell", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    nth = F.row_number().over(W.partitionBy("block", "cell").orderBy(*IN_CELL)) - 1
    return placed.withColumn("nth", nth).join(first, ["block", "cell"]).select("doc_id", "size", "text_crc32", "block", "old_shard", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved")).withMetadata("block", {"blocks": blocks})


def rewrite_in_order(docs: DataFrame, plan: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the affected shards with their texts to ``path``/shard=N, rows in slot order, and read their places back from the files.

    ``plan``: a stored table of :func:`reshard` over these documents, whose column ``block`` tells the number of blocks; if the files
    don't hold every row that the plan gives them, that is an error (ValueError). A row's block and cell come from its own id and text, so only the
    cells' first slots are joined to the texts, and the texts go through one shuffle, by runs of slots of some
    CELL_ROWS rows; no task writes a whole shard. Returns doc_id, size, text_crc32, shard and slot; the first
    three are computed from the texts in the files, and for shards that keep theirs from the documents.
    """
    named = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    crc = lambda: F.crc32(text_or_empty().cast("binary"))
    size = lambda: (F.octet_length(text_or_empty()) + 1).cast("long")
    count = plan.schema["block"].metadata.get("blocks", BLOCKS)
    # a row for each block
    blocks = table(plan.groupBy("block").agg(F.ceil(F.count("*") / CELL_ROWS).alias("cells"), F.first("old_shard").alias("old_shard"), F.first("shard").alias("shard")), "cells")
    affected = blocks.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    changed = F.broadcast(blocks.join(affected, "shard", "left_semi").select("block", "cells", "shard"))
    starts = table(plan.select("block", "slot", *IN_CELL).join(changed, "block").withColumn("cell", cell_of()).groupBy("block", "cell").agg(F.min("slot").alias("first")), "starts")
    rows = named.withColumns({"text_crc32": crc(), "size": size(), "block": block_of(blocks=count)}).join(changed, "block").withColumn("cell", cell_of())
    placed = rows.join(bounded(starts, BROADCAST_ROWS), ["block", "cell"]).withColumn("run", F.floor(F.col("first") / CELL_ROWS)).repartition("shard", "run")
    nth = F.row_number().over(W.partitionBy("shard", "run", "block", "cell").orderBy(*IN_CELL)) - 1
    with freeing(docs.sparkSession):
        placed.withColumn("slot", F.col("first") + nth).sortWithinPartitions("shard", "slot").select("doc_id", "text", "slot", "shard").write.partitionBy("shard").parquet(path)
    read = docs.sparkSession.read.schema(named.schema.add("slot", "long").add("shard", "integer")).parquet(path)
    stays = plan.join(F.broadcast(affected), "shard", "left_anti").select("doc_id", "size", "text_crc32", "shard", "slot")
    written, planned = read.count(), plan.join(F.broadcast(affected), "shard", "left_semi").count()
    if written != planned:
        raise ValueError(f"{written} rows were written and {planned} planned: the plan is of other documents or blocks")
    return read.select("doc_id", size().alias("size"), crc().alias("text_crc32"), "shard", "slot").unionByName(stays)
