"""Benchmark decontamination: containment search with MinHash by size classes, verified exactly.

The items are the indexed domains of an LSH ensemble (Zhu et al., "LSH Ensemble: internet-scale domain
search", 2016): they are partitioned by their number of shingles, up to u = 1, 2, 4, 8 and so on. A short item has almost
no Jaccard similarity with a whole long document, so each class looks at a document through windows of
two blocks of u shingles; an item's passage lies in one of them. There an item of which 0.8 is contained
has a Jaccard similarity of 0.19 at least, so one of 64 minima agrees but for a chance of 1.5e-6. What
agrees is verified: the share of the item's distinct five-word shingles that the whole document has.

Documents are read once for each block of items and never shuffled; only matches leave a task. Items go to the
tasks in blocks of at most ``BLOCK_ITEMS``, so what is sent has a fixed bound however many there are.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, table
from .lines import normalise
from .substrings import hashes, windows

SHINGLE = 5
LEAST = 0.8
MINIMA = 64
BLOCK_ITEMS = 20_000
#: Shingles of documents looked at together.
CHUNK = 300_000


def shingles(text: bytes):
    """64-bit hashes of the five-word shingles of a text, in order (of fewer words: one of all)."""
    words = normalise(text).split()
    if not words:
        return hashes([])
    return windows(hashes(words), min(SHINGLE, len(words)))


def _multipliers():
    import numpy as np

    k = np.arange(1, MINIMA + 1, dtype=np.uint64)
    return (k * np.uint64(0x9E3779B97F4A7C15)) ^ (k * k * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _order(hashed, multiplier):
    """The k-th random order of shingles: a multiplication and a fold (the high half is the better mixed)."""
    import numpy as np

    x = hashed * multiplier
    return x ^ (x >> np.uint64(31))


class Index:
    """Items of one block by size class: sorted minima of each order, with their items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        import numpy as np

        self.ids, self.sets, classes = [], [], {}
        for item, text in items:
            found = np.unique(shingles(text))
            if len(found):
                classes.setdefault(1 << (len(found) - 1).bit_length(), []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(found)
        self.classes = {}
        for u, members in classes.items():
            minima = []
            for m in _multipliers():
                least = np.array([_order(self.sets[i], m).min() for i in members])
                order = np.argsort(least, kind="stable")
                minima.append((least[order], np.array(members)[order]))
            self.classes[u] = minima

    def search(self, docs: list) -> dict[int, set[int]]:
        """Candidate items of each document (by place in the list of their shingle arrays)."""
        import numpy as np

        out: dict[int, set[int]] = {}
        docs = [(d, x) for d, x in docs if len(x)]
        if not docs:
            return out
        flat = np.concatenate([x for _, x in docs])
        lengths = np.array([len(x) for _, x in docs])
        begin = np.cumsum(lengths) - lengths
        plans = {}
        for u in self.classes:
            n = -(-lengths // u)
            owner = np.repeat(np.arange(len(docs)), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            plans[u] = (begin[owner] + nth * u, owner)
        for k, m in enumerate(_multipliers()):
            ordered = _order(flat, m)
            for u, (starts, owner) in plans.items():
                block = np.minimum.reduceat(ordered, starts)
                least, members = self.classes[u][k]
                both = block.copy()
                same = owner[1:] == owner[:-1]
                both[:-1][same] = np.minimum(block[:-1], block[1:])[same]
                at = np.searchsorted(least, both)
                hit = np.flatnonzero(least[np.minimum(at, len(least) - 1)] == both)
                for w in hit:
                    a = at[w]
                    while a < len(least) and least[a] == both[w]:
                        out.setdefault(docs[owner[w]][0], set()).add(int(members[a]))
                        a += 1
        return out


SCHEMA = "doc_id long, tag long, item_id long, n_shared long, n_item long, containment double"


def _matches(docs: DataFrame, items: DataFrame, least: float = LEAST, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The pairs of :func:`contaminated`, with a hash of the text as ``tag``."""
    spark = docs.sparkSession
    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(docs[f"`{text_col}`"]).alias("tag"), docs[f"`{text_col}`"].alias("text"))
    asked = items.select(items[f"`{item_id}`"].cast("long").alias("item_id"), items[f"`{item_text}`"].alias("text")).where(F.col("text").isNotNull())
    blocks = -(-asked.count() // block_items)
    out = None
    for block in range(max(1, blocks)):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        index = spark.sparkContext.broadcast(Index([(x.item_id, x.text.encode()) for x in part.collect()]))

        def run(batches, index=index):
            import numpy as np
            import pyarrow as pa

            found = index.value

            def flush(docs):
                rows = []
                for d, candidates in found.search([(k, x) for k, (_, _, x) in enumerate(docs)]).items():
                    own = np.unique(docs[d][2])
                    for i in sorted(candidates):
                        wanted = found.sets[i]
                        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                        shared = int((own[at] == wanted).sum())
                        if shared >= least * len(wanted):
                            rows.append((docs[d][0], docs[d][1], found.ids[i], shared, len(wanted), shared / len(wanted)))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "tag", "item_id", "n_shared", "n_item", "containment"])

            held, size = [], 0
            for batch in batches:
                for doc, tag, t in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                    held.append((doc.as_py(), tag.as_py(), shingles(t.as_py() or b"")))
                    size += len(held[-1][2])
                    if size >= CHUNK:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

        matches = named.mapInArrow(run, SCHEMA)
        out = matches if out is None else out.unionByName(matches)
    return out


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, **columns) -> DataFrame:
    """Pairs of a document and a benchmark item of whose shingles it has a share of ``least`` or more.

    Returns doc_id, item_id, n_shared, n_item (distinct shingles of the item, those in the document and
    all) and containment. Texts are normalised as in line deduplication (ASCII case and punctuation don't matter).

    Null or wordless texts match nothing. Null ids are kept. Repeated rows and repeated items match each. A text of any
    length is shingled whole, in one task.
    Other columns are not read. An empty table on either side gives no rows.
    """
    return _matches(docs, items, least, **columns).drop("tag")


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, text_col: str = "text", id_col: str = "doc_id", **columns) -> DataFrame:
    """The documents without any such match: the input's rows and columns.

    Null, empty and wordless texts stay, repeated rows stay or go together, null ids are told apart by their texts. Clashing
    names do no harm, since a row travels as one value. Empty tables: no documents, or no items and all documents stay.
    """
    found = table(_matches(docs, items, least, text_col=text_col, id_col=id_col, **columns).select("doc_id", "tag").distinct(), "matches")
    tagged = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("d"), F.xxhash64(docs[f"`{text_col}`"]).alias("t"))
    kept = tagged.join(bounded(found, 500_000), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tag")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
