"""SimHash near-duplicates with keys from the perfect binary Golay code.

A 64-bit fingerprint is cut into three segments of at most 23 bits. Each 23-bit word lies within three
errors of exactly one codeword of the Golay code, so decoding maps it to a 12-bit index; flipping one
bit reaches at most five further codewords. If two fingerprints differ in at most three bits, two of
the segments hold at most one error each. So one side files a fingerprint under the decoded indices of
each two segments, the other asks for the indices near its own, and every such pair meets. What meets is
verified on the whole fingerprints inside the join, and only true links leave it.
"""

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_sums, bounded, drop_table, table
from .graph import components
from .substrings import hashes, windows

#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
ERRORS = 3


def _syndrome(words):
    """Remainders of 23-bit words by the generator."""
    import numpy as np

    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where((out >> bit) & 1, np.int64(GENERATOR << (bit - 11)), np.int64(0))
    return out


_corrections: list = []


def decode(words):
    """The 12-bit index of the codeword within three errors of each 23-bit word."""
    import numpy as np

    if not _corrections:
        patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], dtype=np.int64)
        leader = np.zeros(2048, dtype=np.int64)
        leader[_syndrome(patterns)] = patterns
        _corrections.append(leader)
    words = np.asarray(words, dtype=np.int64)
    return (words ^ _corrections[0][_syndrome(words)]) >> 11


def near_indices(words, width: int):
    """Indices of the words and of all words one bit away: an array of rows, and which entries are the first of their kind."""
    import numpy as np

    found = np.sort(np.stack([decode(words), *[decode(words ^ (1 << b)) for b in range(width)]], axis=1), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def keys(prints, near: bool):
    """(row, key) arrays: the filing keys of fingerprints, or with ``near`` all keys to ask for."""
    import numpy as np

    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, out = [], []
    every = np.arange(len(prints))
    if near:
        close = [near_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    for t, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        if not near:
            rows.append(every)
            out.append((t << 24) | (decode(parts[i]) << 12) | decode(parts[j]))
            continue
        (a, fa), (b, fb) = close[i], close[j]
        r, x = np.nonzero(fa)
        # for each kept entry of a, all kept entries of b in the same row
        counts = fb.sum(axis=1)
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        kept = b[fb]
        n = counts[r]
        which = np.repeat(np.arange(len(r)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows.append(r[which])
        out.append((t << 24) | (a[r, x][which] << 12) | kept[begin[r[which]] + within])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: bytes, n: int = 3) -> int:
    """64-bit SimHash of the n-word shingles of a text (ASCII lower case, ASCII white space), repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = np.array([xxh64_intdigest(joined, 42)], dtype="<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-n] + 1).tolist()]
        hashes = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[n - 1 :].tolist())), dtype="<u8", count=len(starts))
    return int(np.packbits(2 * bit_sums(hashes, [0])[0] > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, tag (a hash of the text) and fingerprint (the 64 bits as a signed long). Null text counts as empty: zero."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py() or b"", n) for t in batch.column(2).cast(pa.binary())), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view("<i8"))], names=["doc_id", "tag", "fingerprint"])

    text = docs[f"`{text_col}`"]
    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text")).mapInArrow(run, "doc_id long, tag long, fingerprint long")


def links(prints: DataFrame) -> DataFrame:
    """All pairs of distinct fingerprints that differ in 1 to 3 bits: (a, b), a < b. ``prints``: distinct, in column fingerprint."""

    def emit(near: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
                for at in range(0, len(values), 4096):
                    part = values[at : at + 4096]
                    rows, found = keys(part, near)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(part[rows].view("<i8"))], names=["k", "x"])

        return run

    filed = prints.select("fingerprint").mapInArrow(emit(False), "k int, b long")
    asked = prints.select("fingerprint").mapInArrow(emit(True), "k int, a long")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= ERRORS
    return asked.join(filed, (asked.k == filed.k) & (asked.a < filed.b) & close).select("a", "b").distinct()


def _grouped(docs: DataFrame, n: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, tag, fingerprint, and the first document (first: doc_id and tag) of its component."""
    prints = table(fingerprints(docs, n, text_col, id_col), "fingerprints")
    nodes = table(prints.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.min("doc_id").alias("low")), "nodes")
    reached = table(components(links(nodes)).withColumnRenamed("node", "fingerprint"), "components")
    named = nodes.join(reached, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = named.groupBy("component").agg(F.min("first").alias("first"), F.min("low").alias("component_id"))
    labels = table(named.select("fingerprint", "component").join(first, "component").select("fingerprint", "first", "component_id"), "labels")
    return prints.join(labels, "fingerprint")


def near_duplicates(docs: DataFrame, n: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Equal fingerprints are one node however many documents share them, so copies never make pairs.
    Texts without words all have fingerprint zero and are linked like any other. Null text: no words.
    Null ids are kept; they take the group's smallest id, or null if it has none. Repeated rows come
    back each. A text of any length is hashed whole, in one task. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    return _grouped(docs, n, text_col, id_col).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a text for groups by similarity; most bits in which one, and the other two by halves, may differ.
VIEWS, VIEW_ERRORS, REST_ERRORS = 3, 16, 20
#: Up to so many classes in candidate pairs (24 bytes each) are broadcast to fetch their texts.
BROADCAST_NODES = 100_000


def shingle_set(text: bytes, n: int = 5):
    """Sorted distinct 64-bit hashes of a text's n-word shingles (ASCII lower case; of fewer words: one of all)."""
    import numpy as np

    words = text.lower().split()
    return np.unique(windows(hashes(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def views(shingles):
    """VIEWS independent 64-bit SimHashes of a set of shingles."""
    import numpy as np

    out = []
    for k in range(VIEWS):
        x = (shingles ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
        bits = bit_sums(x, [0])[0] if len(x) else np.zeros(64)
        out.append(int(np.packbits(2 * bits > len(x), bitorder="little").view("<i8")[0]))
    return out


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag, node (texts of the same words share one) and views v0, v1, v2."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            nodes, found = [], [[] for _ in range(VIEWS)]
            for t in batch.column(2).cast(pa.binary()):
                text = (t.as_py() or b"").lower()
                node = xxh3_64_intdigest(b" ".join(text.split()))
                nodes.append(node - (1 << 64) if node >> 63 else node)
                for column, v in zip(found, views(shingle_set(text, n))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), *[pa.array(v, pa.int64()) for v in found]], names=["doc_id", "tag", "node", *[f"v{k}" for k in range(VIEWS)]])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, node long, " + ", ".join(f"v{k} long" for k in range(VIEWS)))


def _meetings(nodes: DataFrame, k: int) -> DataFrame:
    """Pairs of nodes that meet under the k-th view's keys and look alike in all views: (a, b), a < b.

    Both sides file under all indices near their own, so a segment may hold two errors. The other
    views go along by halves, so that what only meets by chance never leaves the join.
    """
    i, j = (k + 1) % VIEWS, (k + 2) % VIEWS
    half = F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.shiftleft(f"v{j}", 32))
    named = nodes.select(F.col(f"v{k}").alias("v"), half.alias("w"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            v, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for at in range(0, len(v), 4096):
                rows, found = keys(v[at : at + 4096].view("<u8"), True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(v[at : at + 4096][rows]), pa.array(w[at : at + 4096][rows])], names=["k", "v", "w"])

    filed = named.distinct().mapInArrow(run, "k int, v long, w long")
    # both sides renamed alike, so that Spark shuffles them once
    named_as = lambda x: filed.select(*[F.col(c).alias(f"{c}{x}") for c in ("k", "v", "w")])
    bits = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    first = F.struct("v_a", "w_a") < F.struct("v_b", "w_b")
    met = named_as("_a").join(named_as("_b"), F.col("k_a") == F.col("k_b")).where(first & (bits("v_a", "v_b") <= VIEW_ERRORS) & (bits("w_a", "w_b") <= REST_ERRORS)).select("v_a", "w_a", "v_b", "w_b").distinct()
    side = lambda v, w, name: nodes.select(F.col(f"v{k}").alias(v), half.alias(w), F.col("node").alias(name))
    both = met.join(side("v_a", "w_a", "x"), ["v_a", "w_a"]).join(side("v_b", "w_b", "y"), ["v_b", "w_b"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_first(docs: DataFrame, n: int = 5, least: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (null first, then by a hash of the text).

    Texts are linked if their sets of n-word shingles have a Jaccard similarity of ``least`` or more;
    texts of the same words, and those with the same fingerprint in all views, are one to begin with.
    Candidates come from the Golay keys of three independent fingerprints and are verified on the
    sets, so nothing is removed that isn't similar to what stays or to a chain of removed ones. A pair
    at the limit is met with a chance of some 0.97, a closer one more surely (README has the figures).

    Columns and values are the input's. Null texts count as empty; texts without words are one group.
    Of rows with equal id and text one stays, that with the smallest other values. An empty table gives
    no rows. Texts of any length are compared whole.
    """
    columns, text = [docs[f"`{c}`"] for c in docs.columns], docs[f"`{text_col}`"]
    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    rows = table(_sketches(named, n), "sketches")
    each = [f"v{k}" for k in range(VIEWS)]
    classes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("first"), *[F.first(v).alias(v) for v in each])
    # texts with the same fingerprint in all views are one class
    nodes = table(classes.groupBy(*each).agg(F.min("node").alias("node"), F.min_by("first", "node").alias("member"), F.min("first").alias("first")), "nodes")
    met = [table(_meetings(nodes, k), "met") for k in range(VIEWS)]  # one after another, so that their shuffles don't add up
    pairs = table(reduce(DataFrame.unionByName, met).distinct(), "pairs")
    wanted = table(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes.select("node", "member.*"), "node"), "wanted")
    found = named.join(bounded(wanted.withColumnsRenamed({"doc_id": "d", "tag": "t"}), BROADCAST_NODES), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")))

    def sets(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py() or b"", n).view(np.int64) for t in batch.column(1).cast(pa.binary())], pa.list_(pa.int64()))], names=["node", "s"])

    shingled = table(found.select("node", "text").mapInArrow(sets, "node long, s array<long>").dropDuplicates(["node"]), "shingles")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(shingled.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(shingled.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    edges = alike.where(common >= least * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    reached = table(components(edges).withColumnRenamed("component", "group"), "components")
    # a row goes unless it is the first of its group; a group is that of its node's class, or the class itself
    grouped = nodes.join(reached, "node", "left").select(*each, F.coalesce("group", "node").alias("group"), "first")
    groups = grouped.groupBy("group").agg(F.min("first").alias("first"))
    named_groups = table(grouped.select(*each, "group").join(groups, "group").select(*each, "first"), "first")
    # narrow rows only: (doc_id, tag) of each text that goes, and how many equal rows each text has that stays
    narrow = rows.join(named_groups.hint("merge"), each).select("doc_id", "tag", (F.struct("doc_id", "tag") == F.col("first")).alias("stays"))
    seen = narrow.groupBy("doc_id", "tag", "stays").agg(F.count("*").alias("n")).where("not stays or n > 1")
    seen = table(seen.select(F.col("doc_id").alias("di"), F.col("tag").alias("ti"), "stays"), "gone")
    drop_table(rows, nodes, wanted, shingled, reached, named_groups, pairs, *met)
    tagged = docs.select(F.struct(*columns).alias("row"), docs[f"`{id_col}`"].cast("long").alias("d"), F.xxhash64(text).alias("t"))
    same = F.col("d").eqNullSafe(F.col("di")) & (F.col("t") == F.col("ti"))
    found = tagged.join(bounded(seen, BROADCAST_NODES), same, "left")
    once = found.where("stays is null").select("row")
    if not seen.where("stays").limit(1).count():
        return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    repeated = found.where("stays").groupBy("d", "t").agg(F.min("row").alias("row")).select("row")
    return once.union(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
