"""Substring deduplication with difference-cover anchors.

Every residue modulo ``PERIOD`` is a difference of two members of ``COVER``. So if the same 50 words
start at place i of one document and at j of another, some shift s below the period brings both i + s
and j + s onto cover places: anchors of 50 - PERIOD + 1 words hashed only at cover places (six in
31) meet for every such match, however the two lie. Anchors that only one text has are done with.
Around the others the match is extended to every 50-word window that holds one, these windows are
compared as a whole by 128-bit hashes, and a window goes if it also starts in a document with a smaller
id.

Texts with the same words are taken together first, so groups of copies cost one text. A very common
passage is one row for each text that holds it, and the table it is joined with has one row for each
window: the work grows with the input, not with pairs of documents.
"""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
MEMO_WORDS = 400_000


class _Words(dict):
    """64-bit hashes of words, remembered by one Python worker; starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO_WORDS:
            self.clear()
        out = self[word] = xxh64_intdigest(word, 7)
        return out


_words = _Words()


def hashes(words: list[bytes]):
    import numpy as np

    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(a, b, seed: int):
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + ((b << np.uint64(29)) | (b >> np.uint64(35))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def windows(hashed, size: int, seed: int = 0):
    """A 64-bit hash of each ``size`` consecutive entries, by doubling."""
    out, done, power, width = None, 0, hashed, 1
    n = len(hashed) - size + 1
    while True:
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _mix(out, part, seed)
            done += width
        if 2 * width > size:
            return out
        power = _mix(power[:-width], power[width:], seed)
        width *= 2


def anchor_places(n_words: int):
    """Cover places at which an anchor of a text with so many words begins, ascending."""
    import numpy as np

    p = np.arange(max(0, n_words - ANCHOR + 1)) if n_words >= WINDOW else np.arange(0)
    return p[np.isin(p % PERIOD, COVER)]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, sha (of all words) and anchors (their hashes, in the order of their places)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            counts, digests, anchors = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(windows(hashes(words), ANCHOR)[anchor_places(len(words))].view(np.int64) if len(words) >= WINDOW else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "tag", "n_words", "sha", "anchors"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id long, tag long, n_words long, sha binary, anchors array<long>")


def _candidates(flagged: DataFrame) -> DataFrame:
    """Windows that hold a shared anchor: 128-bit hash, document, place; gives (some smaller text may need it: role 1; it may itself go: role 2; both: 3)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for doc, tag, text, places, roles in zip(*[batch.column(k) for k in range(5)]):
                hashed = hashes(text.as_py().encode().split())
                at, role = np.array(places.as_py(), dtype=np.int64), np.array(roles.as_py(), dtype=np.int64)
                n = len(hashed) - WINDOW + 1
                found = np.zeros(n, dtype=np.int64)
                starts = anchor_places(len(hashed))[at]
                for bit in (1, 2):
                    edge = np.zeros(n + 1, dtype=np.int64)
                    mine = starts[(role & bit) > 0]
                    np.add.at(edge, np.maximum(0, mine + ANCHOR - WINDOW), 1)
                    np.add.at(edge, np.minimum(n, mine + 1), -1)
                    found |= bit * (np.cumsum(edge)[:n] > 0)
                p = np.flatnonzero(found)
                if len(p):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(windows(hashed, WINDOW, seed)[p].view(np.int64)) for seed in (1, 2)] + [pa.array(np.full(len(p), doc.as_py(), dtype=np.int64)), pa.array(np.full(len(p), tag.as_py(), dtype=np.int64)), pa.array(p.astype(np.int32)), pa.array(found[p].astype(np.int8))],
                        names=["h1", "h2", "doc_id", "tag", "place", "role"],
                    )

    return flagged.mapInArrow(run, "h1 long, h2 long, doc_id long, tag long, place int, role byte")


def _kept(rows: DataFrame) -> DataFrame:
    """Strip removed windows: columns doc_id, sha (of all words), n_removed, kept_sha256, and the kept text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            shas, gone, digests, texts = [], [], [], []
            for text, places in zip(batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                p = np.array(places.as_py(), dtype=np.int64)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + WINDOW, -1)
                out = np.cumsum(edge)[:-1] > 0
                left = b" ".join([w for w, x in zip(words, out.tolist()) if not x])
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                gone.append(int(out.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(gone, pa.int64()), pa.array(digests), pa.array(texts, pa.string())], names=["doc_id", "sha", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, sha binary, n_removed long, kept_sha256 string, kept string")


def removed_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For columns doc_id (long) and text: one row for each text, and the removed windows of those that lose some.

    First: doc_id, tag, n_words, sha (of all words). Second: doc_id, tag, text, places. ``tag``, a hash
    of the raw text, tells apart rows that share an id.
    """
    docs = docs.withColumn("tag", F.xxhash64("text"))
    texts = table(_texts(docs), "texts")
    # of texts with the same words only the one with the smallest id can lose a part and not all
    able = texts.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = table(able.groupBy("sha").agg(F.min_by("anchors", "doc_id").alias("anchors"), F.min("doc_id").alias("doc_id"), F.min_by("tag", "doc_id").alias("tag")).select("doc_id", "tag", "anchors"), "first")
    slim = table(texts.drop("anchors"), "words")
    drop_table(texts)
    places = first.select("doc_id", "tag", F.posexplode("anchors").alias("k", "anchor"))
    shared = table(places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "anchors")
    role = (F.col("doc_id") < F.col("high")).cast("int") + F.when(F.col("low") < F.col("doc_id"), 2).otherwise(0)
    marked = places.join(shared, "anchor").select("doc_id", "tag", "k", role.alias("role"))
    flagged = table(marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("k", "role")).alias("found")), "flagged")
    drop_table(first)
    drop_table(shared)
    whole = table(docs.join(flagged, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", "text", F.col("found.k").alias("places"), F.col("found.role").alias("roles")), "whole")
    found = table(_candidates(whole), "windows")
    held = table(found.where(F.col("role").bitwiseAND(F.lit(1)) > 0).groupBy("h1", "h2").agg(F.min("doc_id").alias("low")), "held")
    lost = found.where(F.col("role").bitwiseAND(F.lit(2)) > 0).join(held, ["h1", "h2"]).where("low < doc_id").groupBy("doc_id", "tag").agg(F.collect_list("place").alias("places"))
    lost = table(lost, "lost")
    drop_table(found)
    drop_table(held)
    return slim, whole.select("doc_id", "tag", "text").join(lost, ["doc_id", "tag"])


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Take from each document the words of every 50-word window that a document with a smaller id has too.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the text that is left, its words joined by
    one space; null where nothing was removed, as the text itself is at hand then, and empty where all was).

    Null text: no words. Rows that share an id don't remove from each other; rows with a null id lose
    nothing and take nothing. Texts of fewer than 50 words have no windows; one of any length is cut into words whole,
    in one task. Repeated rows keep the same words each. Other columns of ``docs``
    are not read. An empty table gives no rows.
    """
    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    texts, lost = removed_places(named)
    cut = table(_kept(lost), "kept")
    # a text is the first of its kind if its id is; the others go whole
    first = texts.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = texts.select("doc_id", "n_words", "sha").join(first, ["doc_id", "sha"], "left").join(cut, ["doc_id", "sha"], "left")
    whole = (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, "").otherwise(F.col("kept")).alias("kept"),
    )
