"""Token-id files: raw id payloads with a minimal perfect hash from document key to place.

A data set is a folder of ``*.ids`` files and a Parquet ``manifest``. A file holds the documents' ids one
after another in ascending key order (unsigned 16-bit where the vocabulary allows it, else 32-bit,
little-endian), then the start of each document, the sorted keys, the hash index and a fixed footer. A
task writes ids as they come and begins a new file after ``FILE_IDS``, so what it holds doesn't depend
on the number or size of partitions. The index follows Limasset et al., "Fast and scalable minimal perfect
hashing for massive key sets" (2017): level by level, keys whose hash falls alone on a bit settle
there, the others go on to the next level; the rank of a key's bit is its slot. Each slot stores a
32-bit fingerprint of its key and the key's record number, so a lookup costs a few probes whatever
the size of the shard, and an absent key is refused but for a chance of 2^-32.

Task attempts write to files of their own name; only files named by rows of finished tasks enter the
manifest, so lost or doubled attempts leave no trace in the data set.
"""

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, sized_partitions
from .tokens import TextEncoder, chunks

MAGIC = b"TOKIDS02"
FOOTER = struct.Struct("<8sQQQQQQ")  # magic, bytes an id, ids, records, keys, index words, levels
#: Ids after which a file is closed; it may be longer by one document.
FILE_IDS = 16_000_000
LEVELS = 64


def _hash(keys, seed: int):
    """64-bit mix of 64-bit keys (splitmix64 finaliser)."""
    import numpy as np

    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys. ``sizes``: bits of each level; ``words``: all bits."""

    def __init__(self, sizes, words):
        import numpy as np

        self.sizes, self.words = sizes, words
        self.first = np.concatenate(([0], np.cumsum(sizes)))  # bit at which each level begins
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(words)))).astype(np.int64)

    @classmethod
    def build(cls, keys) -> "PerfectHash":
        import numpy as np

        sizes, levels, left, level = [], [], keys, 0
        while len(left):
            if level >= LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            m = 64 * max(1, -(-2 * len(left) // 64))
            at = (_hash(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            left, level = left[~alone[at]], level + 1
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, keys):
        """The slot of each key, or -1 where no level holds its bit. An absent key may get any slot."""
        import numpy as np

        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            bit = (_hash(keys[open_], level) % np.uint64(m)).astype(np.int64) + self.first[level]
            word, below = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = ((word >> below) & np.uint64(1)).astype(bool)
            under = np.bitwise_count(word & ((np.uint64(1) << below) - np.uint64(1)))
            out[open_[hit]] = (self.rank[bit >> 6] + under)[hit]
            open_ = open_[~hit]
        return out


def fingerprint(keys):
    import numpy as np

    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Writes one file to a stream: ids as they come, the index at the end. Keys come in ascending order, nulls first."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.keys, self.lengths, self.n_ids = stream, width, [], [], 0

    def add(self, keys: list[int | None], lengths, ids) -> None:
        """Append documents: their keys, numbers of ids, and all ids one after another."""
        self.stream.write(ids.astype("<u2" if self.width == 2 else "<u4", copy=False).tobytes())
        self.keys += keys
        self.lengths.append(lengths)
        self.n_ids += len(ids)

    def close(self) -> None:
        import numpy as np

        starts = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]).astype("<u8")
        null = sum(k is None for k in self.keys)
        known = np.array(self.keys[null:], dtype="<i8")
        distinct, record = np.unique(known, return_index=True)
        distinct = distinct.astype("<u8")
        index = PerfectHash.build(distinct)
        slot = index.slots(distinct)
        prints, records = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8")
        prints[slot], records[slot] = fingerprint(distinct), record + null
        footer = FOOTER.pack(MAGIC, self.width, self.n_ids, len(self.keys), len(distinct), len(index.words), len(index.sizes))
        for part in (starts.tobytes(), struct.pack("<Q", null), known.tobytes(), index.sizes.astype("<u8").tobytes(), index.words.tobytes(), prints.tobytes(), records.tobytes(), footer):
            self.stream.write(part)


class Shard:
    """A shard file's bytes, opened for scans and keyed lookups."""

    def __init__(self, data):
        import numpy as np

        magic, self.width, n_ids, self.n, n_keys, n_words, n_levels = FOOTER.unpack_from(data, len(data) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = 0

        def section(dtype: str, n: int):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.ids = section("<u2" if self.width == 2 else "<u4", n_ids)
        self.starts = section("<u8", self.n + 1)
        (self.null,) = section("<u8", 1)
        self.null = int(self.null)
        self.keys = section("<i8", self.n - self.null)
        self.index = PerfectHash(section("<u8", n_levels).astype(np.int64), section("<u8", n_words))
        self.prints, self.records = section("<u4", n_keys), section("<u8", n_keys)

    def find(self, keys):
        """First record of each key, or -1 for an absent one; one vectorised pass over the levels."""
        import numpy as np

        keys = np.asarray(keys, dtype="<i8").view("<u8")
        slot = self.index.slots(keys)
        if not len(self.prints):
            return np.full(len(keys), -1)
        good = (slot >= 0) & (self.prints[slot] == fingerprint(keys))
        return np.where(good, self.records[slot].astype(np.int64), -1)

    def record(self, r: int) -> bytes:
        """The ids of a record as little-endian unsigned 32-bit integers."""
        return self.ids[int(self.starts[r]) : int(self.starts[r + 1])].astype("<u4").tobytes()


def _filesystem(uri: str):
    """A file system and a path in it for any URI that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, text_col: str = "text", id_col: str = "doc_id", partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode texts and write them as token-id files under ``path``; returns the manifest.

    Rows are range-partitioned by key, so files and the ids in them ascend. Null text: the end id
    alone. Null keys come first; they are stored but have no index entry. Rows that repeat a key are
    all stored side by side, in the order of a hash of their texts, over several partitions and files
    if there are many; the index leads to the first. A text of any length is encoded whole, in one
    task. Other columns are not read. The manifest (one row for each file) has the file, its first and
    last key, its counts, and ``first_id``, the ids of all files before it.
    """
    spark = docs.sparkSession
    n = partitions or sized_partitions(spark)
    named = docs.select(docs[f"`{id_col}`"].cast("long").alias("key"), docs[f"`{text_col}`"].alias("text"))
    # the last of the three tells even equal rows apart, so that no key or row is too many for a partition
    order = [F.col("key").asc_nulls_first(), "tag", "nth"]
    ordered = named.withColumns({"tag": F.xxhash64("text"), "nth": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = TextEncoder.of(tokenizer)
        width = 2 if encoder.library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        context, store, folder = TaskContext.get(), *_filesystem(path)
        store.create_dir(folder, recursive=True)
        attempt, writer, name, rows = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}", None, "", []

        def finish():
            writer.close()
            writer.stream.close()
            keys = writer.keys
            rows.append((context.partitionId(), len(rows), name, next((k for k in keys if k is not None), None), keys[-1], len(keys), writer.n_ids))

        for batch in batches:
            for part in chunks(batch, 1):
                found = encoder.encode_all(part.column(1))
                keys, offsets, values = part.column(0).to_pylist(), found.offsets.to_numpy(), found.values.to_numpy()
                # an end id after each document
                lengths = np.diff(offsets) + 1
                ids = np.full(len(values) + len(keys), end_id, dtype="<u4")
                inner = np.ones(len(ids), dtype=bool)
                ends = np.cumsum(lengths)
                inner[ends - 1] = False
                ids[inner] = values
                at = 0
                while at < len(keys):
                    if writer is None:
                        name = f"{attempt}-{len(rows):05d}.ids"
                        writer = ShardWriter(store.open_output_stream(f"{folder}/{name}"), width)
                    before = ends[at - 1] if at else 0
                    end = min(len(keys), int(np.searchsorted(ends, before + file_ids - writer.n_ids)) + 1)
                    writer.add(keys[at:end], lengths[at:end], ids[before : ends[end - 1]])
                    at = end
                    if writer.n_ids >= file_ids:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4))], names=[x.split()[0] for x in MANIFEST.split(", ")[:-1]])

    schema = MANIFEST.rsplit(", ", 1)[0]
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/attempted")
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spark.read.schema(schema).parquet(f"{path}/attempted").withColumn("first_id", before).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


MANIFEST = "shard long, part long, file string, first_key long, last_key long, n_docs long, n_ids long, first_id long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a data set, found by its key: doc_id, start, n_tokens, ids_crc32 (and ids).

    A task reads one file at a time. Known keys go through the hash index and its fingerprints; rows that
    repeat a key follow its first record.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        store, folder = _filesystem(path)
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{folder}/{file}") as f:
                    shard = Shard(f.read())
                found = shard.find(shard.keys)
                same = np.concatenate(([0], np.cumsum(shard.keys[1:] != shard.keys[:-1]))) if len(shard.keys) else np.zeros(0, int)
                nth = np.arange(len(same)) - np.searchsorted(same, same)
                if (found < 0).any():
                    raise ValueError(f"{file}: a stored key is missing from the index")
                records = [*range(shard.null), *(found + nth).tolist()]
                keys = [None] * shard.null + shard.keys.tolist()
                for a in range(0, len(records), 2000):
                    part = [shard.record(r) for r in records[a : a + 2000]]
                    columns = [pa.array(keys[a : a + 2000], pa.int64()), pa.array([first + int(shard.starts[r]) for r in records[a : a + 2000]], pa.int64()), pa.array([len(x) // 4 for x in part], pa.int64()), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in part], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    shards = manifest(spark, path).select("file", "first_id")
    files = shards.repartition(sized_partitions(spark), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Keyed access: for each distinct wanted key its start, n_tokens and ids_crc32, null where the key is absent or null.

    A key is routed to the first file whose last key isn't smaller (the driver sends the tasks 16 bytes
    for each file, of some 32 MB) and found by that file's index; keys of a file are looked up together.
    Of rows that repeat a key the first is found.
    """
    spark = keys.sparkSession
    wanted = keys.select(keys[f"`{id_col}`"].cast("long").alias("doc_id")).distinct()
    files = manifest(spark, path).where("last_key is not null").orderBy("shard", "part").select("file", "first_id", "last_key").collect()
    ends, names = spark.sparkContext.broadcast([f.last_key for f in files]), spark.createDataFrame([(k, f.file, f.first_id) for k, f in enumerate(files)], "at long, file string, first_id long")

    def route(batches):
        import numpy as np
        import pyarrow as pa

        last = np.array(ends.value, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0)
            at = np.searchsorted(last, ids.fill_null(0).to_numpy())
            none = ids.is_null().to_numpy(zero_copy_only=False) | (at == len(last))
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, mask=none)], names=["doc_id", "at"])

    routed = wanted.mapInArrow(route, "doc_id long, at long").join(names, "at", "left")

    def run(key, group):
        import pyarrow as pa

        file, docs = key[0].as_py(), group.column("doc_id").combine_chunks()
        none = pa.nulls(len(docs), pa.int64())
        if file is None:
            return pa.table([docs, none, none, none], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        store, folder = _filesystem(path)
        with store.open_input_file(f"{folder}/{file}") as f:
            shard = Shard(f.read())
        first = group.column("first_id")[0].as_py()
        rows = [None if r < 0 else (first + int(shard.starts[r]), int(shard.starts[r + 1] - shard.starts[r]), zlib.crc32(shard.record(r))) for r in shard.find(docs.to_numpy(zero_copy_only=False)).tolist()]
        return pa.table([docs, *[pa.array([None if x is None else x[k] for x in rows], pa.int64()) for k in range(3)]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return routed.groupBy("file").applyInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write documents as a new data set in the shared folder and read it back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-ids")
    write(docs, path, tokenizer, **options)
    return read(spark, path)
