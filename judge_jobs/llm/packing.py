"""Vector bin packing of tokenised examples into fixed-length training sequences.

An example is a vector (tokens, segments, loss-bearing tokens). Sequences are filled one at a time:
among the examples that still fit, the one with the largest dot product of its vector with the room
left (both scaled by the limits) goes next, so that the scarcest resource drives the choice
(Panigrahy et al., "Heuristics for vector bin packing", 2011). Examples longer than a sequence are
cut first; when nothing fits any more, the next example is cut at the room left, so only the last
sequences of a block are short. These are split at powers of two, which need no padding.

The work is a narrow map over the input's partitions: no shuffle, and no group is ever gathered.
A task holds one block of at most ``BLOCK_TOKENS`` ids (or one document, if that is longer).
"""

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .tokens import TextEncoder, chunks

BLOCK_TOKENS = 2_000_000
BLOCK_EXAMPLES = 4096


def fill(tokens, loss, limits: tuple[int, int, int]) -> list[list[tuple[int, int, int]]]:
    """Pack examples into sequences: lists of (example, start, length).

    ``tokens[i]`` is the length of example i and ``loss[i]`` how many of its last tokens bear loss.
    ``limits`` are the most tokens, segments and loss-bearing tokens of a sequence. Ties go to the
    longer and then to the earlier example. Deterministic; every token lands in exactly one piece.
    """
    import numpy as np

    size, max_segments, max_loss = limits
    tokens, loss = np.asarray(tokens, dtype=np.int64), np.asarray(loss, dtype=np.int64)
    start = np.zeros(len(tokens), dtype=np.int64)
    sequences: list[list[tuple[int, int, int]]] = []

    def bearing(i: int, begin: int, n: int) -> int:
        """Loss-bearing tokens among the n from begin; they are the last of the example."""
        return max(0, begin + n - max(begin, int(tokens[i] - loss[i])))

    def longest(i: int, begin: int, room: int, loss_room: int) -> int:
        """The longest piece from begin that fits the room."""
        n = min(int(tokens[i]) - begin, room)
        return n if bearing(i, begin, n) <= loss_room else max(0, int(tokens[i] - loss[i]) - begin) + loss_room

    for i in np.flatnonzero((tokens > size) | (loss > max_loss)):  # whole sequences of one example
        while tokens[i] - start[i] > size or bearing(i, int(start[i]), int(tokens[i] - start[i])) > max_loss:
            n = longest(i, int(start[i]), size, max_loss)
            sequences.append([(int(i), int(start[i]), n)])
            start[i] += n
    left = tokens - start
    bear = np.minimum(left, loss)
    order = np.lexsort((np.arange(len(tokens)), -left))
    order = order[left[order] > 0]
    ids, t, b = order, left[order], bear[order]
    while len(ids):
        room, segments, loss_room = size, max_segments, max_loss
        sequence: list[tuple[int, int, int]] = []
        gone: list[int] = []
        free = np.ones(len(ids), dtype=bool)
        while room and segments:
            fits = free & (t <= room) & (b <= loss_room)
            if not fits.any():
                break
            score = t * (room / size**2) + b * (loss_room / max_loss**2) + segments / max_segments**2
            k = int(np.argmax(np.where(fits, score, -1.0)))
            i = int(ids[k])
            sequence.append((i, int(start[i]), int(t[k])))
            room, segments, loss_room = room - int(t[k]), segments - 1, loss_room - int(b[k])
            free[k] = False
            gone.append(k)
        rest = np.flatnonzero(free)
        if room and segments and len(rest):  # cut the example that is left over most
            k = int(rest[0])
            i = int(ids[k])
            n = longest(i, int(start[i]), room, loss_room)
            if n:
                sequence.append((i, int(start[i]), n))
                start[i] += n
                t[k] -= n
                b[k] = min(b[k], t[k])
        ids, t, b = np.delete(ids, gone), np.delete(t, gone), np.delete(b, gone)
        again = np.lexsort((ids, -t)) if len(t) > 1 and t[0] < t[1:].max() else slice(None)
        ids, t, b = ids[again], t[again], b[again]
        sequences.append(sequence)
    return [part for s in sequences for part in _powers(s, size)]


def _powers(sequence: list[tuple[int, int, int]], size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Split a sequence short of ``size`` at powers of two, so that no part is padded."""
    total = sum(n for _, _, n in sequence)
    if total == size:
        yield sequence
        return
    pieces = list(reversed(sequence))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part = []
        while want:
            i, s, n = pieces.pop()
            take = min(n, want)
            part.append((i, s, take))
            want -= take
            if take < n:
                pieces.append((i, s + take, n - take))
        yield part


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    prompt_col: str | None = None,
    end_id: int = 1,
    size: int = 2048,
    max_segments: int = 256,
    max_loss: int | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise examples and pack them into sequences of at most ``size`` tokens; one row for each piece.

    The tokens of ``prompt_col`` (if given) come before the text's and bear no loss. The end id is
    appended to each example. ``start`` counts the example's ids before the piece, ``offset`` is the
    piece's place in its sequence, ``ids_crc32`` is over its ids as little-endian unsigned 32-bit
    integers. With ``with_ids`` the ids themselves follow as an array.

    Null or empty text: the end id alone. Null ids pass through. Repeated rows are packed each.
    Columns other than those named are not read. An empty table gives no rows. Sequence ids depend
    on the input's partitions and row order, so give it a table read from storage, whose partitions
    a lost task reads again as they were.
    """
    limits = (size, max_segments, max_loss or size)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = TextEncoder.of(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32

        def flush(block):
            nonlocal sequence
            rows = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss", *(("ids",) if with_ids else ()))}
            for pieces in fill([len(ids) // 4 for _, ids, _ in block], [n for _, _, n in block], limits):
                offset = 0
                for i, s, n in pieces:
                    doc, ids, loss = block[i]
                    part = ids[4 * s : 4 * (s + n)]
                    total = len(ids) // 4
                    for c, v in zip(rows, (doc, s, n, zlib.crc32(part), total, sequence, offset, max(0, s + n - max(s, total - loss)))):
                        rows[c].append(v)
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    offset += n
                sequence += 1
            types = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

        def rows(part, column):
            found = encoder.encode_all(part.column(column))
            raw, offsets = found.values.to_numpy().tobytes(), found.offsets.to_pylist()
            return [raw[4 * x : 4 * y] for x, y in zip(offsets, offsets[1:])]

        block, held = [], 0
        for batch in batches:
            for part in chunks(batch, 1):
                before = rows(part, 2) if prompt_col else [b""] * part.num_rows
                for doc, prompt, ids in zip(part.column(0).to_pylist(), before, rows(part, 1)):
                    block.append((doc, prompt + ids + end, len(ids) // 4 + 1))
                    held += len(block[-1][1]) // 4
                    if held >= BLOCK_TOKENS or len(block) >= BLOCK_EXAMPLES:
                        yield flush(block)
                        block, held = [], 0
        if block:
            yield flush(block)

    columns = [f"`{c}`" for c in (id_col, text_col, prompt_col) if c]
    chosen = docs.select(docs[columns[0]].cast("long").alias("id"), *[docs[c].alias(f"t{k}") for k, c in enumerate(columns[1:])])
    return chosen.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
