"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, groups.

Lines are normalised (ASCII lower case, ASCII punctuation as space, single spaces) and equal ones are one
class, however often they occur. The similarity asked for leaves most words of a line alone, so by the
pigeonhole principle some block of words stays whole: where at most a fifth of n words are touched, three words in
a row (four, from 14 words) are not. Classes meet by all such blocks, short ones by what is left without one or
two of their words. What meets must have lengths and 192-bit SimHashes that fit, and is verified by the edit
similarity of the normalised lines. Of each connected group the first occurrence stays (smallest doc_id, then line).

Blocks are of words and not of the bits of the print: one word changed among eight moves some 10 of 64 bits,
so two prints of similar lines rarely share a block of bits (README has the shares), while their words do.

Lines that share many words in a row share many blocks. Each block goes with the word before it, and two lines are
paired under a block only where these words differ or one of the lines begins there: at the first block of what they
have in common, so once and not under each block, and no pair is lost. Blocks with one word before them in all lines are left out.
Keys are worked out and shuffled a share at a time (PASSES), and pairs meet their texts so many at a time, so that disk doesn't grow with their number.

Only groups matter, so not every pair is looked at: classes alone in a bucket go at once, small buckets
are paired, and in a larger one each class is first compared with one of them, drawn by one of four
hashes, so that a class of many buckets meets several others. What is then still in different groups is paired, so no link between groups is lost, while many variants of one line
cost about one pair each.
"""

from functools import reduce
from itertools import chain, combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bit_sums, bounded, drop_table, table
from .graph import components, merged
from .substrings import _mix
from .tokens import chunks

#: Lines with fewer words than this stay, whatever they repeat. One: all but blank lines count.
LEAST_WORDS = 1
SIMILARITY = 0.8
#: Bits of 192 in which the SimHashes of two lines may differ to be looked at further (unrelated ones differ in some 90), unless the shorter has so few characters.
ERRORS, FEW_CHARACTERS = 68, 40
#: What is left of large buckets is paired in steps of so many bits. One: what a first step links spares few pairs of the next (README), and each step joins the texts anew.
STEPS = (ERRORS,)
#: Features of a SimHash: runs of so many bytes, one in so many (by their hashes, so the same wherever they stand). A changed letter spoils six runs, and not whole words
#: and their neighbours, so noise in the letters moves few bits; shorter runs are shared by unrelated lines.
GRAM, GRAMS_ONE_IN = 6, 2
#: A longer word (a line without spaces, say) counts as several, cut after bytes of a class: in the same places wherever it stands.
LONG_WORD = 24
#: Words in a block, fewest and most words of a line that has such blocks. A line is filed by each of them.
BLOCKS = ((3, 7, 16), (4, 14, 1 << 30))
#: Keys are shuffled in so many shares, one after the other.
PASSES = 4
#: Rows of one key up to which a task holds them to see how many there are.
HELD = 100_000
#: Lines of so many words also meet without one of them, or two (up to the second bound).
WITHOUT_ONE, WITHOUT_TWO = 10, 8
#: Lines of so many characters also meet by deletions of characters: two (up to the first bound) or one.
TINY, SMALL = 14, 24
#: Buckets with more classes are linked through a hub first; only what that leaves apart is paired.
BUCKET = 8
#: Lines with more characters are compared one pair after the other; shorter ones together, so many characters at once.
LONG_LINE, TOGETHER = 4000, 200_000
#: Pairs that meet their texts at once, for each class of lines, and at least.
PAIRS_A_CLASS, PAIRS = 0.5, 200_000
#: Rows of ids (8 to 40 bytes each) up to which they are broadcast: the driver holds a broadcast several times over, and some at once.
BROADCAST_ROWS = 20_000

_NORMAL = bytes(b if b >= 128 or b == 10 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def normalise(line: bytes) -> bytes:
    return b" ".join(line.translate(_NORMAL).split())


def parts(line: bytes) -> list[bytes]:
    """The words of a line. A line of signs alone has those (split at white space) for words; a blank one has none."""
    return line.translate(_NORMAL).split() or line.split()


def distance(a: str, b: str, most: int) -> int:
    """Edit distance of two strings, or ``most`` + 1 if it is larger: bit vectors (Myers 1999), one step for each character."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    begin, end = 0, len(a)
    while begin < end and a[begin] == b[begin]:
        begin += 1
    back = len(b)
    while end > begin and a[end - 1] == b[back - 1]:
        end, back = end - 1, back - 1
    a, b = a[begin:end], b[begin:back]
    if not a:
        return min(len(b), most + 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for k, c in enumerate(b):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        score += bool(plus & top) - bool(minus & top)
        if score - (len(b) - k - 1) > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        v = eq | down
        up, down = minus | (full & ~(v | plus)), plus & v
    return score


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return distance(a, b, most) <= most


def apart(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether two lines can't be similar, by a count: an edit of one character changes at most two pairs of neighbours in each line."""
    import numpy as np

    if not (a.isascii() and b.isascii()):
        return False
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    pairs = lambda z: np.bincount((z[:-1] * 37 + z[1:]) & 1023, minlength=1024)
    return int(np.abs(pairs(x) - pairs(y)).sum()) > 4 * int((1 - least) * max(len(a), len(b)) + 1e-9)


def _within(cores: list, most: list[int]):
    """Whether the edit distance of each pair of code arrays is at most its bound: antidiagonals of a band, for all pairs at once.

    Of each pair the first is no shorter than the second, by no more than the bound, and none is empty.
    """
    import numpy as np

    n, most = len(cores), np.array(most)
    sizes = np.array([(len(a), len(b)) for a, b in cores])
    rows, columns = sizes.max(axis=0).tolist()
    # a path within the bound strays from the main diagonal so far that it can still come back (Ukkonen 1985)
    more = sizes[:, 0] - sizes[:, 1]
    below, above = int(((most + more) // 2).max()), int(((most - more) // 2).max())
    codes = np.uint16 if max(int(max(a.max(), b.max())) for a, b in cores) < 1 << 16 else np.uint32
    x, y = np.zeros((rows, n), codes), np.zeros((columns, n), codes)  # y runs backwards, so that an antidiagonal is a slice of both
    for k, (a, b) in enumerate(cores):
        x[: len(a), k] = a
        y[columns - len(b) :, k] = b[::-1]
    far = np.uint16(1 << 15)
    older, last, now = (np.full((rows + 2, n), far, np.uint16) for _ in range(3))
    last[0] = 0
    out, left, ends = np.zeros(n, bool), np.arange(n), sizes.sum(axis=1)
    differ, stops = np.empty((below + above + 2, n), bool), set(ends.tolist())
    for s in range(1, rows + columns + 1):
        low, high = max((s - above + 1) // 2, s - columns, 1), min((s + below) // 2, rows, s - 1)
        if low <= high:
            cell, step, other = now[low : high + 1], older[low - 1 : high], differ[: high + 1 - low]
            np.not_equal(x[low - 1 : high], y[columns - s + low : columns - s + high + 1], out=other)
            np.add(step, other, out=step)  # the oldest antidiagonal isn't read again
            np.minimum(last[low - 1 : high], last[low : high + 1], out=cell)
            np.add(cell, 1, out=cell)
            np.minimum(cell, step, out=cell)
        now[low - 1] = s if low == 1 and s <= min(above, columns) else far
        now[high + 1] = s if high == s - 1 and s <= min(below, rows) else far
        if s in stops:
            done = np.flatnonzero(ends == s)
            out[left[done]] = now[sizes[done, 0], done] <= most[done]
        if s % 16 == 0:
            near = np.minimum(now[low - 1 : high + 2].min(axis=0), last[max(low - 2, 0) : high + 2].min(axis=0))
            stay = (near <= most) & (ends > s)
            if not stay.any():
                break
            if 4 * stay.sum() < 3 * len(stay):
                x, y, older, last, now, differ = (z.compress(stay, axis=1) for z in (x, y, older, last, now, differ))
                most, sizes, ends, left = most[stay], sizes[stay], ends[stay], left[stay]
        older, last, now = last, now, older
    return out


def similar_pairs(first: list[bytes], second: list[bytes], least: float = SIMILARITY):
    """:func:`similar` of pairs of UTF-8 lines, as an array. What both begin or end with is left out; pairs of like lengths are compared together."""
    import numpy as np

    out, rest = np.zeros(len(first), bool), []
    for k, (a, b) in enumerate(zip(first, second)):
        plain = a.isascii() and b.isascii()
        x, y = (np.frombuffer(z, np.uint8) if plain else np.frombuffer(z.decode().encode("utf-32-le"), np.uint32) for z in (a, b))
        longer, shorter = max(len(x), len(y)), min(len(x), len(y))
        most = int((1 - least) * longer + 1e-9)
        if longer - shorter > most:
            continue
        differ = np.flatnonzero(x[:shorter] != y[:shorter])
        same = int(differ[0]) if len(differ) else shorter
        x, y, shorter = x[same:], y[same:], shorter - same
        differ = np.flatnonzero(x[len(x) - shorter :] != y[len(y) - shorter :])
        same = shorter - 1 - int(differ[-1]) if len(differ) else shorter
        x, y = x[: len(x) - same], y[: len(y) - same]
        if max(len(x), len(y)) <= most:
            out[k] = True
        elif max(len(x), len(y)) > LONG_LINE:
            out[k] = not apart(a, b, least) and similar(a.decode(), b.decode(), least)
        elif len(x) and len(y):
            rest.append((max(len(x), len(y)), k, (x, y) if len(x) >= len(y) else (y, x), most))
    rest.sort(key=lambda r: r[:2])
    begin = 0
    while begin < len(rest):
        end = begin + 1
        while end < len(rest) and (end + 1 - begin) * rest[end][0] <= TOGETHER:
            end += 1
        out[[k for _, k, _, _ in rest[begin:end]]] = _within([z for _, _, z, _ in rest[begin:end]], [m for *_, m in rest[begin:end]])
        begin = end
    return out


_powers: list = []


def words_of(lines):
    """Words of an Arrow array of normal forms (none is empty): their 64-bit hashes, bytes, and the line of each; vectorised over all bytes."""
    import numpy as np

    offsets = lines.offsets.to_numpy().astype(np.int64) if hasattr(lines, "offsets") else np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    n, begin = len(data), offsets[:-1] - offsets[0]
    if not _powers or len(_powers[0]) < n:
        step = np.uint64(0x9E3779B97F4A7C15)
        up = np.full(n, step)
        down = np.full(n, np.uint64(pow(int(step), -1, 1 << 64)))
        up[:1] = down[:1] = 1
        letters = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), letters, np.arange(256) * 167 % 7 == 0]
    up, down, letters, cuts = _powers
    start = np.zeros(n + 1, bool)
    start[begin] = True
    start[np.flatnonzero(data == 32) + 1] = True

    def places():
        at = np.flatnonzero(start[:n])
        end = np.append(at[1:], n)
        return at, end - (data[end - 1] == 32)

    at, end = places()
    long = end - at > LONG_WORD
    if long.any():
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, at[long] + 1, 1)
        np.add.at(depth, end[long], -1)
        start[1:n] |= (np.cumsum(depth)[1:n] > 0) & cuts[data[:-1]]
        at, end = places()
    total = np.append(np.uint64(0), np.cumsum(letters[data] * up[:n], dtype=np.uint64))
    x = (total[end] - total[at]) * down[at]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32)), end - at, np.searchsorted(begin, at, side="right") - 1


def simhashes(lines):
    """192-bit SimHashes of an Arrow array of normal forms (none is empty), over runs of GRAM bytes: an array of three columns."""
    import numpy as np

    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data, sizes = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
    n, grams = len(data), np.zeros(len(data), np.uint64)
    for k in range(GRAM):
        grams <<= np.uint64(8)
        grams[: max(n - k, 0)] |= data[k:]
    grams = _mix(grams, grams, GRAM)
    chosen = (grams >> np.uint64(40)) % np.uint64(GRAMS_ONE_IN) == 0
    # a run that reaches into the next line doesn't count; a line's first one does, so that none is without
    for k in range(1, GRAM):
        chosen[np.maximum(offsets[1:] - offsets[0] - k, offsets[:-1] - offsets[0])] = False
    chosen[offsets[:-1] - offsets[0]] = True
    hashed, line = grams[chosen], np.repeat(np.arange(len(sizes)), sizes)[chosen]
    counts = np.bincount(line, minlength=len(lines))
    starts = np.cumsum(counts) - counts
    columns = [np.packbits(2 * bit_sums(_mix(hashed, hashed, seed), starts) > counts[:, None], axis=1, bitorder="little").view("<i8").ravel() for seed in (5, 6, 8)]
    return np.stack(columns, axis=1)


def short_keys(line: bytes) -> set[int]:
    """Hashes of a short line without some of its words or characters: short lines with such a difference share one."""
    from xxhash import xxh3_64_intdigest

    words = line.split()
    n = len(words)
    left = {b" ".join(x) for d in range(3 if n <= WITHOUT_TWO else 2) if n > d for x in combinations(words, n - d)}
    text = line.decode()
    if 4 <= len(text) <= SMALL:
        most = 2 if len(text) <= TINY and len(text) >= 8 else 1
        left |= {"".join(x).encode() for d in range(most + 1) for x in combinations(text, len(text) - d)}
    return {xxh3_64_intdigest(x) for x in left}


def block_keys(hashed, line):
    """(line, key, before) arrays: all blocks of words of each line, and the word before each (0: the line begins there). The words come as from :func:`words_of`."""
    import numpy as np

    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    counts = np.bincount(line)[line]
    before = np.append(np.uint64(0), np.maximum(hashed[:-1], np.uint64(1)))
    before[np.append(True, line[1:] != line[:-1])] = 0
    out = []
    for width, least, most in BLOCKS:
        n = max(len(hashed) - width + 1, 0)
        at = np.flatnonzero((line[:n] == line[width - 1 :]) & (counts[:n] >= least) & (counts[:n] <= most))
        key = hashed[at]
        for k in range(1, width):
            key = _mix(key, hashed[at + k], width)
        owner, word = line[at], before[at]
        # of a word that is repeated over and over one block does
        other = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]))[: len(at)]
        out.append((owner[other], key[other], word[other]))
    return tuple(np.concatenate(x) for x in zip(*out))


def keys_before(lines):
    """(line, key, before) arrays of an Arrow array of normal forms: all keys under which each is filed, with the word before a block (0: none)."""
    import numpy as np

    hashed, _, line = words_of(lines)
    rows, keys, before = block_keys(hashed, line)
    found = [(k, key) for k in np.flatnonzero(np.bincount(line, minlength=len(lines)) <= WITHOUT_ONE).tolist() for key in short_keys(lines[k].as_py())]
    if found:
        rows, keys = np.append(rows, [k for k, _ in found]), np.append(keys, np.array([key for _, key in found], dtype=np.uint64))
        before = np.append(before, np.zeros(len(found), np.uint64))
    return rows, keys, before


def meeting_keys(lines):
    """(line, key) arrays of an Arrow array of normal forms: all keys under which each is filed."""
    return keys_before(lines)[:2]


def _lines(docs: DataFrame, least_words: int, forms: bool) -> DataFrame:
    """A row for each line of at least ``least_words`` words: its place, the 128-bit hash (h1, h2) of its normal form and, with ``forms``, that."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows, norm, places = [], [], []
                for k, t in enumerate(part.column(2).cast(pa.binary())):
                    text = t.as_py() or b""
                    raw = None
                    for place, line in enumerate(text.translate(_NORMAL).split(b"\n")):
                        found = line.split()
                        if not found and text:
                            raw = raw or text.split(b"\n")
                            found = raw[place].split()
                        if len(found) >= least_words:
                            rows.append(k)
                            places.append(place)
                            norm.append(b" ".join(found))
                if not rows:
                    continue
                digest = np.frombuffer(b"".join(map(xxh3_128_digest, norm)), dtype="<i8").reshape(-1, 2)
                ids = pa.array(rows)
                columns = [part.column(0).take(ids), part.column(1).take(ids), pa.array(places, pa.int32()), pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), *([pa.array(norm, pa.binary())] if forms else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "line", "h1", "h2", "norm"][: len(columns)])

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, line int, h1 long, h2 long" + ", norm binary" * forms)


def _met(classes: DataFrame, share: int) -> DataFrame:
    """k, id, before, met: classes under the keys of one of PASSES shares, with the word before; ``met`` is how many rows a key has, HELD or more of very common ones.

    Keys of one class alone, and those with the same word before them in all classes (which also meet one word earlier), are left out.
    """

    def file(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in chunks(batch, 1, 2_000_000):
                rows, keys, before = keys_before(part.column(1))
                own = np.flatnonzero((keys >> np.uint64(32)) % np.uint64(PASSES) == share)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].view("<i8")), part.column(0).take(pa.array(rows[own])), pa.array(before[own].view("<i8"))], names=["k", "id", "before"])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        held, going = [np.zeros(0, np.int64)] * 3, None  # rows of the last key, which may go on; a key whose rows go out as they come
        for batch in chain(batches, [None]):
            last = batch is None
            k, i, b = held if last else (np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns))
            if not len(k):
                continue
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            n = np.diff(np.append(first, len(k)))
            least, most = (lambda x: np.minimum.reduceat(x, first)), (lambda x: np.maximum.reduceat(x, first))
            meets = (least(i) < most(i)) & ((least(b) < most(b)) | (np.add.reduceat(b == 0, first) > 1))
            if k[0] == going:
                meets[0], n[0] = True, max(n[0], HELD)
            size = np.diff(np.append(first, len(k)))
            ready = len(k) if last or (meets[-1] and n[-1] >= HELD) else first[-1]
            going = k[-1] if ready == len(k) else None
            once = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))
            out = np.flatnonzero((np.repeat(meets, size) & once)[:ready])
            held = [z[ready:] for z in (k, i, b)]
            yield pa.RecordBatch.from_arrays([*[pa.array(z[out]) for z in (k, i, b)], pa.array(np.repeat(n, size)[out])], names=["k", "id", "before", "met"])

    filed = classes.select("id", "norm").mapInArrow(file, "k long, id long, before long")
    return filed.repartition("k").sortWithinPartitions("k", "id", "before").mapInArrow(meet, "k long, id long, before long, met long")


def _sketched(rows: DataFrame) -> DataFrame:
    """id, size (characters) and SimHash (s1, s2, s3) of normal forms."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in chunks(batch, 1, 2_000_000):
                prints, text = simhashes(part.column(1)), part.column(1).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pc.utf8_length(text), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(prints[:, 2])], names=["id", "size", "s1", "s2", "s3"])

    return rows.select("id", "norm").mapInArrow(run, "id long, size int, s1 long, s2 long, s3 long")


ATTRIBUTES = ("id", "size", "s1", "s2", "s3")


def _fits(errors: int = ERRORS, above: int | None = None):
    """Whether two classes can be similar by their lengths, and look alike by their SimHashes. With ``above``: and didn't by so many bits."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in ("s1", "s2", "s3")), F.lit(0))
    few = F.least("size", "size_b") < FEW_CHARACTERS
    alike = (differ <= errors) | few if above is None else (differ <= errors) & (differ > above) & ~few
    return (5 * F.abs(F.col("size") - F.col("size_b")) <= F.greatest("size", "size_b")) & alike


def _other(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("k", *[F.col(c).alias(f"{c}_b") for c in (*ATTRIBUTES, *more)])


def _begun(buckets: DataFrame):
    """The column of ``buckets`` with the word before a key, if they have it; and whether what two rows have in common begins at their key."""
    if "before" not in buckets.columns:
        return (), F.lit(True)
    return ("before",), (F.col("before") != F.col("before_b")) | (F.col("before") == 0)


def first_pairs(buckets: DataFrame) -> DataFrame:
    """id, id_b: all fitting pairs of buckets of at most BUCKET rows; of larger ones, one class, drawn by a hash, with each."""
    word, begun = _begun(buckets)
    few, many = buckets.where(F.col("met") <= BUCKET), buckets.where(F.col("met") > BUCKET)
    hub = many.groupBy("k").agg(F.min(F.struct(F.xxhash64(F.pmod("k", F.lit(4)), "id").alias("draw"), *ATTRIBUTES)).alias("hub")).select("k", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ATTRIBUTES])
    pairs = few.join(_other(few, *word).hint("merge"), "k").where((F.col("id") < F.col("id_b")) & begun & _fits()).select("id", "id_b")
    return pairs.union(many.join(hub.hint("merge"), "k").where((F.col("id") != F.col("id_b")) & _fits()).select(F.least("id", "id_b"), F.greatest("id", "id_b"))).distinct()


def remaining_pairs(buckets: DataFrame, groups: DataFrame, errors: int = ERRORS, above: int | None = None) -> DataFrame:
    """id, id_b: fitting pairs of larger buckets whose classes are not in one group yet. ``groups``: node (id), component.

    ``above``: the bits of the step before, whose pairs have been compared and are left out.
    """
    word, begun = _begun(buckets)
    many = buckets.where(F.col("met") > BUCKET).join(bounded(groups.withColumnRenamed("node", "id"), BROADCAST_ROWS), "id", "left").withColumn("g", F.coalesce("component", "id"))
    same = W.partitionBy("k")
    many = many.withColumns({"_low": F.min("g").over(same), "_high": F.max("g").over(same)}).where("_low < _high")
    return many.join(_other(many, "g", *word).hint("merge"), "k").where((F.col("g") < F.col("g_b")) & begun & _fits(errors, above)).select(F.least("id", "id_b").alias("id"), F.greatest("id", "id_b").alias("id_b")).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, at_once: int) -> list[DataFrame]:
    """Pairs (a, b) of a stored table whose lines have the edit similarity, ``at_once`` of them met with their texts at a time. ``classes``: id, norm of all that occur."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    shares = -(-pairs.count() // at_once) or 1
    wanted = table(pairs.select("id").union(pairs.select("id_b")).distinct(), "wanted")
    texts = table(classes.select("id", "norm").join(bounded(wanted, BROADCAST_ROWS), "id", "semi"), "texts", "zstd")
    drop_table(wanted)
    edges = []
    for share in range(shares):
        own = pairs.where(F.pmod(F.xxhash64("id"), F.lit(shares)) == share)
        both = own.join(texts.hint("merge"), "id").join(texts.select(F.col("id").alias("id_b"), F.col("norm").alias("norm_b")).hint("merge"), "id_b")
        edges.append(table(both.select("id", "id_b", "norm", "norm_b").mapInArrow(run, "a long, b long"), "edges"))
    drop_table(texts)
    return edges


def _stored(tables: list[DataFrame], name: str) -> DataFrame:
    """The distinct rows of tables, stored in place of them."""
    out = table(reduce(DataFrame.unionByName, tables).distinct(), name)
    drop_table(*tables)
    return out


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """For columns doc_id, tag, text: the lines to remove, (doc_id, tag, lines array). A stored table."""
    forms = _lines(docs, least_words, True).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tag", "line")).alias("first"), F.count("*").alias("n"), F.first("norm").alias("norm"))
    # the ids are stored with the table, so they stay what they are
    classes = table(forms.withColumn("id", F.monotonically_increasing_id()), "classes", "zstd")
    at_once = max(PAIRS, int(PAIRS_A_CLASS * classes.count()))
    sketches, buckets = table(_sketched(classes), "sketches"), []
    for share in range(PASSES):
        met = table(_met(classes, share), "met")
        buckets.append(table(met.join(bounded(sketches, BROADCAST_ROWS), "id"), "buckets"))
        drop_table(met)
    drop_table(sketches)
    pairs = _stored([table(first_pairs(b), "pairs") for b in buckets], "pairs")
    edges = _stored(_verified(pairs, classes, at_once), "edges")
    groups = table(components(edges), "groups")
    drop_table(pairs, edges)
    for above, errors in zip((None, *STEPS), STEPS):
        found, waiting = [], 0
        for k, b in enumerate(buckets):
            found.append(table(remaining_pairs(b, groups, errors, above), "pairs"))
            waiting += found[-1].count()
            # many pairs are compared before the next share is paired, so that what they link spares pairs of it
            if waiting > (at_once if k + 1 < len(buckets) else 0):
                pairs = _stored(found, "pairs")
                edges = _stored(_verified(pairs, classes, at_once), "edges")
                before, groups = groups, table(merged(groups, edges), "groups")
                drop_table(pairs, edges, before)
                found, waiting = [], 0
        drop_table(*found)
    drop_table(*buckets)
    grouped = classes.drop("norm").join(bounded(groups.withColumnRenamed("node", "id"), BROADCAST_ROWS), "id", "left").where("n > 1 or component is not null").withColumn("group", F.coalesce("component", "id"))
    grouped = table(grouped, "grouped")
    drop_table(classes, groups)
    winners = table(grouped.groupBy("group").agg(F.min("first").alias("winner")), "winners")
    repeated = table(grouped.join(bounded(winners, BROADCAST_ROWS), "group").select("h1", "h2", "winner"), "repeated")
    drop_table(grouped, winners)
    lost = _lines(docs, least_words, False).join(bounded(repeated, BROADCAST_ROWS), ["h1", "h2"]).where(F.struct("doc_id", "tag", "line") != F.col("winner"))
    lost = table(lost.groupBy("doc_id", "tag").agg(F.collect_list("line").alias("lines")), "lost")
    drop_table(repeated)
    return lost


def dedupe_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_words: int = LEAST_WORDS, counts: bool = True) -> DataFrame:
    """Keep one occurrence of each group of equal or nearly equal lines over all documents.

    Returns the input's columns with the text reduced and, with ``counts``, n_lines and n_removed (which
    replace columns of these names). Every line of at least ``least_words`` words counts (by default all
    with other than white space). Lines are split at line feeds and the others keep their order and exact
    form; a text that loses nothing is unchanged. A document may end up empty; it stays.

    Null text stays null, with no lines. Rows with a null id come first. Rows that share an id are
    ordered by a hash of their text; equal rows count as one document. Texts and lines of any length
    are compared whole. An empty table gives no rows. Other columns keep their values, whatever their names.
    """
    doc, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    keyed = docs.select(doc.cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    lost = removed_lines(keyed, least_words)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), doc.cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"))
    # rows with their lines are wider than others, so it is the lines that count
    few = (lost.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_ROWS
    marked = packed.join(lost.withColumnsRenamed({"doc_id": "d", "tag": "t"}).hint("broadcast" if few else "merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    old = F.col("row")[text_col]
    n_lines = F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1
    # bound to a name by the outer transform, so that a text is split once and not for each of its lines
    without = lambda split: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lines")), lambda k: F.get(split, k)), "\n")
    left = F.get(F.transform(F.array(F.split(old, "\n")), without), F.lit(0))
    chosen = {c: F.when(F.col("lines").isNull(), old).otherwise(left) if c == text_col else F.col("row")[c] for c in docs.columns}
    if counts:
        chosen |= {"n_lines": F.coalesce(n_lines, F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("lines"), F.lit(0)).cast("long")}
    return marked.select(*[v.alias(c) for c, v in chosen.items()])
