"""SentencePiece BPE, encoded by a table of each prefix's last piece and decoded by a gather of bytes.

A BPE result holds exactly those neighbours that the merges would leave apart if they stood alone, so the
encoding of a text's prefix is the encoding of a shorter prefix and one piece more, and that last piece is
the only one that fits: an automaton names the pieces that end at a place, and of those the one is taken
that may follow the last piece of the prefix before it (a pair test, remembered for each pair). One pass
forward fills the table, one walk backward reads the ids off. No merge queue over the text is needed.

Units: no piece of such a model reaches from another character into a white space mark, nor over a newline
or from a letter to a closing mark (each is checked when the model is read), so texts are cut there and each
distinct unit of a batch is looked up once. Unknown characters become their UTF-8 bytes' pieces.
"""

from array import array

from pyspark.sql import DataFrame

from .tokens import chunks

#: The mark that stands for a space in pieces.
MARK = "▁"
#: Characters after which, or before which, a unit may end if the model allows.
CLOSING = ".,;:!?)\"'\n"
#: Characters of units and ids remembered in a Python worker before it starts afresh (bounds memory, not results).
MEMO = 3_000_000
#: Bytes of texts encoded at once (or one text, if that is longer).
CHUNK = 3_000_000
#: Pair tests remembered in a Python worker before it starts afresh.
PAIRS = 500_000


class PieceModel:
    """A sentencepiece model of kind BPE, without normalisation, with byte fallback. Raises ValueError for other kinds."""

    _cache: dict = {}

    def __init__(self, path: str):
        import pyarrow as pa
        from sentencepiece import sentencepiece_model_pb2 as format

        model = format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        form, kinds = model.normalizer_spec, format.ModelProto.SentencePiece
        plain = not form.precompiled_charsmap and form.add_dummy_prefix and not form.remove_extra_whitespaces and form.escape_whitespaces
        if model.trainer_spec.model_type != format.TrainerSpec.BPE or not plain or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this needs a BPE model without normalisation, with byte fallback and a leading mark")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces of the user's own, and unused ones, are not served")
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        ids = {p.piece: k for k, p in enumerate(model.pieces)}
        self.byte = [ids[f"<0x{b:02X}>"] for b in range(256)]
        # what each id stands for; control pieces for nothing
        surface = [p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"" for p in model.pieces]
        for b, k in enumerate(self.byte):
            surface[k] = bytes([b])
        for k, p in enumerate(model.pieces):
            if p.type == kinds.UNKNOWN:
                surface[k] = model.trainer_spec.unk_surface.encode()
        self.surface = pa.array(surface, pa.large_binary())
        self.names = [p.piece for p in model.pieces]
        self.automaton = None
        self._forget()
        self.fits: dict[int, bool] = {}

    def prepare(self) -> None:
        """What encoding needs beside the names: the automaton, and where units may end."""
        import ahocorasick

        # pieces that the merges never leave whole can't occur
        automaton, longer = ahocorasick.Automaton(), []
        for k, piece in enumerate(self.names):
            if piece in self.score and self.merged(piece) == [piece]:
                automaton.add_word(piece, (k, len(piece)))
                if len(piece) > 1:
                    longer.append(piece)
        automaton.make_automaton()
        inner = {p[k : k + 2] for p in longer for k in range(len(p) - 1)}
        if any(b == MARK and a != MARK for a, b in inner) or any("\n" in x for x in inner) or " " in "".join(self.score):
            raise ValueError("a piece reaches over a white space mark or a newline")
        letters = {a for a, _ in inner if a.isascii() and a.isalpha()}
        self.closing = "".join(c for c in CLOSING if not any(a + c in inner for a in letters))
        self.automaton = automaton

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        """One model for each Python worker process."""
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.held, self.ids, self.ends = 0, array("I"), array("q", [0])

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merges themselves: the best pair first, the leftmost of equal ones."""
        parts, score, none = list(text), self.score, float("-inf")
        pairs = [score.get(parts[k] + parts[k + 1], none) for k in range(len(parts) - 1)]
        while pairs and (best := max(pairs)) > none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score.get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = score.get(parts[k] + parts[k + 1], none)
        return parts

    def _pair(self, a: int, b: int) -> bool:
        """Whether the merges leave the pieces ``a`` and ``b`` apart where they meet."""
        left, right = self.names[a], self.names[b]
        return self.merged(left + right) == [left, right]

    def unit_ids(self, unit: str) -> list[int]:
        """The ids of a text in which the white space is marked already."""
        if self.automaton is None:
            self.prepare()
        last: list[int] = [0] * len(unit)  # of the prefix that ends here: its last piece, or -1 for an unknown character
        start: list[int] = [-1] * len(unit)
        fits, many = self.fits, len(self.names)
        for at, (piece, length) in self.automaton.iter(unit):
            if start[at] >= 0:
                continue  # no second piece can be right
            first = at + 1 - length
            if first:
                # what no piece ends in is an unknown character, which nothing merges with
                before = last[first - 1] if start[first - 1] >= 0 else -1
                if before >= 0:
                    key = before * many + piece
                    good = fits.get(key)
                    if good is None:
                        good = fits[key] = self._pair(before, piece)
                    if not good:
                        continue
            last[at], start[at] = piece, first
        out, at = [], len(unit) - 1
        while at >= 0:
            if start[at] < 0:
                out += [self.byte[b] for b in reversed(unit[at].encode())]
                at -= 1
            else:
                out.append(last[at])
                at = start[at] - 1
        return out[::-1]

    def encode_all(self, texts):
        """A list array of the ids of an Arrow array of texts, row by row, without begin and end. Null is empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.automaton is None:
            self.prepare()
        if self.held > MEMO:
            self._forget()
        if len(self.fits) > PAIRS:
            self.fits = {}
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), " ", MARK)
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        # a space, of which there is none any more, shows where units end
        for pattern, cut in ((f"([^{MARK}]){MARK}", f"\\1 {MARK}"), (f"([A-Za-z])([{self.closing}])", r"\1 \2"), (r"\n", "\n ")):
            texts = pc.replace_substring_regex(texts, pattern, cut)
        parts = pc.split_pattern(texts, " ")
        units = parts.flatten().dictionary_encode()
        names, find = units.dictionary.to_pylist(), self.places.get
        for name in names:
            if name not in self.places:
                found = self.unit_ids(name)
                self.places[name] = len(self.ends) - 1
                self.ids.extend(found)
                self.ends.append(len(self.ids))
                self.held += len(name) + len(found) + 16
        place = np.fromiter(map(find, names), np.int64, len(names))[units.indices.to_numpy()]
        taken = pa.LargeListArray.from_arrays(np.array(self.ends, np.int64), pa.array(np.array(self.ids, "<u4"))).take(pa.array(place))
        return pa.LargeListArray.from_arrays(taken.offsets.take(parts.offsets), taken.values)

    def decode_all(self, ids):
        """The texts of an Arrow list array of ids. Raises IndexError for an id that the model lacks."""
        import numpy as np
        import pyarrow as pa

        found = self.surface.take(ids.values)
        ends = np.frombuffer(found.buffers()[1] or bytes(8), np.int64)
        offsets = ends[ids.offsets.to_numpy()].tolist()
        data = memoryview(found.buffers()[2] or b"")
        flat, firsts, out = ids.values.to_numpy(), ids.offsets.to_numpy().tolist(), []
        for a, b, first in zip(offsets, offsets[1:], firsts):
            whole = bytes(data[a:b])
            if whole[:1] == b" ":
                while ends[first + 1] == a:  # control pieces
                    first += 1
                # the space of a byte's own piece stays
                whole = whole if flat[first] == self.byte[32] else whole[1:]
            try:
                out.append(whole.decode())
            except UnicodeDecodeError:
                # each byte that belongs to no character is one replacement character
                out.append("".join("�" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in whole.decode(errors="surrogateescape")))
        return pa.array(out, pa.string())


def encode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, with the begin and the end id) of each row.

    ``model`` is a file that every executor has. Null and empty texts are the begin and the end id alone.
    A text of any length is encoded whole, in one task, in batches bounded in bytes. Null and repeated
    ids and repeated rows are kept as they are, other columns aren't read, an empty table gives no rows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pieces = PieceModel.of(model)
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                found = pieces.encode_all(part.column(1))
                at = found.offsets.to_numpy() + 2 * np.arange(part.num_rows + 1)
                ids = np.empty(at[-1], dtype="<u4")
                inner = np.ones(len(ids), dtype=bool)
                inner[at[:-1]] = inner[at[1:] - 1] = False
                ids[inner], ids[at[:-1]], ids[at[1:] - 1] = found.values.to_numpy(), pieces.begin, pieces.end
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(4 * at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), packed.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The rows of :func:`encode` with the ``text`` that the ids stand for instead of ``ids``.

    Begin and end ids stand for nothing and the space that encoding puts first is taken off again (not that of
    a byte's own piece); bytes
    that form no character give one replacement character each. Null ids are an empty text.
    """
    kept = [c for c in encoded.columns if c not in (ids_col, "text")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = PieceModel.of(model)
        for batch in batches:
            for part in chunks(batch, len(kept), CHUNK):
                column = pc.fill_null(part.column(len(kept)), b"").cast(pa.large_binary())
                data = column.buffers()[2]
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                ids = np.frombuffer(data, "<u4", count=ends[-1] // 4) if data is not None and ends[-1] else np.zeros(0, "<u4")
                texts = pieces.decode_all(pa.LargeListArray.from_arrays(ends // 4, pa.array(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*kept, "text"])

    rows = encoded.select(*[encoded[f"`{c}`"] for c in kept], encoded[f"`{ids_col}`"])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, text string" if kept else "text string")
