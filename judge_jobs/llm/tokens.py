"""Whole texts to token ids with the ``tokenizers`` library, inside tasks."""

import os

#: White space, a space, white space: only there can a pre-token reach over a cut before a space.
_WHITE = "[\t-\r\x1c- \x85\xa0  -     　]"
_CROSSING = f"{_WHITE} {_WHITE}"
#: Bytes of units and ids remembered in one Python worker before it starts afresh (bounds memory, not results).
MEMO_BYTES = 40_000_000
#: Bytes of texts encoded at once (or one text, if that is longer).
CHUNK_BYTES = 2_000_000


def chunks(batch, column: int, most: int = CHUNK_BYTES):
    """Slices of an Arrow batch with at most ``most`` bytes in a text column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


class TextEncoder:
    """Encode texts to unsigned 32-bit ids.

    A byte-level BPE never merges over the start of a `` word`` unit, so texts are cut before each
    single space and each distinct unit of a batch is looked up once. Units that a worker hasn't met
    yet go through the library together, in one call; their ids are told apart by the bytes that each
    token stands for. Texts in which a run of white space could span such a cut, or with one of the
    vocabulary's special strings, go to the library whole, and so do all texts under other kinds of
    tokenizer. Null is empty.
    """

    _cache: dict = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._forget()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pre = self.library.pre_tokenizer
        self.by_unit = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.library.normalizer is None
        vocabulary = self.library.get_vocab()
        # a byte-level token has one character for each byte
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.widths[k] = len(token)

    @classmethod
    def of(cls, path: str) -> "TextEncoder":
        """One encoder for each Python worker process."""
        if path not in cls._cache:
            cls._cache[path] = cls(path)
        return cls._cache[path]

    def _ids(self, text: str):
        import numpy as np

        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _forget(self) -> None:
        import numpy as np

        #: Place of each unit (of a text's first one: after a zero character) among the ids remembered.
        self.places: dict[str, int] = {}
        self.held, self.ids, self.ends = 0, np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _learn(self, fresh: list[str], tidy: list[bool]) -> None:
        """Remember distinct new units, those that ``tidy`` says together: without white space at an end they can't touch."""
        import numpy as np

        parts, ends, total = [self.ids], [self.ends], len(self.ids)
        joined = [u for u, x in zip(fresh, tidy) if x]
        for a in range(0, len(joined), 20_000):
            text = " " + " ".join(joined[a : a + 20_000])
            ids, data = self._ids(text), text.encode()
            # a unit has no space but its first byte
            bounds = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data))
            parts.append(ids)
            ends.append(total + np.searchsorted(np.cumsum(self.widths[ids]), bounds) + 1)
            total += len(ids)
            self.held += len(data) + ids.nbytes
        loose = [u for u, x in zip(fresh, tidy) if not x]
        for u in loose:
            parts.append(self._ids(u[1:] if u[:1] == "\0" else " " + u))
            total += len(parts[-1])
            ends.append([total])
            self.held += len(u) + parts[-1].nbytes
        self.places.update(zip(joined + loose, range(len(self.places), len(self.places) + len(fresh))))
        self.ids, self.ends = np.concatenate(parts), np.concatenate(ends)

    def encode_all(self, texts):
        """A list array of the ids of an Arrow array of texts, row by row."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.held > MEMO_BYTES:
            self._forget()
        texts = pc.fill_null(texts, "")
        apart = np.full(len(texts), not self.by_unit)
        for found in (pc.match_substring_regex(texts, _CROSSING), pc.match_substring(texts, "\0"), *[pc.match_substring(texts, s) for s in self.specials]):
            apart |= found.to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(apart), "", texts), " ")
        units, first = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        index = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.ones(len(index), dtype=bool)
        inner[first[:-1]] = False  # a text's first unit has no space before it
        used = np.zeros(len(units.dictionary), dtype=bool)
        used[index[inner]] = True
        names = units.dictionary.filter(pa.array(used))
        heads = ["\0" + u for u in units.dictionary.take(pa.array(index[first[:-1]])).to_pylist()]
        known, find = names.to_pylist(), self.places.get
        new = [k for k, at in enumerate(map(find, known)) if at is None]
        tidy = pc.invert(pc.match_substring_regex(names.take(pa.array(new, pa.int64())), f"^{_WHITE}|{_WHITE}$|^$")).to_pylist()
        extra = [u for u in dict.fromkeys(heads) if u not in self.places]
        self._learn([*[known[k] for k in new], *extra], [*tidy, *[False] * len(extra)])
        place = np.zeros(len(used), dtype=np.int64)
        place[used] = np.fromiter(map(find, known), np.int64, len(known))
        place = place[index]
        place[first[:-1]] = np.fromiter(map(find, heads), np.int64, len(heads))
        own = [self._ids(texts[k].as_py()) for k in np.flatnonzero(apart).tolist()]
        place[first[:-1][apart]] = len(self.ends) + np.arange(len(own))
        ends = np.concatenate([[0], self.ends, len(self.ids) + np.cumsum([len(x) for x in own], dtype=np.int64)])
        taken = pa.LargeListArray.from_arrays(ends, pa.array(np.concatenate([self.ids, *own]))).take(pa.array(place))
        return pa.LargeListArray.from_arrays(taken.offsets.take(pa.array(first)), taken.values)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        return self.encode_all(pa.array([text], pa.string())).values.to_numpy().tobytes()
