import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from judge_jobs.llm import packing
from judge_jobs.llm.tokens import TextEncoder


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r ab'sé1.,’x<|>", max_size=30))
def test_encoder_equals_the_library(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = TextEncoder.of(path)
    for t in (text, text + "<|endoftext|>", "word" + text + "  word"):
        assert encoder.encode(t) == np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_on_corpus(texts, vocabulary, library):
    encoder = TextEncoder.of(vocabulary)
    for _, t in texts:
        assert encoder.encode(t) == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40), st.sampled_from([(32, 8, 32), (32, 2, 32), (32, 8, 10), (16, 1, 16)]))
def test_fill_limits_and_cover(items, limits):
    tokens, loss = [t for t, _ in items], [min(t, x) for t, x in items]
    size, segments, most_loss = limits
    got = [[] for _ in items]
    for sequence in packing.fill(tokens, loss, limits):
        assert 0 < sum(n for _, _, n in sequence) <= size
        assert len(sequence) <= segments
        assert sum(max(0, s + n - max(s, tokens[i] - loss[i])) for i, s, n in sequence) <= most_loss
        for i, s, n in sequence:
            got[i].append((s, n))
    for i, pieces in enumerate(got):
        at = 0
        for s, n in sorted(pieces):
            assert s == at and n > 0
            at += n
        assert at == tokens[i]


def test_dot_product_prefers_the_scarce_resource():
    # the limit on loss is the tight one, so its largest user goes first although another has more tokens
    first, *_ = packing.fill([6, 3, 3], [0, 0, 3], (10, 4, 4))
    assert [i for i, _, _ in first][:2] == [2, 0]


def check_pieces(rows, texts, library, end=1):
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        assert at == 2048 or at & (at - 1) == 0  # nothing to pad


def test_pack(docs, texts, vocabulary, library):
    check_pieces(packing.pack(docs, vocabulary).collect(), texts, library)


def test_pack_prompt_loss_and_ids(spark, vocabulary, library):
    df = spark.createDataFrame([(1, "the answer is here", "what is it ?"), (2, "yes", None)], "doc_id long, text string, prompt string")
    rows = packing.pack(df, vocabulary, prompt_col="prompt", size=64, max_loss=4, with_ids=True).collect()
    for doc, prompt, text in ((1, "what is it ?", "the answer is here"), (2, "", "yes")):
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        want = library.encode(prompt, add_special_tokens=False).ids + library.encode(text, add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r.ids] == want
        assert sum(r.n_loss for r in own) == len(library.encode(text, add_special_tokens=False).ids) + 1
    sums = {}
    for r in rows:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.n_loss
    assert max(sums.values()) <= 4


def test_pack_edges(empty, odd, vocabulary):
    assert packing.pack(empty, vocabulary).count() == 0
    rows = packing.pack(odd, vocabulary).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 1  # empty text: the end id
    assert sum(r.start == 0 for r in rows) == odd.count()  # null and repeated ids: each row packed


def test_pieces_of_text_are_small():
    """What a worker tokenizes at once is bounded: ids and units of a piece are held several times over."""
    import pyarrow as pa
    from judge_jobs.llm.tokens import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 900_000] * 9 + ["y" * 5_000_000, None])], names=["text"])
    sizes = [sum(len(t or "") for t in c.column(0).to_pylist()) for c in chunks(batch, 0)]
    assert sum(sizes) == 13_100_000 and max(s for s in sizes if s != 5_000_000) <= 2_000_000
