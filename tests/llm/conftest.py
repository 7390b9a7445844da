import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def texts():
    """A seeded corpus: prose, exact and near copies, repeated passages and lines, odd and empty texts. (doc_id, text)."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    lined = lambda n, per=12: "\n".join(prose(per) + "." for _ in range(n))
    out: list[str | None] = [lined(rng.randint(2, 12)) for _ in range(60)]
    passage = prose(64)
    out += [prose(rng.randint(0, 30)) + " " + passage + " " + prose(rng.randint(0, 30)) for _ in range(12)]
    out += [out[k] for k in (0, 0, 0, 3, 7, 61)]
    for k in range(8):  # near copies: one word changed
        words = out[20 + k].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    line = prose(14)
    out += [f"{lined(2)}\n{line if k % 2 else line.upper() + '!'}\n{lined(1)}" for k in range(10)]
    out += [prose(3000), "x" * 5000, None, "", " \n\t ", "one", "one two", "a b c d e f g", "Ünï cödé ’quoted’ text  with   spaces\r\n\n and <|endoftext|> sign", "\n".join(["same line of words here"] * 9)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(7 * i + 3, out[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, null texts, clashing extra columns."""
    text = " ".join(f"w{k}" for k in range(70))
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (1, text + " more", "en", None, 0), (None, text, "en", "a", 0), (None, None, None, None, None), (2, text, "en", "a", 0), (3, None, "en", "a", 0), (4, "", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("size", "shard", "row", "d", "t", "tag", "block", "fingerprint", "component", "first", "line", "lines", "kept", "mark", "n_words", "_words", "group", "evidence", "path", "host", "k")})
