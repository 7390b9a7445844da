import hashlib
import random
import zlib

import pytest

from judge_jobs.llm import prefix_tree
from judge_jobs.llm.queries import op12_prefix_tree

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """The contract, in plain Python: {conv_id: [(role, text), ...]}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0], t[1], t[2][: prefix_tree.HEAD], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(convs):
    """Every node of the trie by its prefix: all figures straight from their definitions."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        under = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in under if len(p) == len(prefix) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(prefix)))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(members), len(prefix), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n, turns=6, words=3):
    """Conversations out of few turns, with gaps in the ids, nulls, and copies."""
    rng, rows = random.Random(seed), []
    for c in sorted(rng.sample(range(700), n)):
        if rng.random() < 0.3:
            own = [("user", "same start"), ("assistant", "same reply"), ("user", "the end ünï")]
        else:
            own = [(rng.choice(["user", "assistant", None]), rng.choice([None, "", "a" * 40 + "x", "a" * 40 + "y", "ü", *"bcd"[:words]])) for _ in range(rng.randint(1, turns))]
        order = list(range(len(own)))
        if rng.random() < 0.2:
            order[0] = None
        rows += [(c, t, *x) for t, x in zip(order, own)]
    return rows


def query(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    found = op12_prefix_tree(spark, str(path))
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, tmp_path, seed):
    rows = made(seed, 150)
    assert query(spark, rows, tmp_path) == brute(rebuilt(rows))


@pytest.mark.parametrize("block", [1, 3, 10])
def test_blocks_of_any_size(spark, tmp_path, monkeypatch, block):
    """Groups of copies, shared heads and long conversations over many blocks and ranges."""
    monkeypatch.setattr(prefix_tree, "BLOCK", block)
    rows = made(9, 120) + [(1000 + c, t, "user", f"t{t}") for c in range(30) for t in range(9)] + [(2000, t, "user", str(t)) for t in range(60)]
    assert query(spark, rows, tmp_path) == brute(rebuilt(rows))


def test_boundary_nodes_by_shuffles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_tree, "SENT", 0)
    monkeypatch.setattr(prefix_tree, "BLOCK", 2)
    rows = made(5, 60)
    assert query(spark, rows, tmp_path) == brute(rebuilt(rows))


def test_turnless_and_absent(spark, tmp_path):
    """Conversation 1 has fewer own turns than it takes from an absent head: it ends at the root."""
    assert zlib.crc32(b"1") % 6 > 0 and zlib.crc32(b"2") % 6 > 0
    rows = [(1, 0, "user", "x"), (2, 0, "user", "y"), (None, 0, "user", "z")]
    nothing = hashlib.sha256(b"1,2").hexdigest()
    assert query(spark, rows, tmp_path) == [(1, 0, None, 2, 0, 1, 0, nothing)]


def test_empty(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_general_interface(spark):
    """Turns with extra columns of clashing names and repeated rows; a text of some MB; the trie of plain sequences."""
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", "b" * 3_000_000), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "ids", "sizes", "head", "size", "shard", "id")})
    found = {r.conv_id: (r.ids, r.sizes) for r in prefix_tree.sequences(df).collect()}
    assert [len(x[0]) for x in found.values()] in ([3, 1], [1, 3])
    assert found[1][0][0] == found[1][0][1] == found[2][0][0] and found[1][1] == [1, 1, 3_000_000]
    got = sorted(tuple(r)[:7] for r in prefix_tree.trie(prefix_tree.sequences(df)).collect())
    assert got == [(1, 0, None, 2, 1, 1, 1), (1, 1, 1, 2, 1, 1, 1), (1, 2, 1, 1, 1, 1, 0), (1, 3, 1, 1, 0, 1, 0)]


def test_search_tree_is_balanced():
    tree = prefix_tree.SearchTree()
    for k in prefix_tree.medians(1023):
        tree.insert([k, 1], [1, 1])
    deepest, ranks = 0, [(tree.next[0], 1)]
    while ranks:
        node, depth = ranks.pop()
        deepest = max(deepest, depth)
        ranks += [(x, depth + 1) for x in (tree.less[node], tree.more[node]) if x >= 0]
    assert deepest == 10
    assert sorted(prefix_tree.medians(100)) == list(range(100))
