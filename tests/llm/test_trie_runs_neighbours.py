"""Conversation trie, periodic runs and nearest neighbours against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from barloom.llm import periodic_runs, permutation_index, prefix_trie, tree_sums  # noqa: E402
from barloom.llm.queries import QUERIES, rebuilt_turns, with_periods  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"


def shape(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_subtree_sums_of_random_trees(spark, seed):
    r = random.Random(seed)
    n = 400
    # chains, bushes and a star, under two roots
    parent = [None, None] + [k - 1 if r.random() < (0.95, 0.3, 0.0)[seed] else 0 if seed == 2 else r.randrange(k) for k in range(2, n)]
    value = [r.randrange(10) for _ in range(n)]
    want = list(value)
    for k in range(n - 1, 1, -1):
        want[parent[k]] += want[k]
    rows = [(k * 7 + 3, None if parent[k] is None else parent[k] * 7 + 3, value[k], 1) for k in range(n)]
    tree = spark.createDataFrame(rows, "node long, parent long, v long, one long")
    got = {r["node"]: r["v"] for r in tree_sums.subtree_sums(tree, ["v", "one"]).collect()}
    assert got == {k * 7 + 3: want[k] for k in range(n)}


def test_subtree_sums_refuse_a_cycle_and_take_nothing(spark):
    schema = "node long, parent long, v long"
    with pytest.raises(RuntimeError):
        tree_sums.subtree_sums(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], schema), ["v"], rounds=3)
    assert tree_sums.subtree_sums(spark.createDataFrame([], schema), ["v"]).count() == 0


def test_trie_of_hard_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    r = random.Random(4)
    rows = [(None, 1, "user", "nobody"), (100, None, "user", None), (100, 1, None, "é🙂"), (100, 1, "a", "tie"), (100, 1, "a", "tie"), (-205, 1, "user", "x"), (7, 2, "", ""), (7, 1, "ab", "c"), (8, 1, "a", "bc")]
    for c in range(100, 340):
        rows += [(c, t, r.choice("ua"), r.choice(["", "yes", "no"])) for t in range(r.randrange(1, 9))]
    rows += [(500, t, "u", "again") for t in range(60)] + [(501, t, "u", "again") for t in range(50)]
    table = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "2 AS place", "3 AS `a.b`")
    assert shape(prefix_trie.trie(*rebuilt_turns(table))) == sorted(brute.op11(brute.rebuilt(rows)), key=repr)
    assert prefix_trie.trie(*rebuilt_turns(spark.createDataFrame([], TURNS))).count() == 0
    # conversations without a turn are members of the root alone
    bare = prefix_trie.trie(prefix_trie.ordered(spark.createDataFrame([(1, 1, "u", "t")], TURNS)), spark.createDataFrame([(5,), (1,)], "conv_id long"))
    assert [(x["conv_id"], x["depth"], x["n_convs"]) for x in bare.orderBy("depth").collect()] == [(1, 0, 2), (1, 1, 1)]


def test_trie_of_the_small_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shape(QUERIES["op11_prefix_trie"](spark, small_dir)) == sorted(brute.op11(brute.rebuilt(rows)), key=repr)


def fibonacci(n):
    a, b = "x", "x y"
    while len(b.split()) < n:
        a, b = b, f"{b} {a}"
    return b


def periodic_texts():
    r = random.Random(12)
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a " * 500, "x " + "a b c d e f g h " * 3 + "y", "x " + "a b c d e f g h " * 3 + "a y", "a b c d e f g " * 3, fibonacci(300)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(20, 300))) for _ in range(30)]
    for _ in range(40):  # planted runs, some of them beside and inside each other
        words = []
        for _ in range(r.randrange(1, 5)):
            words += [r.choice("abcdefgh") + r.choice("12") for _ in range(r.randrange(0, 12))]
            block = [r.choice("abcd") for _ in range(r.randrange(1, 14))]
            words += (block * r.randrange(2, 9))[r.randrange(0, len(block)) :]
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    nested = "p q " * 8 + "z "
    texts += [nested * 4, ("k " * 30 + nested) * 3, "　".join("ab" * 50), "A a " * 12]
    return texts


def test_periodic_runs_of_hard_texts(spark):
    texts = periodic_texts()
    rows = [(k // 2, t) for k, t in enumerate(texts)]  # ids are shared by different texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n_words", "3 AS collapsed", "4 AS `a.b`")
    got = periodic_runs.find_runs(docs)
    assert got.select("row.*").columns == docs.columns
    found = {(r["row"]["doc_id"], r["row"]["text"]): (r["n_words"], [tuple(x) for x in r["runs"]]) for r in got.collect()}
    for doc, text in rows:
        words = brute.SPACED.findall(text or "")
        assert found[doc, text] == (len(words), brute.runs(words)), (doc, text)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_periodic_query_of_hard_texts(spark, tmp_path):
    rows = list(enumerate(t for t in periodic_texts() for _ in range(4)))
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    assert shape(QUERIES["op12_periodic_runs"](spark, path)) == sorted(brute.op12(rows), key=repr)
    changed = {r["doc_id"]: r["text"] for r in with_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(brute.SPACED.findall(changed[d] or "") == brute.periodic(d, brute.SPACED.findall(t or "")) for d, t in rows)


def test_periodic_runs_of_the_small_table(spark, small_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in docs if len(t or "") < 6000]
    got = [r for r in shape(QUERIES["op12_periodic_runs"](spark, small_dir)) if r[0] in {d for d, _ in short}]
    assert got == sorted(brute.op12(short), key=repr) and len(short) > 150


def test_periodic_runs_of_a_long_text():
    words = np.concatenate([np.arange(50_000) % 977, np.arange(50_000) % 3, np.zeros(50_000, int), np.arange(2000)])
    found = periodic_runs.runs_of(words, np.zeros(len(words), int))
    assert (0, 50_000, 977) in found and any(q == 3 and n >= 50_000 for _, n, q in found) and any(q == 1 and n >= 50_000 for _, n, q in found)


def close(got, want):
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)


def test_neighbours_of_hard_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.round(r.normal(size=4) * 8) / 8]) for k in range(1, 120)]
    rows += [(k, [1.0, 1.0, 0.0, 0.0]) for k in range(120, 200)]  # copies, some of them queries
    rows += [(0, [0.5, 0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5, 0.5]), (200, None), (220, [0.0] * 4), (240, [float("nan"), 1.0, 1.0, 1.0]), (260, [None, 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(300, [2.0**-10] * 4), (320, [1e4] * 4), (340, [1.0, 2.0]), (341, [3.0, 1.0]), (360, []), (None, [9.0] * 4), (380, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS kind", "3 AS vec", "4 AS `a.b`")
    got = sorted(tuple(x) for x in permutation_index.search(permutation_index.build(vectors), vectors.where("vec_id % 20 = 0")).collect())
    once = rows[:199] + rows[200:]
    close(got, sorted(brute.op13(once)))
    assert permutation_index.search(permutation_index.build(vectors.limit(0)), vectors).count() == 0
    assert permutation_index.search(permutation_index.build(vectors), vectors.limit(0)).count() == 0


@pytest.mark.parametrize("shard_values", [1 << 20, 1 << 15])
def test_neighbours_are_found(spark, monkeypatch, shard_values):
    monkeypatch.setattr(permutation_index, "SHARD_VALUES", shard_values)
    monkeypatch.setattr(permutation_index, "LEAST", 40)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").toPandas()
    all_, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    index = permutation_index.build(vectors)
    assert index.count() == len(rows)
    found = permutation_index.search(index, vectors.where("vec_id % 20 = 0")).toPandas()
    hits = 0
    for q, mine in found.groupby("query_id"):
        score = all_ @ all_[ids == q][0]
        score[ids == q] = -np.inf
        assert mine.sort_values("rank")["score"].is_monotonic_decreasing and len(mine) == 20
        hits += len(set(mine["vec_id"]) & set(ids[np.argsort(-score)[:20]]))
    assert found["query_id"].nunique() == (ids % 20 == 0).sum() and hits / len(found) >= 0.9
    print(hits / len(found))
