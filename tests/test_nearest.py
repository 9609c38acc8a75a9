"""The pruned search of neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import nearest

SCHEMA = "owner_id long, embedding array<double>"


def brute(vectors, queries, k):
    want = []
    for q, x in queries:
        near = [(-float(np.cumsum(np.multiply(v, x))[-1]) / np.sqrt(np.cumsum(np.multiply(v, v))[-1] * np.cumsum(np.multiply(x, x))[-1]), o) for o, v in vectors if len(v) == len(x)]
        want += [(q, rank + 1, o, round(-s, 9)) for rank, (s, o) in enumerate(sorted(near)[:k])]
    return sorted(want)


def found(df):
    return sorted((r["query_id"], r["rank"], r["owner_id"], round(r["similarity"], 9)) for r in df.collect())


def clustered(n, dims, clusters, noise, seed=5):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(clusters, dims))
    return [(k, (middles[k % clusters] + noise * draw.normal(size=dims)).tolist()) for k in range(n)]


def test_clustered_vectors_meet_under_a_fifth_of_the_pairs(spark):
    vectors = clustered(4_000, 32, 40, 0.15)
    asked = [(o, v) for o, v in vectors if o % 20 == 0]
    queries = spark.createDataFrame(asked, SCHEMA).toDF("query_id", "query")
    lists = nearest.build(spark.createDataFrame(vectors, SCHEMA), pivot_count=120, bin_rows=500)
    got = nearest.search(None, queries, 5, lists, query_block=64)
    assert found(got) == brute(vectors, asked, 5)
    both = []
    for reach in (F.lit(None).cast("double"), F.lit(2.0) - 2 * F.lit(0.0)):
        both.append(nearest.visits(lists, queries.withColumn("reach", reach), 40))
    # with all in reach, the two passes meet every pair once
    assert sum(v.agg(F.sum("pairs")).first()[0] for v in both) == pytest.approx(len(vectors) * len(asked), rel=0.02)
    kth = got.where("rank = 5").select("query_id", F.sqrt(2 - 2 * F.col("similarity")).alias("reach"))
    second = nearest.visits(lists, queries.join(kth, "query_id"), 40)
    pairs = sum(v.agg(F.sum("pairs")).first()[0] for v in (both[0], second))
    assert pairs < len(vectors) * len(asked) / 5


@pytest.mark.parametrize("dims", [2, 24])
def test_vectors_at_random_lose_nothing(spark, dims):
    draw = np.random.default_rng(dims)
    vectors = [(k, draw.normal(size=dims).tolist()) for k in range(700)]
    # a third are copies of one vector, in other lengths too, over the size of a bin
    vectors += [(1_000 + k, [3.0 * x for x in vectors[0][1]]) for k in range(350)]
    asked = [(o, v) for o, v in vectors if o % 50 == 0]
    queries = spark.createDataFrame(asked, SCHEMA).toDF("query_id", "query")
    lists = nearest.build(spark.createDataFrame(vectors, SCHEMA), bin_rows=100)
    assert lists.directory["parts"].max() > 1
    per_bin = lists.vectors.groupBy("bin").count()
    assert per_bin.agg(F.max("count")).first()[0] <= 150 and per_bin.agg(F.sum("count")).first()[0] == len(vectors)
    assert found(nearest.search(None, queries, 7, lists, query_block=5)) == brute(vectors, asked, 7)


def test_hard_vectors_and_empty_tables(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [-1.0, 0.0])]
    bad = [(6, None), (7, []), (8, [0.0, 0.0]), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(good + bad, SCHEMA)
    queries = vectors.withColumnRenamed("owner_id", "query_id").withColumnRenamed("embedding", "query").dropDuplicates(["query_id"])
    asked = [good[0], good[1], good[2], good[4], good[5]]
    assert found(nearest.search(vectors, queries, 10)) == brute(good, asked, 10)
    nothing = vectors.where("false")
    assert found(nearest.search(nothing, queries, 3)) == [] == found(nearest.search(vectors, queries.where("false"), 3))
    named = spark.createDataFrame([(f"n{o}", v) for o, v in good[:3]], "owner_id string, embedding array<float>")
    assert [r["owner_id"] for r in nearest.search(named, queries.where("query_id = 1"), 2).orderBy("rank").collect()] == ["n1", "n3"]
