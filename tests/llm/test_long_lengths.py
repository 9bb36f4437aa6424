"""Boundaries above the lengths that have a cell each."""

import random

import numpy as np
from pyspark.sql import functions as F

from gradeweave.llm import length_buckets


def test_boundaries_within_a_cell(spark):
    lengths = [65_536] * 20 + [65_540] * 3 + [65_599] + [200_000] * 9 + [200_001] * 2 + [5] * 4
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long")
    assert df.select(length_buckets.cell(F.col("n")).alias("c")).distinct().count() == 3
    packed = length_buckets.pack(df, F.col("n"), buckets=6).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in packed) == list(enumerate(lengths))
    assert all(r.bucket_tokens == r.n_tokens for r in packed)  # six lengths, six buckets: no padding


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_boundaries_have_the_least_padding_at_any_length(spark):
    """Cells of many lengths are told apart as far as it matters: brute force is the programme over every single length."""
    rng = random.Random(6)
    for buckets, lengths in (
        (3, [rng.randint(2**20, 2**20 + 900) for _ in range(300)]),
        (5, [int(131_072 * 1.5 ** (5 * rng.random())) for _ in range(2_000)] + [7] * 50),
        (16, [rng.randint(2**27, 2**28) for _ in range(400)] + [2**40 + rng.randint(0, 2**30) for _ in range(300)]),
        (4, [2**33 + 3]),
    ):
        counts = spark.createDataFrame([(x,) for x in lengths], "n_tokens long").groupBy("n_tokens").count().withColumnRenamed("count", "n")
        xs, ns = np.unique(lengths, return_counts=True)
        want = length_buckets.optimal_boundaries(xs, ns, buckets)
        got = length_buckets.boundaries(counts, buckets)
        assert set(got) <= set(lengths) and len(got) <= buckets
        assert padding(lengths, got) == padding(lengths, want)


def test_a_cell_is_split_into_its_lengths(spark):
    counts = spark.range(2**20, 2**20 + 1024).selectExpr("id as n_tokens", "1L as n")
    (whole,) = length_buckets.histogram(counts)
    assert whole == length_buckets.Cell(2**20, 2**20 + 1023, 1024)
    assert length_buckets.split(counts, [whole]) == [length_buckets.Cell(2**20 + i, 2**20 + i, 1) for i in range(1024)]


def test_rows_given_many_times_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(length_buckets, "SHARD_ROWS", 50)
    monkeypatch.setattr(length_buckets, "SHARD_BATCHES", 1)
    df = spark.range(2_000).selectExpr("if(id % 2 = 0, 1L, id) as doc_id", "50L as n")
    packed = length_buckets.pack(df, F.col("n"), buckets=1, budget=2_500)
    assert packed.count() == 2_000 and packed.select("shard", "batch", "slot").distinct().count() == 2_000
    assert packed.groupBy("shard").count().agg(F.max("count")).first()[0] < 100
