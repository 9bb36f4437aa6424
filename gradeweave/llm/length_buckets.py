"""Packing into optimal length buckets.

The lengths of all documents are counted in one histogram. Dynamic programming
over it finds the bucket boundaries with the least padding. Within a bucket,
batches hold as many documents as fit a token budget when each is padded to the
bucket's length.

The histogram has one cell for each length up to ``EXACT_TO`` and above it 1024 cells for each doubling, so it has a
proven bound at any size of the corpus. A cell knows its least and largest length. With every cell at its least length,
the programme gives a cost that no choice of boundaries can undercut; where the cells it chooses hold one length each,
that choice is possible, and so the best there is. Until then, the chosen cells are split into up to ``PARTS`` finer
ones and the programme runs again: the lengths beside boundaries are told apart, and only these.

A document longer than the budget is a batch of its own: nothing is cut. Texts are read once; lengths are stored with a
running number, by which rows are dealt out, so that rows given many times do not meet in one task.

Defined results: null lengths count as 0, equal lengths and repeated rows are
ordered by a hash of their running number and stay apart, an empty table gives no rows, extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeweave.session import materialize

#: Lengths counted one by one; a power of two.
EXACT_TO = 65_536
#: Cells that one is split into.
PARTS = 1_024
#: Rows that are numbered together when batches are formed, at least this many batches' worth.
SHARD_ROWS, SHARD_BATCHES = 100_000, 64


def word_pieces(text: Column) -> Column:
    """Length in words and punctuation marks, a stand-in for tokens that needs no vocabulary."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"))


def cell(length: Column) -> Column:
    """Number of a length's histogram cell; grows with the length."""
    octave = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    width = F.pow(F.lit(2.0), octave - 10)
    above = EXACT_TO + (octave - 16) * 1024 + F.floor(length / width) - 1024
    return F.when(length < EXACT_TO, length).otherwise(above).cast("long")


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total of boundary * documents.

    ``lengths`` ascend. For a boundary at place j and the previous one at i, the
    documents between cost (C[j] - C[i]) * lengths[j]; over i this is a set of
    lines with falling slopes asked at rising points, so each layer of the
    programme takes one pass with a monotone hull.
    """
    n = len(lengths)
    if n == 0:
        return []
    total = [0, *np.cumsum(np.asarray(counts, dtype=object)).tolist()]
    xs = [int(x) for x in lengths]
    best: list[int | None] = [0] + [None] * n
    choices = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, place
        head, now, choice = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, b = -total[i], best[i]
                while len(hull) - head >= 2:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (m1 - m2) > (b2 - b1) * (m1 - m):
                        break
                    hull.pop()
                hull.append((m, b, i))
            x = xs[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if len(hull) > head:
                m, b, i = hull[head]
                now[j], choice[j] = m * x + b + total[j] * x, i
        choices.append(np.array(choice, np.int32))
        if best[n] is not None and now[n] is not None and now[n] >= best[n]:
            choices.pop()
            break
        best = now
    bounds, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        bounds.append(xs[j - 1])
        j = int(choice[j])
    return bounds[::-1]


@dataclass(frozen=True, order=True)
class Cell:
    """A range of lengths, from the least to the largest that occurs in it, and how many documents have them."""

    least: int
    longest: int
    n: int


def histogram(counts: DataFrame) -> list[Cell]:
    """The occupied cells, in order; ``counts`` has n_tokens and n. At most as many rows as there are cells."""
    return _cells(counts, cell(F.col("n_tokens")))


def _cells(counts: DataFrame, number: Column) -> list[Cell]:
    n = F.col("n_tokens")
    grouped = counts.groupBy(number.alias("cell")).agg(F.min(n).alias("least"), F.max(n).alias("longest"), F.sum("n").alias("n"))
    return sorted(Cell(r["least"], r["longest"], r["n"]) for r in grouped.collect())


def split(counts: DataFrame, wide: list[Cell]) -> list[Cell]:
    """The cells that ``wide`` ones, at most one for each bucket, consist of; at most PARTS for each."""
    n, number = F.col("n_tokens"), F.lit(None).cast("long")
    for k, c in enumerate(wide):
        part = F.floor((n - c.least) * F.lit(PARTS) / F.lit(max(PARTS, c.longest - c.least + 1)))
        number = F.when(n.between(c.least, c.longest), F.lit(k * PARTS) + part).otherwise(number)
    return _cells(counts.withColumn("part", number).filter("part is not null"), F.col("part"))


def boundaries(counts: DataFrame, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets, of least padding among all; ``counts`` has n_tokens and n."""
    cells = histogram(counts)
    while True:
        chosen = set(optimal_boundaries(np.array([c.least for c in cells]), np.array([c.n for c in cells]), buckets))
        wide = [c for c in cells if c.least in chosen and c.least < c.longest]
        if not wide:
            return sorted(chosen)
        cells = sorted([c for c in cells if c not in wide] + split(counts, wide))


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, shard, batch, slot of every document.

    ``length`` is the token count as an expression over ``docs``. A batch is
    named by bucket, shard and batch; slot is a document's place in it. A
    shard, found by a hash of a row's running number, keeps numbering local: its last batch may
    be short, one in SHARD_BATCHES or fewer.
    """
    lengths = materialize(docs.select(
        "doc_id", F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "pack-lengths")
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("n")), "pack-counts")
    bounds = boundaries(counts, buckets) or [0]
    sizes = [max(1, budget // max(1, bound)) for bound in bounds]
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds)
    in_bucket = {r["bucket"]: r["n"] for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()}
    held = [in_bucket.get(k, 0) for k in range(len(bounds))]
    shards = [max(1, n // max(SHARD_ROWS, size * SHARD_BATCHES)) for n, size in zip(held, sizes, strict=True)]
    of_bucket = lambda values: F.get(F.array(*map(F.lit, values)), F.col("bucket"))
    spread = (
        lengths.withColumn("bucket", bucket)
        .withColumn("mixed", F.xxhash64("row"))
        .withColumn("bucket_tokens", of_bucket(bounds).cast("long"))
        .withColumn("size", of_bucket(sizes))
        .withColumn("shard", F.pmod("mixed", of_bucket(shards)).cast("long"))
    )
    order = Window.partitionBy("bucket", "shard").orderBy("mixed", "row")
    numbered = spread.withColumn("place", F.row_number().over(order) - 1)
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", "shard",
        F.floor(F.col("place") / F.col("size")).cast("long").alias("batch"),
        (F.col("place") % F.col("size")).cast("long").alias("slot"),
    )


