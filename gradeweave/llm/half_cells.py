"""Hard negatives by inner product over an inverted multi-index.

Vectors of whole numbers are cut in two halves, each with a codebook of its own; the two codes of a vector name its
cell. For an anchor, no vector of a cell scores more than the anchor's halves with the two codewords plus, for each
half, the half's length times the codeword's radius, the largest distance of any vector from it. A multi-sequence heap
over the two sorted lists of half bounds visits cells in the order of that sum.

Every search goes over the index twice. The first visit ends after ``SEEDS`` vectors; the scores found tell how good a
result must be, as at least so many are as good. The second visit takes every cell whose bound reaches that score, and
ends there: what it leaves cannot enter the result, which is so certified and exact. An anchor's positives come first;
each positive's score then opens a window of scores for its negatives, and the visit goes on until the windows of all
positives are certified or the bounds lie below all of them.

Cells are held in blocks of about ``BLOCK`` vectors. An anchor is sent once to every block that holds a cell it visits,
and meets the block in groups of about ``ASKED`` anchors. Copies of one vector fill a cell, which is then dealt into
many blocks. Codebooks are fitted on a bounded sample; every vector is indexed, and radii are taken over all of them.

Defined results: rows without vec_id, label or vector, with a null component, none at all or another
number of components than most take no part; of several rows with one vec_id the one with the smallest label, then the smallest vector counts;
ties go to the smaller vec_id; anchors without a row of their label, or with a negative best score, have no negatives;
extra columns are dropped. Scores that do not fit a long are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from gradeweave.llm.rotated_codes import fit_centres, nearest_centres
from gradeweave.session import materialize

#: Vectors that codebooks are fitted on, the most words of a codebook, and vectors of a cell to aim at.
SAMPLE, MOST_WORDS, CELL = 20_000, 256, 32
#: Vectors of a block, anchors that meet a block at a time, and vectors of a first visit.
BLOCK, ASKED, SEEDS = 8_192, 1_024, 2_048


@dataclass(frozen=True)
class Codebooks:
    """Words and radii of both halves, and how many vectors and which blocks each cell has."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    held: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray
    n_firsts: int

    @property
    def cut(self) -> int:
        return self.words[0].shape[1]

    def half_bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, what a vector of its half scores with the anchor's half at most, rounding included."""
        out = []
        for half, words, radius in zip((anchor[:self.cut], anchor[self.cut:]), self.words, self.radii, strict=True):
            half = half.astype(np.float64)
            length, sizes = np.linalg.norm(half), np.linalg.norm(words, axis=1)
            out.append(words @ half + length * radius + 1e-9 * length * (radius + sizes) + 0.25)
        return out[0], out[1]

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, int]]:
        """Bound and number of every cell that holds vectors, by falling bounds."""
        one, two = self.half_bounds(anchor)
        rows, cols = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        up, left = one[rows].tolist(), two[cols].tolist()
        heap = [(-(up[0] + left[0]), 0, 0)]
        wide = len(two)
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(left):
                heapq.heappush(heap, (-(up[i] + left[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-(up[i + 1] + left[0]), i + 1, 0))
            cell = int(rows[i]) * wide + int(cols[j])
            if self.held[cell]:
                yield -bound, cell

    def seeds(self, anchor: np.ndarray, vectors: int) -> tuple[float, np.ndarray]:
        """The bound at which a visit has met so many vectors, and the blocks of the cells visited."""
        seen, bound, cells = 0, np.inf, []
        for bound, cell in self.visits(anchor):
            cells.append(cell)
            seen += int(self.held[cell])
            if seen >= vectors:
                break
        return bound, self.blocks_of(cells)

    def certified(self, anchor: np.ndarray, least: float) -> np.ndarray:
        """The blocks of all cells whose bound reaches ``least``."""
        cells, met = [], set()
        for bound, cell in self.visits(anchor):
            if bound < least - 1:  # a visit and its blocks may round a bound unlike
                break
            cells.append(cell)
            met.add(int(self.first_block[cell]))
            if len(met) == self.n_firsts:  # all there are
                break
        return self.blocks_of(cells)

    def blocks_of(self, cells: list[int]) -> np.ndarray:
        if not cells:
            return np.zeros(0, np.int64)
        spans = [np.arange(self.first_block[c], self.first_block[c] + max(1, self.blocks[c])) for c in cells]
        return np.unique(np.concatenate(spans))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sound(items: DataFrame) -> DataFrame:
    """vec_id, label, ints: one row for each vec_id that takes part."""
    good = (
        items.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("ints").cast("array<long>"))
        .filter("vec_id is not null and label is not null and ints is not null")
        .filter(~F.exists("ints", F.isnull) & (F.size("ints") > 0))
    )
    sizes = good.groupBy(F.size("ints").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    one = good.filter(F.size("ints") == (sizes["d"] if sizes else 0)).groupBy("vec_id").agg(F.min(F.struct("label", "ints")).alias("x"))
    return one.select("vec_id", "x.label", "x.ints")


def blocks_for(held: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of its own for each cell; cells in a row share a block while they fit."""
    first, own, now, filled = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), -1, block + 1
    for cell in np.flatnonzero(held):
        n = int(held[cell])
        if n > block:
            own[cell], first[cell] = -(-n // block), now + 1
            now, filled = now + int(own[cell]), block + 1
        else:
            if filled + n > block:
                now, filled = now + 1, 0
            first[cell], filled = now, filled + n
    return first, own


CODES = StructType([StructField("one", IntegerType()), StructField("two", IntegerType()), StructField("far_one", LongType()), StructField("far_two", LongType())])


@dataclass(frozen=True)
class MultiIndex:
    """The blocks of an index, its codebooks, and its vectors as rows."""

    books: Codebooks
    blocks: DataFrame
    items: DataFrame
    kind: str

    @classmethod
    def build(cls, items: DataFrame) -> MultiIndex | None:
        """Index over all ``items``, as ``sound`` gives them; None where there are none."""
        n = items.count()
        if n == 0:
            return None
        spark, context = items.sparkSession, items.sparkSession.sparkContext
        rows = _matrix(items.select("ints").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()["ints"]).astype(np.float64)
        d, k = rows.shape[1], min(MOST_WORDS, max(1, round(np.sqrt(n / CELL))))
        words = tuple(fit_centres(half, k) for half in (rows[:, :d // 2], rows[:, d // 2:]))
        shared = context.broadcast(words)  # at most MOST_WORDS words of each half

        @F.arrow_udf(CODES)
        def coded(column: pa.Array) -> pa.Array:
            m = _matrix(column).astype(np.float64) if len(column) else np.zeros((0, d))
            out = []
            for half, book in zip((m[:, :d // 2], m[:, d // 2:]), shared.value, strict=True):
                near = nearest_centres(half, book, 1)[:, 0]
                out.append((near, np.ceil(np.linalg.norm(half - book[near], axis=1)).astype(np.int64)))
            (one, far_one), (two, far_two) = out
            return pa.StructArray.from_arrays(
                [pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(far_one), pa.array(far_two)], names=CODES.names)

        placed = materialize(items.withColumn("code", coded.asNondeterministic()("ints")).select(*items.columns, "code.*"), "negatives-codes")
        most = placed.agg(F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints"))))).first()[0] or 0
        if d * most**2 >= 1 << 63:
            raise ValueError("scores of these vectors do not fit a long")
        # Exact either way: products and sums below 2^53 are whole numbers in doubles, which are faster to multiply.
        kind = "float64" if d * most**2 < 1 << 53 else "int64"
        held = np.zeros(len(words[0]) * len(words[1]), np.int64)
        radii = tuple(np.zeros(len(w)) for w in words)
        for r in placed.groupBy("one", "two").agg(F.count("*").alias("n"), F.max("far_one").alias("a"), F.max("far_two").alias("b")).collect():
            held[r["one"] * len(words[1]) + r["two"]] = r["n"]  # at most MOST_WORDS squared rows
            radii[0][r["one"]], radii[1][r["two"]] = max(radii[0][r["one"]], r["a"]), max(radii[1][r["two"]], r["b"])
        first, own = blocks_for(held, BLOCK)
        used = np.flatnonzero(held)
        books = Codebooks(words, radii, held, first, own, len(np.unique(first[used])))
        places = spark.createDataFrame(
            pd.DataFrame({"cell": used, "first_block": first[used], "own": np.maximum(own[used], 1)}), "cell long, first_block long, own long")
        cell = F.col("one").cast("long") * len(words[1]) + F.col("two")
        dealt = (
            placed.withColumn("cell", cell).join(F.broadcast(places), "cell")  # at most MOST_WORDS squared rows
            .withColumn("block", F.col("first_block") + F.pmod(F.xxhash64("vec_id"), "own"))
            .select("block", "cell", "vec_id", "label", "ints")
        )

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["cell", "vec_id"])
            whole = lambda c: rows[c].to_numpy(np.int64).tobytes()
            m = np.stack(rows["ints"].to_numpy())
            return pd.DataFrame([{
                "block": int(rows["block"].iloc[0]), "cells": whole("cell"), "ids": whole("vec_id"), "labels": whole("label"),
                "wide": bool(np.abs(m).max(initial=0) >= 1 << 31), "vectors": (m if np.abs(m).max(initial=0) >= 1 << 31 else m.astype(np.int32)).tobytes(),
            }])

        blocks = materialize(
            dealt.groupBy("block").applyInPandas(packed, "block long, cells binary, ids binary, labels binary, wide boolean, vectors binary"),
            "negatives-blocks")
        return cls(books, blocks, placed.select("vec_id", "label", "ints"), kind)


@dataclass
class Held:
    """A block unpacked."""

    cells: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, row: pd.Series, kind: str, d: int) -> Held:
        whole = lambda c: np.frombuffer(row[c], np.int64)
        vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int32).reshape(-1, d).astype(kind)
        return cls(whole("cells"), whole("ids"), whole("labels"), vectors)

    def scores(self, books: Codebooks, anchor: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors in cells whose bound reaches ``least``, and their scores."""
        one, two = books.half_bounds(anchor)
        near = one[self.cells // len(two)] + two[self.cells % len(two)] >= least - 1  # as ``certified`` rounds
        at = np.arange(len(near)) if near.all() else np.flatnonzero(near)
        vectors = self.vectors if len(at) == len(near) else self.vectors[at]
        return at, (vectors @ anchor.astype(vectors.dtype)).astype(np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


ASKS = "block long, anchor_id long, label long, ints array<long>, least double, low array<long>, high array<long>, positives array<long>"


def asks(index: MultiIndex, anchors: DataFrame, seeds: int | None) -> DataFrame:
    """A row for each block that an anchor visits: on a first visit, until so many seeds are met; else, as far as bounds
    reach its ``least``."""
    shared = anchors.sparkSession.sparkContext.broadcast(index.books)

    def visited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        for rows in batches:
            if rows.empty:
                continue
            blocks, least = [], []
            for anchor, bound in zip(rows["ints"], rows["least"], strict=True):
                met = books.certified(anchor, bound) if seeds is None else None
                if met is None:
                    bound, met = books.seeds(anchor, seeds)
                blocks.append(met)
                least.append(bound)
            yield rows.assign(least=least, block=blocks).explode("block").dropna(subset=["block"]).astype({"block": "int64"})[
                ["block", "anchor_id", "label", "ints", "least", "low", "high", "positives"]]

    return materialize(anchors.mapInPandas(visited, ASKS), "negatives-asks")


def met(index: MultiIndex, asking: DataFrame, search, schema: str) -> DataFrame:
    """What ``search`` finds for each anchor in each block it visits."""
    books, kind = asking.sparkSession.sparkContext.broadcast(index.books), index.kind
    d = sum(w.shape[1] for w in index.books.words)
    sizes = materialize(asking.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("parts")), "negatives-parts")
    left = asking.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("anchor_id"), "parts")).drop("parts")
    right = index.blocks.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def run(anchors: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(blocks):
            held = Held.of(blocks.iloc[0], kind, d)
            for row in anchors.itertuples():
                at, scores = held.scores(books.value, row.ints, row.least)
                found.extend(search(row, held, at, scores))
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])

    keys = ["block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(k: int):
    def search(row, held: Held, at: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        same = (held.labels[at] == row.label) & (held.ids[at] != row.anchor_id)
        at, scores = at[same], scores[same]
        for p in first(scores, held.ids[at], k):
            yield row.anchor_id, held.ids[at[p]], scores[p]

    return search


def _negatives(k: int):
    def search(row, held: Held, at: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        other = held.labels[at] != row.label
        at, scores = at[other], scores[other]
        for name, low, high, score in zip(row.positives[::2], row.low, row.high, row.positives[1::2], strict=True):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            for p in inside[first(scores[inside], held.ids[at[inside]], k)]:
                yield row.anchor_id, name, score, held.ids[at[p]], scores[p]

    return search


def _best(found: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))
    return found.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)


def _asking(anchors: DataFrame, least: Column, **windows: Column) -> DataFrame:
    none = F.array().cast("array<long>")
    return anchors.select(
        "anchor_id", "label", "ints", least.cast("double").alias("least"),
        *(windows.get(c, none).alias(c) for c in ("low", "high", "positives")))


def positives(index: MultiIndex, anchors: DataFrame, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank: the k highest other rows of each anchor's label."""
    search, nothing = _positives(k), F.lit(float("-inf"))
    seen = _best(met(index, asks(index, _asking(anchors, nothing), SEEDS), search, POSITIVES), ["anchor_id"], "positive_score", "positive_id", k)
    limit = seen.filter(F.col("rank") == k).select("anchor_id", F.col("positive_score").alias("limit"))
    sure = _asking(anchors.join(limit, "anchor_id", "left"), F.coalesce(F.col("limit").cast("double"), nothing))
    found = met(index, asks(index, sure, None), search, POSITIVES)
    return materialize(_best(found, ["anchor_id"], "positive_score", "positive_id", k), "negatives-positives")


def negatives(index: MultiIndex, anchors: DataFrame, chosen: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k highest rows of another label in each positive's window, from low to high percent of its score."""
    score = F.col("positive_score")
    window = F.struct(
        F.col("rank"), F.col("positive_id"), score.alias("score"),
        F.expr(f"positive_score div 100 * {low} + (positive_score % 100 * {low} + 99) div 100").alias("low"),
        F.expr(f"positive_score div 100 * {high} + positive_score % 100 * {high} div 100").alias("high"))
    opened = chosen.filter(score >= 0).groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("w"))  # at most one each
    asking = materialize(anchors.join(opened, "anchor_id"), "negatives-windows")
    flat = F.flatten(F.transform("w", lambda x: F.array(x["positive_id"], x["score"])))
    windows = {"low": F.col("w.low"), "high": F.col("w.high"), "positives": flat}
    search, keys = _negatives(k), ["anchor_id", "positive_id"]
    lowest = F.array_min("w.low")
    seen = _best(met(index, asks(index, _asking(asking, lowest, **windows), SEEDS), search, NEGATIVES), keys, "negative_score", "negative_id", k)
    # A window with k found is certified down to the last of these, one with fewer down to its own end.
    full = seen.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "negative_score"))).alias("full"))
    ends = F.array_min(F.transform("w", lambda x: F.coalesce(F.try_element_at("full", x["positive_id"]), x["low"])))
    sure = _asking(asking.join(full, "anchor_id", "left"), ends, **windows)
    return _best(met(index, asks(index, sure, None), search, NEGATIVES), keys, "negative_score", "negative_id", k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    items: DataFrame, is_anchor: Column | str, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row that is an anchor.

    ``items`` has vec_id, label and ints, an array of whole numbers. Positives are the first rows of an anchor's label,
    negatives the first of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    index = MultiIndex.build(materialize(sound(items), "negatives-rows"))
    if index is None:
        return items.sparkSession.createDataFrame([], RESULT)
    anchors = index.items.filter(is_anchor).withColumnRenamed("vec_id", "anchor_id")
    chosen = positives(index, anchors, n_positives)
    return negatives(index, anchors, chosen, n_negatives, low, high).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
