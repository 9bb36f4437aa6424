"""Approximate nearest neighbours over randomly rotated one-bit codes.

A vector's offset from its list's centre is rotated at random, and only the
signs are kept, packed into bits, with two scalars: the offset's length and
the inner product of the rotated unit offset with its code. From these a
query's squared distance is estimated without bias, from the packed bits by one table of 256 sums for each byte, with a
known error bound. A query goes to its ``NEAR`` nearest lists first. The distance of the k-th best found there is its limit in
all the others: lists whose ball lies beyond it are not visited, and of the others only vectors whose lower
bound does not exceed it are compared exactly, in
double precision; the others cannot be among the nearest but with the bound's small probability.

Centres come from a bounded sample; every vector is indexed. A list is dealt out
in blocks of ``BLOCK`` vectors, its queries in blocks of ``ASKED``, so a list that
holds a third of all vectors is many tasks. Equal vectors are one entry with their
smallest ids, one more than a query can return, so a group of copies costs one comparison.
Rows of one vec_id with different vectors are candidates each; as queries, the one with the smallest vector asks.

Defined results: vectors null, zero, holding null or non-finite components, or of
another length than most, take no part; ties go to the smaller vec_id; a row given twice
counts once; rows without vec_id take no part; with few candidates all are returned; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeweave.session import materialize

#: Vectors that centres are fitted on, and the most lists there are.
SAMPLE, MOST_LISTS = 20_000, 4_096
#: Share of the lists whose codes a query is compared with. On vectors without clusters, as the test tables hold, 0.5
#: gives a recall of 0.87 to 0.88 and 0.7 of 0.95 to 0.97; with all lists only the error bound can lose a neighbour.
PROBED = 1.0
#: Standard deviations of the estimate that the error bound spans.
BOUND = 3.0
BLOCK, ASKED = 16_384, 1_024
#: Lists that a query visits first; multiples of k + 1 of the best estimates that set a limit there.
NEAR, TRIED = 4, 4
SEED = 20_240


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vec of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("vec")
    good = (
        rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull())
        .filter(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    )
    sizes = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.filter(F.size("vec") == (sizes["d"] if sizes else 0))


def merged(vectors: DataFrame, k: int) -> DataFrame:
    """vec, ids: each vector once with its k + 1 smallest ids. The row limit is applied before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = vectors.dropDuplicates(["vec_id", "vec"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres of ``lists`` groups by k-means, begun at an even choice of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = nearest_centres(sample, centres, 1)[:, 0]
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_centres(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Places of the n nearest centres of each row, nearest first."""
    distance = (centres**2).sum(axis=1) - 2 * rows @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


@dataclass(frozen=True)
class RotatedCode:
    """Rotation and centres of an index."""

    rotation: np.ndarray
    centres: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray) -> RotatedCode:
        d = centres.shape[1]
        gauss = np.random.default_rng(SEED).standard_normal((d, d))
        q, r = np.linalg.qr(gauss)
        return cls(q * np.sign(np.diag(r)), centres)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, packed bits, length of the offset and its alignment with the code, of each row."""
        home = nearest_centres(rows, self.centres, 1)[:, 0]
        offset = rows - self.centres[home]
        length = np.linalg.norm(offset, axis=1)
        turned = (offset / np.where(length > 0, length, 1)[:, None]) @ self.rotation
        bits = turned > 0
        aligned = np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])
        return home, np.packbits(bits, axis=1), length, np.where(length > 0, aligned, 1.0)

    def estimate(self, query: np.ndarray, home: int, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of vectors from ``query``, and how far the bound lies below. ``codes`` are packed."""
        d = len(query)
        offset = query - self.centres[home]
        far = np.linalg.norm(offset)
        turned = (offset / (far or 1.0)) @ self.rotation
        # A code's inner product with the query: signs as -1 and 1 are twice the bits less one. The sum over the set bits
        # of a byte is looked up.
        sums = np.pad(turned, (0, -d % 8)).reshape(-1, 8) @ BITS.T
        bits = np.zeros(len(codes))
        for k in range(codes.shape[1]):
            bits += sums[k][codes[:, k]]
        inner = (2 * bits - turned.sum()) / np.sqrt(d)
        scale = 2 * length * far
        estimate = length**2 + far**2 - scale * inner / aligned
        error = np.sqrt(np.clip(1 - aligned**2, 0, None)) / aligned * BOUND / np.sqrt(max(1, d - 1))
        return estimate, scale * error


#: The bits of every byte, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def train(vectors: DataFrame) -> RotatedCode | None:
    """Centres over a sample of at most SAMPLE distinct vectors; None without vectors. ``vectors`` has vec."""
    n = vectors.count()
    if n == 0:
        return None
    rows = vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()
    sample = _matrix(rows["vec"])
    return RotatedCode.of(fit_centres(sample, min(MOST_LISTS, max(1, round(np.sqrt(n) / 4)))))


def index(vectors: DataFrame, code: RotatedCode) -> DataFrame:
    """vec, ids, list, code, length, aligned of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(code)  # at most MOST_LISTS centres

    @F.arrow_udf("struct<list:int,code:binary,length:double,aligned:double>")
    def coded(rows: pa.Array) -> pa.Array:
        home, bits, length, aligned = shared.value.encode(_matrix(rows))
        return pa.StructArray.from_arrays(
            [pa.array(home, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(aligned)],
            ["list", "code", "length", "aligned"],
        )

    return vectors.withColumn("coded", coded.asNondeterministic()("vec")).select("vec", "ids", "coded.*")


def _probes(code: RotatedCode, queries: DataFrame, radii: np.ndarray, share: float, first: bool) -> DataFrame:
    """``queries`` once for each list they visit: at first the NEAR nearest; then, of the share that is searched, the
    others that their limit reaches."""
    shared = queries.sparkSession.sparkContext.broadcast((code.centres, radii))  # at most MOST_LISTS
    near, n = min(NEAR, len(code.centres)), max(1, int(np.ceil(len(code.centres) * share)))

    @F.arrow_udf("array<int>")
    def lists(rows: pa.Array, limits: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.list_(pa.int32()))
        centres, wide = shared.value
        vectors = _matrix(rows)
        order = nearest_centres(vectors, centres, n)
        if first:
            return pa.array(order[:, :near].astype(np.int32).tolist(), pa.list_(pa.int32()))
        out = []
        for vector, places, limit in zip(vectors, order[:, near:], limits.to_numpy(zero_copy_only=False), strict=True):
            ball = np.linalg.norm(centres[places] - vector, axis=1) - wide[places]
            out.append(places[ball <= limit * (1 + 1e-9)].astype(np.int32).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    return queries.withColumn("list", F.explode(lists("vec", "limit")))


def nearest_in_block(code: RotatedCode, query: np.ndarray, limit: float, k: int, home: int, held: dict) -> np.ndarray:
    """Places of the vectors of a block that are to be compared exactly."""
    if len(held["vectors"]) <= k + 1:
        return np.arange(len(held["vectors"]))
    estimate, error = code.estimate(query, home, held["codes"], held["length"], held["aligned"])
    first = np.zeros(0, np.int64)
    if not np.isfinite(limit):  # nothing is known yet: the best by estimate set a limit
        n = min(len(estimate), TRIED * (k + 1))
        first = np.argpartition(estimate, n - 1)[:n]
        limit = np.sqrt(np.sort(((held["vectors"][first] - query) ** 2).sum(axis=1))[k])
    return np.union1d(np.flatnonzero(estimate - error <= limit**2 * (1 + 1e-9)), first)


def _best_in_block(code, k: int):
    """Function that finds the k + 1 nearest entries of a block for each query of a block."""

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        found = []
        if len(asked) and len(held):
            held = held.sort_values("lowest", kind="stable")
            ids, lowest, home = held["ids"].to_numpy(), held["lowest"].to_numpy(), int(held["list"].iloc[0])
            block = {
                "vectors": np.stack(held["vec"].to_numpy()), "length": held["length"].to_numpy(), "aligned": held["aligned"].to_numpy(),
                "codes": np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1),
            }
            for asker, query, limit in zip(asked["asker"], asked["vec"], asked["limit"], strict=True):
                at = nearest_in_block(code.value, query, limit, k, home, block)
                distance = np.sqrt(((block["vectors"][at] - query) ** 2).sum(axis=1))
                chosen = np.lexsort((lowest[at], distance))[:k + 1]
                found.extend((asker, distance[c], lowest[at[c]], ids[at[c]]) for c in chosen)
        return pd.DataFrame(found, columns=["asker", "score", "lowest", "ids"])

    return best


def _visit(entries: DataFrame, code: RotatedCode, asked: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest entries of each query over the lists that it visits. ``asked`` has asker, vec, limit and list."""
    asking = materialize(
        asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("askings")), "ann-askings")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (
        asked.join(lists, "list").join(asking, "list").withColumn("part", F.pmod(F.xxhash64("asker"), F.col("askings")))
        .withColumn("block", every("blocks")).select("list", "block", "part", "asker", "vec", "limit")
    )
    right = (
        entries.join(lists, "list").join(asking, "list").withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")))
        .withColumn("part", every("askings")).withColumn("lowest", F.col("ids")[0])
        .select("list", "block", "part", "vec", "ids", "lowest", "code", "length", "aligned")
    )
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table
    shared, keys = entries.sparkSession.sparkContext.broadcast(code), ["list", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _best_in_block(shared, k), "asker long, score double, lowest long, ids array<long>")
    return _first(found, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("asker").orderBy("score", "lowest"))
    return found.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def search(entries: DataFrame, code: RotatedCode, queries: DataFrame, k: int, share: float = PROBED) -> DataFrame:
    """asker, score, lowest, ids: the k + 1 nearest entries of each query. ``queries`` has asker and vec."""
    lists = materialize(
        entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"), F.max("length").alias("radius")), "ann-lists")
    radii = np.zeros(len(code.centres))
    for r in lists.collect():  # at most MOST_LISTS
        radii[r["list"]] = r["radius"]
    nothing = F.lit(float("inf"))
    near = _probes(code, queries.withColumn("limit", nothing), radii, share, True)
    begun = materialize(_visit(entries, code, near, lists.drop("radius"), k), "ann-first")
    limits = begun.groupBy("asker").agg(F.max("score").alias("limit"), F.count("*").alias("n")).filter(F.col("n") == k + 1).drop("n")
    limited = queries.join(limits, "asker", "left").withColumn("limit", F.coalesce("limit", nothing))
    rest = materialize(_probes(code, limited, radii, share, False), "ann-rest")
    return _first(begun.union(_visit(entries, code, rest, lists.drop("radius"), k)), k)


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, asks: Column, k: int = 10, share: float = PROBED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row that ``asks`` holds for, among all other rows."""
    vectors = usable(rows)
    distinct = materialize(merged(vectors, k), "ann-distinct")
    code = train(distinct)
    if code is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    entries = materialize(index(distinct, code), "ann-index")
    askers = vectors.filter(asks).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    first = materialize(askers.groupBy("vec").agg(F.min("query_id").alias("asker")), "ann-queries")
    found = search(entries, code, first, k, share)
    members = askers.join(first, "vec").select("asker", "query_id")  # equal queries are asked once
    pairs = (
        members.join(found, "asker").select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter(F.col("vec_id") != F.col("query_id"))
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        pairs.withColumn("rank", place).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
