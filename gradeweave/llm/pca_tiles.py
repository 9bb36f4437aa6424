"""Embedding near-dedup by cosine: tiles of vectors compared along their principal axes.

Unit vectors are turned so that the leading dimensions hold most of their energy, which changes no inner product. Two
tiles are compared dimension by dimension: the inner products of the first ``STAGES[0]`` dimensions are accumulated
first; what the other dimensions can still add is at most the product of the two vectors' suffix norms. Pairs whose
sum with that bound stays below the threshold are dropped, the others go on with more dimensions. What is left, and
close to the threshold, is decided by the cosine of the vectors as given, in double precision.

Vectors meet in tiles. A tree of cuts along the leading axes, fitted on a bounded sample, puts like vectors together; a
leaf with more vectors than a tile holds is dealt into several. A pair of tiles is skipped where their boxes along
the leading axes, with suffix norms, or their angles around their centres show that no pair can reach the threshold,
and counted without comparing where these angles show that every pair does. Pairs of tiles come from an equi-join on
cells of the two leading axes, as wide as two linked vectors can be apart, so tiles farther apart never meet.

A pair of tiles gives, for every vector, the number of its links, and the links of a spanning forest, so a group of
near copies gives rows in proportion to its members. Equal vectors are one entry with its number of copies.

Comparing is quadratic in the vectors that lie in reach of each other, as every link counts; nothing is sampled or
capped, and no link is missed.

Defined results: vectors null, zero, empty, holding null or non-finite components, or of another length than most link
with nothing, and so do rows without a vec_id; these are kept. Every row comes out; of rows with equal vectors and ids
each counts as a vector of its own. A threshold must lie between 0, which is left out, and 1. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from gradeweave.operators.components import components
from gradeweave.session import materialize

#: Vectors that axes and cuts are fitted on, and the most leaves of the tree.
SAMPLE, MOST_LEAVES = 20_000, 1_024
#: Vectors of a tile: a sixteenth of all within these.
LEAST_TILE, MOST_TILE = 1_024, 16_384
#: Tiles that meet one copy of another tile in one group, on average.
GUESTS = 16
#: Leading axes that cut the tree and bound pairs of tiles; dimensions at which pairs are dropped; rows compared at once.
LEADING, STAGES, ROWS = 8, (8, 16, 32, 64, 128, 256, 512), 256
#: What rounding in the turned space may amount to, by far.
SLACK = 1e-9


def units(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square overflows or vanishes."""
    if len(rows) == 0:
        return rows
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


@dataclass(frozen=True)
class Axes:
    """Principal axes as columns, and a tree of cuts: axis, place and the two nodes behind; a leaf has axis -1."""

    turn: np.ndarray
    cuts: list[tuple[int, float, int, int]]

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int) -> Axes:
        rows = units(sample)
        _, vectors = np.linalg.eigh(rows.T @ rows)
        turn = vectors[:, ::-1]
        cuts: list[tuple[int, float, int, int]] = []

        def grow(part: np.ndarray, wanted: int) -> int:
            at = len(cuts)
            cuts.append((-1, 0.0, wanted, 0))
            if wanted > 1 and len(part) > 1:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                place = float(np.median(part[:, axis]))
                low = part[:, axis] < place
                if low.any():
                    left = grow(part[low], wanted // 2)
                    cuts[at] = (axis, place, left, grow(part[~low], wanted - wanted // 2))
            return at

        grow((rows @ turn)[:, :LEADING], leaves)
        return cls(turn, cuts)

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        """Number of the leaf of each turned unit vector."""
        out = np.zeros(len(turned), np.int32)
        walk = [(0, np.arange(len(turned)))]
        while walk:
            at, rows = walk.pop()
            axis, place, left, right = self.cuts[at]
            if axis < 0:
                out[rows] = at
            else:
                low = turned[rows, axis] < place
                walk += [(left, rows[low]), (right, rows[~low])]
        return out


@dataclass
class Tile:
    """Vectors of a tile as given, and turned on first use."""

    given: np.ndarray
    copies: np.ndarray
    turned: np.ndarray = field(init=False)
    suffix: np.ndarray = field(init=False)

    def turn(self, axes: Axes) -> Tile:
        self.turned = units(self.given) @ axes.turn
        squares = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate([squares, np.zeros((len(squares), 1))], axis=1))
        return self


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of vectors as given, row by row."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def stages(d: int) -> list[int]:
    return [k for k in STAGES if k < d] + [d]


def linked(a: Tile, b: Tile, begin: int, end: int, threshold: float) -> np.ndarray:
    """Which rows of ``b`` are linked with each row of ``a`` from ``begin`` to ``end``."""
    x, y, least = a.turned[begin:end], b.turned, threshold - SLACK
    ends = stages(x.shape[1])
    total, done = x[:, :ends[0]] @ y[:, :ends[0]].T, ends[0]
    alive = total + a.suffix[begin:end, done, None] * b.suffix[None, :, done] >= least
    while done < x.shape[1] and np.count_nonzero(alive) * 8 > alive.size:  # many are left: all go on together
        nxt = ends[ends.index(done) + 1]
        total += x[:, done:nxt] @ y[:, done:nxt].T
        done = nxt
        alive = total + a.suffix[begin:end, done, None] * b.suffix[None, :, done] >= least
    rows, cols = np.nonzero(alive)
    sums = total[rows, cols]
    for nxt in ends[ends.index(done) + 1:]:  # few are left: each goes on alone
        sums = sums + np.einsum("ij,ij->i", x[rows, done:nxt], y[cols, done:nxt])
        done = nxt
        on = sums + a.suffix[begin + rows, done] * b.suffix[cols, done] >= least
        rows, cols, sums = rows[on], cols[on], sums[on]
    sure = sums >= threshold + SLACK
    for k in range(0, len(near := np.flatnonzero(~sure)), 65_536):
        at = near[k:k + 65_536]
        sure[at] = cosine(a.given[begin + rows[at]], b.given[cols[at]]) >= threshold
    out = np.zeros(alive.shape, bool)
    out[rows[sure], cols[sure]] = True
    return out


def compared(a: Tile, b: Tile, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each row of ``a`` and of ``b``, counting copies, and links of a spanning forest between them.

    Places in ``b`` follow those in ``a`` unless both are the same tile; then all counts are in the first array.
    """
    n, shift = len(a.given), 0 if same else len(a.given)
    counts = np.zeros(n + (0 if same else len(b.given)), np.int64)
    root, forest = np.arange(len(counts)), []
    for begin in range(0, n, ROWS):
        end = min(begin + ROWS, n)
        near = linked(a, b, begin, end, threshold)
        if same:
            near &= np.arange(begin, end)[:, None] < np.arange(n)[None, :]
        if not near.any():
            continue
        counts[begin:end] += near @ b.copies
        counts[shift:shift + len(b.given)] += a.copies[begin:end] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            hits = shift + np.flatnonzero(near[i])
            mine = root[begin + i]
            others, first = np.unique(root[hits], return_index=True)
            if len(others) > 1 or others[0] != mine:
                forest.extend((begin + i, int(hits[f])) for r, f in zip(others, first, strict=True) if r != mine)
                root[np.isin(root, others)] = mine
    return counts[:n], counts[n:], forest


def all_linked(a: Tile, b: Tile, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """As ``compared``, where every pair is known to be linked."""
    n, m = len(a.given), len(b.given)
    if same:
        return a.copies.sum() - a.copies, np.zeros(0, np.int64), [(0, i) for i in range(1, n)]
    star = [(0, n + j) for j in range(m)] + [(i, n) for i in range(1, n)]
    return np.full(n, b.copies.sum()), np.full(m, a.copies.sum()), star


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(distinct: DataFrame, tiles: int) -> Axes:
    rows = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()
    return Axes.fit(_matrix(rows["vec"]), min(MOST_LEAVES, tiles))


def entries(distinct: DataFrame, axes: Axes, tile_rows: int) -> DataFrame:
    """node, tile, vec, copies, lowest of every distinct vector; a node's number begins with its tile's."""
    shared = distinct.sparkSession.sparkContext.broadcast(axes)  # d * d numbers and at most MOST_LEAVES cuts

    @F.arrow_udf(IntegerType())
    def leaf(rows: pa.Array) -> pa.Array:
        held = shared.value
        return pa.array(held.leaf(units(_matrix(rows)) @ held.turn) if len(rows) else [], pa.int32())

    placed = materialize(distinct.withColumn("leaf", leaf.asNondeterministic()("vec")), "dedup-leaves")
    sizes = placed.groupBy("leaf").agg(F.greatest(F.round(F.count("*") / tile_rows), F.lit(1)).cast("long").alias("blocks"))
    dealt = (
        placed.join(F.broadcast(sizes), "leaf")  # at most MOST_LEAVES rows
        .withColumn("tile", F.shiftleft(F.col("leaf").cast("long"), 30) + F.pmod(F.xxhash64("vec"), "blocks"))
    )
    place = F.row_number().over(Window.partitionBy("tile").orderBy("lowest", "vec")) - 1
    return dealt.select((F.shiftleft("tile", 20) + place).alias("node"), "tile", "vec", "copies", "lowest")


TILES = "tile long, held int, wide boolean, vectors binary, copies binary, box_low array<double>, box_high array<double>, tails array<double>, centre array<double>, spread double"


def tiles_of(listed: DataFrame, axes: Axes) -> DataFrame:
    """Each tile as one row: its vectors in the order of their nodes, and what bounds its pairs with others."""
    shared = listed.sparkSession.sparkContext.broadcast(axes)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        given = np.stack(rows["vec"].to_numpy())
        with np.errstate(over="ignore"):
            narrow = given.astype(np.float32)
        wide = not np.array_equal(narrow, given)
        tile = Tile(given, rows["copies"].to_numpy()).turn(shared.value)
        lead = tile.turned[:, :LEADING]
        centre = units(tile.turned.mean(axis=0, keepdims=True) + 1e-300)[0]
        spread = float(np.arccos(np.clip(tile.turned @ centre, -1, 1)).max())
        return pd.DataFrame([{
            "tile": int(rows["tile"].iloc[0]), "held": len(rows), "wide": wide,
            "vectors": (given if wide else narrow).tobytes(), "copies": tile.copies.astype(np.int64).tobytes(),
            "box_low": lead.min(axis=0), "box_high": lead.max(axis=0),
            "tails": tile.suffix[:, 1:LEADING + 1].max(axis=0), "centre": centre, "spread": spread,
        }])

    return listed.groupBy("tile").applyInPandas(packed, TILES)


def reach(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of tiles, whether any pair of vectors may be linked, and whether all surely are."""
    part = lambda x, name: np.stack(x[name].to_numpy())
    angle = np.arccos(np.clip((part(a, "centre") * part(b, "centre")).sum(axis=1), -1, 1))
    around, widest = (a["spread"] + b["spread"]).to_numpy(), np.arccos(threshold)
    ends = [(part(a, p) * part(b, q)) for p in ("box_low", "box_high") for q in ("box_low", "box_high")]
    bound = np.cumsum(np.max(ends, axis=0), axis=1) + part(a, "tails") * part(b, "tails")
    # Angles near zero are known to about the square root of a rounding error only.
    return (angle - around <= widest + 1e-6) & (bound.min(axis=1) >= threshold - SLACK), angle + around < widest - 1e-6


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """owner, guest, sure: pairs of tiles that may hold linked vectors, each once; ``sure`` if all are."""
    width = max(0.1, float(np.sqrt(2 - 2 * threshold)) + 1e-6)
    summary = tiles.select("tile", "box_low", "box_high", "tails", "centre", "spread")
    span = lambda k, more: F.sequence(
        F.floor((F.coalesce(F.get("box_low", F.lit(k)), F.lit(0.0)) - more) / width),
        F.floor((F.coalesce(F.get("box_high", F.lit(k)), F.lit(0.0)) + more) / width))
    cells = lambda more: (
        summary.withColumn("one", F.explode(span(0, more))).withColumn("two", F.explode(span(1, more))).select("tile", "one", "two"))
    met = (
        cells(0.0).join(cells(width).withColumnRenamed("tile", "other"), ["one", "two"])
        .filter("tile <= other").select("tile", "other").distinct()
    )
    sides = ["box_low", "box_high", "tails", "centre", "spread"]
    with_bounds = (
        met.join(summary, "tile")
        .join(summary.select(F.col("tile").alias("other"), *(F.col(c).alias(f"other_{c}") for c in sides)), "other")
    )

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in batches:
            if len(pairs):
                other = pairs[[f"other_{c}" for c in sides]].set_axis(sides, axis=1)
                may, sure = reach(pairs[sides], other, threshold)
                yield pd.DataFrame({"tile": pairs["tile"], "other": pairs["other"], "sure": sure})[may]

    kept = with_bounds.mapInPandas(judged, "tile long, other long, sure boolean")
    # Either side owns half of its pairs.
    turn = F.pmod(F.xxhash64("tile", "other"), F.lit(2)) == 0
    return kept.select(
        F.when(turn, F.col("tile")).otherwise(F.col("other")).alias("owner"),
        F.when(turn, F.col("other")).otherwise(F.col("tile")).alias("guest"), "sure")


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _found(owner: int, guest: int, mine: np.ndarray, theirs: np.ndarray, forest: list[tuple[int, int]]) -> pa.RecordBatch:
    """Numbers of links as rows without b, links of the forest as rows without n."""
    nodes = np.concatenate([(owner << 20) + np.arange(len(mine)), (guest << 20) + np.arange(len(theirs))])
    counts = np.concatenate([mine, theirs])
    some = counts > 0
    a, b = np.array(forest, np.int64).reshape(-1, 2).T
    none = lambda n, kind=pa.int64(): pa.nulls(n, kind)
    columns = [
        pa.concat_arrays([pa.array(nodes[some]), pa.array(nodes[a])]),
        pa.concat_arrays([none(int(some.sum())), pa.array(nodes[b])]),
        pa.concat_arrays([pa.array(counts[some], pa.int64()), none(len(a))]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=FOUND)


def links(tiles: DataFrame, axes: Axes, threshold: float) -> DataFrame:
    """a, b, n: partial numbers of links of nodes (no b), and links whose components are those of all pairs (no n)."""
    shared = tiles.sparkSession.sparkContext.broadcast(axes)
    pairs = materialize(tile_pairs(tiles, threshold), "dedup-pairs")
    parts = pairs.groupBy("owner").agg(F.ceil(F.count("*") / GUESTS).cast("long").alias("parts"))
    dealt = pairs.join(parts, "owner").withColumn("part", F.pmod(F.xxhash64("guest"), "parts"))
    body = lambda side: tiles.select(F.col("tile").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("wide", "vectors", "copies")))
    owners = dealt.select("owner", "part").distinct().join(body("owner"), "owner")
    owners = owners.toDF(*owners.columns)  # columns of its own, as both sides come from one table
    guests = dealt.select("owner", "part", "guest", "sure").join(body("guest"), "guest")
    d = len(axes.turn)

    def tile(row: dict, side: str) -> Tile:
        given = np.frombuffer(row[f"{side}_vectors"], np.float64 if row[f"{side}_wide"] else np.float32)
        return Tile(given.astype(np.float64).reshape(-1, d), np.frombuffer(row[f"{side}_copies"], np.int64)).turn(shared.value)

    def run(guests: pa.Table, owners: pa.Table) -> pa.Table:
        out = []
        if len(guests) and len(owners):
            owner = owners.slice(0, 1).to_pylist()[0]
            a = tile(owner, "owner")
            for k in range(len(guests)):
                row = guests.slice(k, 1).to_pylist()[0]
                same = row["guest"] == owner["owner"]
                b = a if same else tile(row, "guest")
                made = all_linked(a, b, same) if row["sure"] else compared(a, b, same, threshold)
                out.append(_found(owner["owner"], row["guest"], *made))
        return pa.Table.from_batches(out, FOUND)

    keys = ["owner", "part"]
    return guests.groupBy(*keys).cogroup(owners.groupBy(*keys)).applyInArrow(run, "a long, b long, n long")


def marked(rows: DataFrame) -> DataFrame:
    """vec_id and vec of every row, vec null where the row links with nothing."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    given = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    good = F.col("vec_id").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    sound = given.withColumn("vec", F.when(good, F.col("vec")))
    sizes = sound.filter("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return sound.withColumn("vec", F.when(F.size("vec") == (sizes["d"] if sizes else 0), F.col("vec")))


def near_duplicates(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. ``rows`` has vec_id and embedding.

    n_links counts the other rows that a row is linked with directly; component_id is the smallest vec_id that links
    reach; kept says whether it is the row's own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and up to 1")
    held = materialize(marked(rows), "dedup-rows")
    good, alone = held.filter("vec is not null"), held.filter("vec is null")
    distinct = materialize(
        good.groupBy("vec").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies")), "dedup-distinct")
    none = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n = distinct.count()
    if n == 0:
        return none
    tile_rows = min(MOST_TILE, max(LEAST_TILE, n // 16))
    axes = fit(distinct, -(-n // tile_rows))
    listed = materialize(entries(distinct, axes, tile_rows), "dedup-entries")
    found = materialize(links(materialize(tiles_of(listed, axes), "dedup-tiles"), axes, threshold), "dedup-links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b")).select(F.col("u").alias("node"), "root")
    nodes = (
        listed.select("node", "vec", "copies", "lowest").join(counts, "node", "left").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    # Grouped by the root as a struct, so that the join's shuffle is its own and can split a component with many members.
    lowest = nodes.groupBy(F.struct("root").alias("k")).agg(F.min("lowest").alias("component_id")).select("k.root", "component_id")
    classes = nodes.join(lowest, "root").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    placed = good.join(classes, "vec").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return placed.unionByName(none)
