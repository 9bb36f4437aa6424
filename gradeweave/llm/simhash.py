"""SimHash near-duplicates, linked by multi-index hashing.

Fingerprints of 64 bits are cut into ``SEGMENTS``; two that differ in few
enough bits differ in at most ``radius`` bits within one segment. So every distinct
fingerprint stands in one table per segment, and the small Hamming ball around
each segment's value is looked up there. What meets under one key is verified
over all 64 bits. Of a pair that is one bit apart in a segment, only the side
with the bit set looks up, so it meets once.

Exact copies are one fingerprint from the start. Under most keys a join lists
the verified pairs; under one with over ``FEW`` members, and eight times as
many as an even spread would give it, links are reduced to a spanning forest at once, so a large group of near copies gives as
many links as members, not as pairs. A key with more members than ``BLOCK`` is
dealt out in blocks that also hold the key's first ``LEADERS`` members. Links
missed between blocks are found in a second pass: only members outside the
key's largest component so far meet all others, block by block; a key whose
members are already one component is done.

Defined results: texts null, empty or white have fingerprint 0 and link like any other;
repeated rows come out each; documents without a doc_id take part, and a component of these alone has a null id; extra
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from gradeweave.llm.common import fresh
from gradeweave.operators.components import components
from gradeweave.session import materialize

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: (lowest bit, width) of each segment. With three, four differing bits leave one segment at most one bit apart.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
FEW, BLOCK, LEADERS = 64, 4096, 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of all shingles of ``text``."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    begins = [0, *(ends + 1).tolist()][:n]
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)]
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):  # a very long text, part by part
        part = np.array(hashed[k:k + 65_536], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t.as_py() or "") for t in texts], np.uint64)
    return pa.array(found.view(np.int64))


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, _fingerprints("text"))


def _linked(fp: np.ndarray, others: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ others[None, :]) <= max_bits


def _forest(fp: np.ndarray, max_bits: int, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Places of the links of a spanning forest over ``fp``; members with equal ``root`` count as linked already."""
    root = np.arange(len(fp)) if root is None else np.unique(root, return_inverse=True)[1]
    links = []
    for begin in range(0, len(fp), 256):
        near = _linked(fp[begin:begin + 256], fp, max_bits) & (root[begin:begin + 256, None] != root[None, :])
        for i in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[i])
            others, first = np.unique(root[hits], return_index=True)
            mine = root[begin + i]
            links.extend((begin + i, hits[f]) for r, f in zip(others, first, strict=True) if r != mine)
            root[np.isin(root, others)] = mine
    return links


def _pairs(fp: np.ndarray, links: list[tuple[int, int]]) -> pd.DataFrame:
    a, b = np.array(links, np.int64).reshape(-1, 2).T if links else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})


def _homes(distinct: DataFrame) -> DataFrame:
    """fp, seg, key: a fingerprint's own key in each segment."""
    own = [
        F.struct(F.lit(seg).alias("seg"), F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1).alias("key"))
        for seg, (low, width) in enumerate(SEGMENTS)
    ]
    return distinct.select("fp", F.explode(F.array(*own)).alias("e")).select("fp", "e.*")


def _reached(rows: DataFrame) -> DataFrame:
    """``rows`` under their key, as home, and once more under every key that is one set bit lower."""
    key = F.col("key")
    lower = [
        F.struct(F.when(key.bitwiseAND(1 << bit) != 0, key.bitwiseXOR(F.lit(1 << bit))).alias("key"), F.lit(False).alias("home"))
        for bit in range(max(width for _, width in SEGMENTS))
    ]
    ball = F.array(F.struct(key.alias("key"), F.lit(True).alias("home")), *lower)
    return rows.withColumn("e", F.explode(ball)).drop("key").select("*", "e.*").drop("e").filter("key is not null")


def table_rows(distinct: DataFrame) -> DataFrame:
    """fp, seg, key, home: a fingerprint's own key in each segment, and keys one set bit lower."""
    return _reached(_homes(distinct))


def key_sizes(distinct: DataFrame) -> DataFrame:
    """seg, key, n, housed: how many rows of the table stand under a key, and whether any is at home. Fingerprints are
    counted by their own key before the balls are formed, so there are no more counts than keys."""
    own = _homes(distinct).groupBy("seg", "key").agg(F.count("*").alias("n"))
    return _reached(own).groupBy("seg", "key").agg(F.sum("n").alias("n"), F.max("home").alias("housed"))


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links whose components are those of all pairs at most ``max_bits`` apart. ``distinct`` has fp."""
    if max_bits // len(SEGMENTS) > 1:
        raise ValueError(f"{len(SEGMENTS)} segments with balls of one bit find up to {2 * len(SEGMENTS) - 1} bits")
    rows, keys = table_rows(distinct), ["seg", "key"]
    few = FEW + 8 * distinct.count() * max(w for _, w in SEGMENTS) // 2 ** min(w for _, w in SEGMENTS)
    crowded = materialize(key_sizes(distinct).filter((F.col("n") > few) & F.col("housed")).select(*keys, "n"), "simhash-crowded")
    alone = crowded.isEmpty()
    plain = rows if alone else rows.join(crowded, keys, "left_anti")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (
        plain.filter("home").select(*keys, F.col("fp").alias("a"))
        .join(plain.select(*keys, F.col("fp").alias("b"), "home"), keys)
        .filter((F.col("a") != F.col("b")) & (~F.col("home") | (F.col("a") < F.col("b"))) & (apart <= max_bits))
        .select("a", "b")
    )
    if alone:
        return pairs
    crowd = materialize(rows.join(crowded, keys), "simhash-crowds")
    middling, large = crowd.filter(F.col("n") <= BLOCK), crowd.filter(F.col("n") > BLOCK)

    def within(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy().view(np.uint64)
        return _pairs(fp, _forest(fp, max_bits))

    schema = "a bigint, b bigint"
    first = pairs.union(middling.select("seg", "key", "fp").groupBy("seg", "key").applyInPandas(within, schema))
    if large.isEmpty():
        return first
    mixed = F.xxhash64("fp")
    order = Window.partitionBy("seg", "key").orderBy(F.desc("home"), mixed)
    leaders = large.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEADERS)
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = large.withColumn("block", F.pmod(mixed, blocks)).select("seg", "key", "block", "fp")
    everywhere = leaders.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = dealt.unionByName(everywhere.select(dealt.columns)).distinct()
    links = materialize(first.union(met.groupBy("seg", "key", "block").applyInPandas(within, schema)), "simhash-links")
    return links.union(_between_blocks(large, links, max_bits))


def _between_blocks(large: DataFrame, links: DataFrame, max_bits: int) -> DataFrame:
    """Links between members of large keys that ``links`` leaves in different components."""
    roots = components(links)
    member = (
        large.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
        .select("seg", "key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    )
    parts = member.groupBy("seg", "key", "root").agg(F.count("*").alias("m"))
    biggest = parts.groupBy("seg", "key").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("c"))
    open_rows = materialize(member.join(biggest.filter("c > 1").drop("c"), ["seg", "key"]), "simhash-open")
    rest = open_rows.filter("root <> main")
    if rest.isEmpty():
        return links.limit(0)
    # Members outside the main component, in blocks, meet all members of the key, in blocks.
    mixed, half = F.xxhash64("fp"), BLOCK // 2
    rest_sizes = rest.groupBy("seg", "key").agg(F.ceil(F.count("*") / half).cast("long").alias("rest_blocks"))
    spread = open_rows.join(rest_sizes, ["seg", "key"]).withColumn("blocks", F.ceil(F.col("n") / half).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = (
        spread.filter("root <> main").withColumn("i", F.pmod(mixed, "rest_blocks")).withColumn("j", every(F.col("blocks")))
    )
    against = spread.withColumn("j", F.pmod(mixed, "blocks")).withColumn("i", every(F.col("rest_blocks")))
    keys = ["seg", "key", "i", "j"]

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([left, right]).drop_duplicates("fp")
        fp = both["fp"].to_numpy().view(np.uint64)
        return _pairs(fp, _forest(fp, max_bits, both["root"].to_numpy()))

    pick = [*keys, "fp", "root"]
    other = against.select(pick).toDF(*pick)  # columns of its own, as both sides come from one table
    return (
        asked.select(pick).groupBy(*keys).cogroup(other.groupBy(*keys))
        .applyInPandas(across, "a bigint, b bigint")
    )


def classes(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, component_id of every distinct fingerprint: the smallest doc_id reachable. ``fingerprints`` has doc_id, fp."""
    distinct = materialize(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed), component_id of every document."""
    marked = materialize(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "simhash-documents")
    return marked.join(classes(marked, max_bits).drop("root"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns; of repeated rows one."""
    digest = F.xxhash64("text")
    marked = materialize(
        with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp", digest.alias("digest")), "simhash-documents")
    first = (
        marked.join(classes(marked, max_bits).drop("component_id"), "fp").groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("k"))
    )
    names = [fresh(docs, n) for n in ("nameless", "filled", "digest", "place")]
    kept = first.select(
        F.col("k.nameless").alias(names[0]), F.coalesce("k.doc_id", F.lit(0)).alias(names[1]), F.col("k.digest").alias(names[2]))
    keyed = (
        docs.withColumn(names[0], F.col("doc_id").isNull()).withColumn(names[1], F.coalesce("doc_id", F.lit(0)))
        .withColumn(names[2], digest)
    )
    order = Window.partitionBy(*names[:3]).orderBy(F.lit(0))
    found = keyed.join(materialize(kept, "simhash-kept"), names[:3], "left_semi")
    return found.withColumn(names[3], F.row_number().over(order)).filter(F.col(names[3]) == 1).select(docs.columns)
