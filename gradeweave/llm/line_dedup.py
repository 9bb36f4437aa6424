"""Reversible line dedup: cuckoo filters by shard, backed by exact reference counts.

The index knows which document holds which line key (``refs``), how many documents hold a key and the
largest of them (``counts``), and, per shard of keys, a cuckoo filter of the
keys that enough documents hold (``filters``). Inserting and deleting documents
move the counts; keys that cross the limit enter or leave the filters. So
deleting what was inserted gives the answers of the index before it.

Filters follow their keys in size. A shard whose filter gets fuller than ``FULLEST``, or emptier than ``EMPTIEST``, is
built anew from the counts, which are exact; and where all shards hold twice the keys they are meant for on average, or
an eighth, all are built anew as more or fewer shards. The other shards only take up what changed.

Cleaning asks the filters first and the counts only for keys that pass, so a
false positive of a filter costs a lookup and never a line. Line and filter
meet in groups of (shard, salt), the salt taken from the document, so a line
that a third of all documents hold is spread out.

A key is a line without white space at both ends, A-Z in lower case; keys
under 20 code points take no part. Keys stand as digests of 128 bits.

Defined results: a null or empty text is one empty line; documents with one
doc_id count as one document, and each of the rows is cleaned; a row without
doc_id counts as no document and stays whole; a line repeated within a document counts once; extra columns are kept by
``clean_documents``; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from gradeweave.llm.common import fresh
from gradeweave.session import materialize

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys per filter, and lines per group that meets a filter, on average.
SHARD_KEYS, GROUP_LINES = 50_000, 200_000
SLOTS, KICKS = 4, 200
#: Share of a filter's cells that may be taken, and that must be unless it has the smallest size.
FULLEST, EMPTIEST, LEAST_BUCKETS = 0.85, 0.05, 16
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """Digest of a line's key, none for short ones."""
    key = line.strip(WHITE).lower()
    if len(key) < MIN_CHARS or len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def text_keys(text: str | None) -> set[bytes]:
    return {k for line in (text or "").encode().split(b"\n") if (k := line_key(line))}


@F.arrow_udf(ArrayType(BinaryType()))
def _keys(texts: pa.Array) -> pa.Array:
    return pa.array([list(text_keys(t.as_py())) for t in texts], pa.list_(pa.binary()))


def line_refs(docs: DataFrame) -> DataFrame:
    """doc_id, key of every line key of every document, perhaps with repeats."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.explode(_keys("text")).alias("key"))


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four; what finds no place goes to a small stash, so nothing is lost."""

    def __init__(self, table: np.ndarray, stash: list[int]):
        self.table, self.stash = table, stash
        self.mask = len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = max(LEAST_BUCKETS, 1 << max(0, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.7))))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), [])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.int64)
        one = (hashes & np.uint64(self.mask)).astype(np.int64)
        return print_, one, one ^ self.jump(print_)

    def jump(self, print_):
        return (print_ * 0x5BD1E995 >> 7) & self.mask

    def _packed(self, print_: int, place: int) -> int:
        return print_ << 32 | min(place, int(place ^ self.jump(print_)))

    def add(self, hashed: int) -> None:
        print_, one, two = (int(x[0]) for x in self.places(np.array([hashed], np.uint64)))
        place = one
        for place in (one, two):
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = print_
                return
        for kick in range(KICKS):
            slot = (kick * 7 + place) % SLOTS
            print_, self.table[place, slot] = int(self.table[place, slot]), print_
            place = int(place ^ self.jump(print_))
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = print_
                return
        self.stash.append(self._packed(print_, place))

    def remove(self, hashed: int) -> None:
        """Take out a key that was added."""
        print_, one, two = (int(x[0]) for x in self.places(np.array([hashed], np.uint64)))
        for place in (one, two):
            if (found := np.flatnonzero(self.table[place] == print_)).size:
                self.table[place, found[0]] = 0
                return
        self.stash.remove(self._packed(print_, one))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(hashes)
        wanted = print_[:, None]
        found = (self.table[one] == wanted).any(axis=1) | (self.table[two] == wanted).any(axis=1)
        if self.stash:
            found |= np.isin(print_ << 32 | np.minimum(one, two), self.stash)
        return found


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(k)[:8] for k in keys), "<u8")


def _read_filter(rows: pd.DataFrame) -> CuckooFilter | None:
    if rows.empty:
        return None
    row = rows.iloc[0]
    return CuckooFilter(np.frombuffer(row["cells"], np.uint16).reshape(-1, SLOTS).copy(), [int(x) for x in row["stash"]])


def _updated(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys came and went."""
    shard = int((held if len(held) else changes)["shard"].iloc[0])
    now = _read_filter(held) or CuckooFilter.sized(2 * int(changes["added"].sum()))
    for added, step in ((False, now.remove), (True, now.add)):
        for hashed in _hashes(changes.loc[changes["added"] == added, "key"]).tolist():
            step(hashed)
    return pd.DataFrame({"shard": [shard], "cells": [now.table.tobytes()], "stash": [now.stash]})


FILTER_SCHEMA = "shard long, cells binary, stash array<long>"


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; inserting and deleting give another one."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame) -> LineIndex:
        refs = materialize(line_refs(docs).distinct(), "line-refs")
        counts = materialize(_counted(refs), "line-counts")
        return cls._anew(refs, counts, _common(counts).count())

    @classmethod
    def _anew(cls, refs: DataFrame, counts: DataFrame, common: int) -> LineIndex:
        """Index with filters built from the counts, of which ``common`` are of keys that enough documents hold."""
        shards = max(1, -(-common // SHARD_KEYS))
        empty = refs.sparkSession.createDataFrame([], FILTER_SCHEMA)
        added = _common(counts).select("key", F.lit(True).alias("added"))
        return cls(refs, counts, _moved(empty, _dealt(added, shards)), shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents. What it knows of them already changes nothing."""
        new = materialize(line_refs(docs).distinct().join(self.refs, ["key", "doc_id"], "left_anti").select("doc_id", "key"), "line-refs")
        both = self.counts.union(_counted(new)).groupBy("key")
        counts = materialize(both.agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc")), "line-counts")
        return self._next(self.refs.union(new), counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose doc_id is in ``doc_ids``."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        touched = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        refs = materialize(self.refs.join(gone, "doc_id", "left_anti"), "line-refs")
        again = _counted(refs.join(touched, "key", "left_semi"))
        counts = materialize(self.counts.join(touched, "key", "left_anti").union(again), "line-counts")
        return self._next(refs, counts)

    def _next(self, refs: DataFrame, counts: DataFrame) -> LineIndex:
        keys = _dealt(_common(counts).select("key"), self.shards)
        sizes = materialize(keys.groupBy("shard").agg(F.count("*").alias("n")), "line-shards")
        common = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        if common > 2 * SHARD_KEYS * self.shards or 8 * common < SHARD_KEYS * self.shards and self.shards > 1:
            return self._anew(refs, counts, common)
        before, after = _common(self.counts).select("key"), _common(counts).select("key")
        changes = (
            after.join(before, "key", "left_anti").withColumn("added", F.lit(True))
            .union(before.join(after, "key", "left_anti").withColumn("added", F.lit(False)))
        )
        cells, share = F.length("cells") / 2, F.coalesce("n", F.lit(0)) * 2 / F.length("cells")
        unfit = self.filters.join(sizes, "shard", "left").filter(
            (share > FULLEST) | (share < EMPTIEST) & (cells > LEAST_BUCKETS * SLOTS)).select("shard")
        unfit = materialize(unfit, "line-unfit")  # at most one row for each shard, some bytes
        again = keys.join(F.broadcast(unfit), "shard", "left_semi").select("shard", "key", F.lit(True).alias("added"))
        rest = _dealt(changes, self.shards).join(F.broadcast(unfit), "shard", "left_anti").select("shard", "key", "added")
        held = self.filters.join(F.broadcast(unfit), "shard", "left_anti")
        return LineIndex(refs, counts, _moved(held, rest.union(again)), self.shards)

    def drops(self, docs: DataFrame) -> DataFrame:
        """doc_id, keys whose lines the document loses."""
        lines = self.counts.agg(F.sum("n_docs")).first()[0] or 0
        salts = max(1, -(-int(lines) // (self.shards * GROUP_LINES)))
        held = line_refs(docs).withColumn("shard", _shard(self.shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        spread = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

        def passed(lines: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            asked = _read_filter(filters)
            found = lines.iloc[:0] if asked is None or lines.empty else lines[asked.holds(_hashes(lines["key"]))]
            return found[["doc_id", "key"]]

        maybe = held.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(passed, "doc_id long, key binary")
        sure = maybe.join(_common(self.counts), "key").filter("doc_id <> last_doc")
        return sure.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # at most the lines of a document

    def clean(self, docs: DataFrame, name: str = "cleaned") -> DataFrame:
        """``docs`` with a struct ``name`` of kept, n_lines and n_dropped."""
        key, keys = fresh(docs, "drop_doc_id"), fresh(docs, "drop_keys")
        table = self.drops(docs).select(F.col("doc_id").alias(key), F.col("keys").alias(keys))
        joined = docs.join(table, docs["doc_id"] == F.col(key), "left")
        return joined.withColumn(name, _cleaned()("text", keys)).drop(key, keys)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _common(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("n_docs") >= MIN_DOCS)


def _dealt(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", _shard(shards))


def _moved(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Filters after the ``changes``: shard, key, and whether it was added."""
    return materialize(
        filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_updated, FILTER_SCHEMA), "line-filters")


def _cleaned():
    @F.arrow_udf("struct<kept:string,n_lines:bigint,n_dropped:bigint>")
    def cleaned(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for text, keys in zip(texts, drops, strict=True):
            text, gone = text.as_py() or "", set(keys.as_py() or ())
            lines = text.encode().split(b"\n")
            stay = [x for x in lines if line_key(x) not in gone] if gone else lines
            kept.append(b"\n".join(stay).decode() if gone else text)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
        fields = [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.StructArray.from_arrays(fields, ["kept", "n_lines", "n_dropped"])

    return cleaned


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without lines that occur in other documents, with n_chars to match."""
    name = fresh(docs, "cleaned")
    cleaned = LineIndex.build(docs).clean(docs, name)
    with_text = cleaned.withColumn("text", F.col(name)["kept"])
    if "n_chars" in docs.columns:
        with_text = with_text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return with_text.select(docs.columns)
