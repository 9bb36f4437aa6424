"""Fill-in-middle: every text cut in three and put together in another order, and taken apart again.

Where a text is cut and which form it gets follow from a digest of its doc_id, in built-in functions. The bytes are
moved a whole Arrow batch at a time. A scan over the batch finds the byte of every cut. Each piece then has one
displacement, the distance its bytes move; the changes of displacement go to a difference array, whose cumulative sum
says for every byte how far it moves, and one scatter writes all outputs. Restoring reads the places of the sentinels
in an output, builds the same kind of array and gathers.

Both go over a batch in windows of ``WINDOW`` bytes that carry the running sum, so besides the texts and their
outputs they take the same memory for a batch of short texts and for one very long text.

A sentinel has no proper prefix that is also its suffix, and texts that hold one stay plain; so in any other output the
sentinels are found where they were put.

Defined results: a null or empty text is plain and empty; a null doc_id counts as the empty numeral; repeated rows come
out each, alike; an empty table gives no rows; extra columns are kept, and the new one takes the name that is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes for which displacements are held at a time.
WINDOW = 1 << 17


@dataclass(frozen=True)
class Policy:
    """What the digest decides: percent of texts that stay plain, percent of the others with the suffix first."""

    seed: str = "1"
    plain: int = 10
    suffix_first: int = 20


def cuts(doc_id: Column, text: Column, policy: Policy = Policy()) -> Column:
    """Struct of n, form, and the two cuts low and high in code points."""
    digest = F.sha2(F.concat(F.lit(f"{policy.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    n = F.length(text).cast("long")
    one, two = number(0) % (n + 1), number(1) % (n + 1)
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (
        F.when((n == 0) | holds | (number(2) % 100 >= 100 - policy.plain), PLAIN)
        .when(number(3) % 100 < policy.suffix_first, SPM).otherwise(PSM)
    )
    return F.struct(n.alias("n"), form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))


def windows(length: int) -> Iterator[tuple[int, int]]:
    for begin in range(0, length, WINDOW):
        yield begin, min(begin + WINDOW, length)


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins and the last ends."""
    wide = strings.type in (pa.large_string(), pa.large_binary())
    buffers = strings.buffers()
    if len(strings) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    bounds = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    held = np.frombuffer(buffers[2], np.uint8)[bounds[0]:bounds[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return held, bounds - bounds[0]


def strings_of(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def byte_places(raw: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The byte at which the code point of each rank begins, counted over the whole batch; the end for a rank beyond."""
    order = np.argsort(ranks, kind="stable")
    wanted, found, seen, at = ranks[order], np.full(len(ranks), len(raw), np.int64), 0, 0
    for begin, end in windows(len(raw)):
        lead = np.flatnonzero((raw[begin:end] & 0xC0) != 0x80)
        upto = int(np.searchsorted(wanted, seen + len(lead)))
        found[order[at:upto]] = begin + lead[wanted[at:upto] - seen]
        seen, at = seen + len(lead), upto
    return found


def displaced(length: int, places: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each window of ``length`` bytes, where its bytes go: ``moves`` holds from each of the ascending ``places`` on."""
    steps, carried, at = np.diff(moves, prepend=0), 0, 0
    for begin, end in windows(length):
        upto = int(np.searchsorted(places, end))
        change = np.zeros(end - begin, np.int64)
        np.add.at(change, places[at:upto] - begin, steps[at:upto])
        change[0] += carried
        np.cumsum(change, out=change)
        carried, at = int(change[-1]), upto
        change += np.arange(begin, end)
        yield begin, end, change


def scattered(texts: pa.Array, forms: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The outputs of a batch of texts; ``n``, ``low`` and ``high`` count code points."""
    raw, bounds = bytes_of(texts)
    begin, end = bounds[:-1], bounds[1:]
    first = np.cumsum(n) - n
    one, two = (np.minimum(x, end) for x in np.split(byte_places(raw, np.concatenate([first + low, first + high])), 2))
    moved, spm = forms != PLAIN, forms == SPM
    sizes = end - begin + np.where(moved, 3 * SENTINEL, 0)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    start, head, tail = out_bounds[:-1], one - begin, end - two
    # Where prefix, middle and suffix begin in the output.
    to_prefix = start + np.where(moved, np.where(spm, 2 * SENTINEL + tail, SENTINEL), 0)
    to_suffix = start + np.where(moved, np.where(spm, SENTINEL, 2 * SENTINEL + head), two - begin)
    to_middle = start + np.where(moved, 3 * SENTINEL + head + tail, head)
    places = np.stack([begin, one, two], axis=1).ravel()
    moves = np.stack([to_prefix - begin, to_middle - one, to_suffix - two], axis=1).ravel()
    out = np.empty(int(out_bounds[-1]), np.uint8)
    for lo, hi, target in displaced(len(raw), places, moves):
        out[target] = raw[lo:hi]
    for name, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        for k, letter in enumerate(name.encode()):
            out[to[moved] - SENTINEL + k] = letter
    return strings_of(out, out_bounds)


def sentinels(raw: np.ndarray) -> np.ndarray:
    """Where sentinels begin in the bytes of a batch, also across the borders of its strings."""
    found = []
    for begin, end in windows(len(raw)):
        part = raw[begin:end + SENTINEL - 1]
        letters = np.isin(part[1:-1], np.frombuffer((PREFIX[1] + SUFFIX[1] + MIDDLE[1]).encode(), np.uint8))
        found.append(begin + np.flatnonzero((part[:-2] == ord("<")) & letters & (part[2:] == ord(">"))))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def gathered(outputs: pa.Array, forms: np.ndarray) -> pa.Array:
    """The texts that a batch of outputs was made of."""
    raw, bounds = bytes_of(outputs)
    begin, end = bounds[:-1], bounds[1:]
    marks = sentinels(raw)
    row = np.searchsorted(bounds, marks, side="right") - 1
    inside = marks + SENTINEL <= end[row]
    moved, spm = forms != PLAIN, forms == SPM
    marks, row = marks[inside & moved[row]], row[inside & moved[row]]
    if len(marks) != 3 * moved.sum() or (np.bincount(row, minlength=len(begin))[moved] != 3).any():
        raise ValueError("an output that is not plain must hold three sentinels")
    ones, twos, threes = marks.reshape(-1, 3).T
    wanted = np.where(spm[moved][:, None], np.frombuffer(b"SPM", np.uint8), np.frombuffer(b"PSM", np.uint8))
    if (raw[np.stack([ones, twos, threes], axis=1) + 1] != wanted).any() or (ones != begin[moved]).any():
        raise ValueError("the sentinels of an output do not stand in the order of its form")
    front, back, middle = begin.copy(), end.copy(), end.copy()  # where the three pieces of an output begin
    front[moved], back[moved], middle[moved] = ones + SENTINEL, twos + SENTINEL, threes + SENTINEL
    front_size, back_size = np.where(moved, back - SENTINEL - front, end - begin), np.where(moved, middle - SENTINEL - back, 0)
    prefix, suffix = np.where(spm, back, front), np.where(spm, front, back)
    head, tail = np.where(spm, back_size, front_size), np.where(spm, front_size, back_size)
    size = front_size + back_size + (end - middle)
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    start = out_bounds[:-1]
    places = np.stack([start, start + head, out_bounds[1:] - tail], axis=1).ravel()
    moves = np.stack([prefix, middle, suffix], axis=1).ravel() - places
    text = np.empty(int(out_bounds[-1]), np.uint8)
    for lo, hi, source in displaced(len(text), places, moves):
        text[lo:hi] = raw[source]
    return strings_of(text, out_bounds)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(StringType())
def _scatter(texts: pa.Array, forms: pa.Array, n: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    return scattered(texts, forms.to_numpy(zero_copy_only=False), _numbers(n), _numbers(low), _numbers(high))


@F.arrow_udf(StringType())
def _gather(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    return gathered(outputs, forms.to_numpy(zero_copy_only=False))


def fill_in_middle(docs: DataFrame, name: str = "fim", policy: Policy = Policy()) -> DataFrame:
    """``docs`` with a struct ``name`` of n, form, prefix_chars, middle_chars (null if plain) and output."""
    text = F.coalesce("text", F.lit(""))
    made = docs.withColumn(name, cuts(F.col("doc_id"), text, policy))
    c = F.col(name)
    output = _scatter.asNondeterministic()(text, c["form"], c["n"], c["low"], c["high"])  # so that it is computed once
    sized = lambda chars: F.when(c["form"] != PLAIN, chars)
    return made.withColumn(name, F.struct(
        c["n"].alias("n"), c["form"].alias("form"), sized(c["low"]).alias("prefix_chars"),
        sized(c["high"] - c["low"]).alias("middle_chars"), output.alias("output"),
    ))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    return _gather(output, form)
