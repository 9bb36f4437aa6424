"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are compiled, with their token ids, into a
minimal acyclic automaton: states that accept the same endings are shared, and
each transition carries the number of words that sort before it, so walking a
word adds up to its rank, which points at its ids. The compiled bytes go to
the executors in a broadcast bounded by ``lexicon_words`` (words of at most
``LEXICON_BYTES`` bytes); each worker writes them to an unnamed file and maps
it into memory. Words that the lexicon lacks are merged exactly.

Rules of the tokenizer file that are served: NFC, white space and lower-case
normalisers, a splitting pattern whose matches are kept, byte-level alphabet,
merges by rank with a word-end suffix, and added tokens found in the raw text.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; extra columns are dropped.
"""

from __future__ import annotations

import json
import mmap
import struct
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.session import materialize

LEXICON_WORDS, LEXICON_BYTES = 100_000, 48
BYTES = tuple(bytes([b]) for b in range(256))
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
#: A merge is one number: its rank above, the id it makes below.
ID_BITS = 24
ID_MASK, NO_MERGE = (1 << ID_BITS) - 1, 1 << 60
NO_ID = ID_MASK
#: Bytes of the words that are merged together, and how many of these at a time.
MERGED_TOGETHER, WORDS_TOGETHER = 64, 4_096
#: Chunks that a worker remembers, and that a counting task holds before it passes them on.
REMEMBERED, COUNTED = 200_000, 200_000
#: Documents that are encoded at a time, and bytes of their texts, but for a single longer one.
SLICE, SLICE_BYTES = 128, 1 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others
    follow from code point 256 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class WordBPE:
    """What a tokenizer file says: splitting, ranks of merges, ids and tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {
            (self.vocab[a], self.vocab[b]): rank << ID_BITS | self.vocab[a + b]
            for rank, (a, b) in enumerate(merges)
        }
        self.pair_keys = np.array(sorted(a << ID_BITS | b for a, b in self.merges) or [-1], np.int64)
        self.pair_rules = np.array([self.merges.get((k >> ID_BITS, k & ID_MASK), NO_MERGE) for k in self.pair_keys.tolist()], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.plain_added = all(t.startswith("<|") for t in self.added)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0)
        self.byte_ids = [self.vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.end_ids = [self.vocab[c + self.suffix] for _, c in sorted(byte_alphabet().items())]
        if spec["decoder"] is not None:
            raise ValueError("tokens are joined by one space, as files without a decoder say")
        self.tokens = [""] * (1 + max(chain(self.vocab.values(), self.added.values()), default=-1))
        for token, i in chain(self.vocab.items(), self.added.items()):
            self.tokens[i] = token
        self.numerals = [*map(str, range(len(self.tokens)))]

    def normalize(self, text: str) -> str:
        # Letter by letter, as the file's normaliser does: without the final form of sigma that str.lower() picks.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def stretches(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Chunks between white space of each stretch between added tokens, and the added token behind it. No match of
        the pattern crosses white space, so chunks can be split into words one by one."""
        place = 0
        for found in self.split_added.finditer(text) if "<|" in text or not self.plain_added else ():
            yield self.chunks(self.normalize(text[place:found.start()])), found.group()
            place = found.end()
        yield self.chunks(self.normalize(text[place:] if place else text)), None

    def chunks(self, text: str) -> list[str]:
        # str.split() also splits at these four, which the pattern takes for symbols.
        return text.split() if SEPARATORS.isdisjoint(text) else regex.split(r"\s+", text)

    def words(self, chunk: str) -> list[str]:
        return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)  # letters alone are one word

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: their tokens, joined by one space as the file has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge of each pair of ids, NO_MERGE for those that have none."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rules[at], NO_MERGE)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word: the pair of the lowest rank is merged, leftmost first, until none is left. Words of
        like length are merged together, a merge of each at a time."""
        raws = [w.encode() for w in words]
        out = [b""] * len(raws)
        order = sorted(range(len(raws)), key=lambda i: len(raws[i]))
        short = [i for i in order if len(raws[i]) <= MERGED_TOGETHER]
        for begin in range(0, len(short), WORDS_TOGETHER):
            some = short[begin:begin + WORDS_TOGETHER]
            for i, ids in zip(some, self._merge_block([raws[i] for i in some]), strict=True):
                out[i] = ids
        for i in order[len(short):]:
            ids = [*map(self.byte_ids.__getitem__, raws[i])]
            ids[-1] = self.end_ids[raws[i][-1]]
            out[i] = array("I", self._merge_long(ids)).tobytes()
        return out

    def _merge_block(self, raws: list[bytes]) -> list[bytes]:
        lengths = np.array([*map(len, raws)])
        width, rows = int(lengths.max()), np.arange(len(raws))
        letters = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(len(raws), width)
        # One more column than there are letters, so that every place has one behind it; NO_ID pads the rows.
        ids = np.full((len(raws), width + 1), NO_ID, np.int64)
        ids[:, :width] = np.where(np.arange(width) < lengths[:, None], np.array(self.byte_ids)[letters], NO_ID)
        ids[rows, lengths - 1] = np.array(self.end_ids)[letters[rows, lengths - 1]]
        found = self.rules(ids[:, :-1], ids[:, 1:])
        out, names = [b""] * len(raws), rows
        while len(names):
            at = found.argmin(axis=1)  # the first of equal ranks
            least = found[np.arange(len(names)), at]
            live = least < NO_MERGE
            done = ids[~live]
            packed, ends = done[done != NO_ID].astype(np.uint32).tobytes(), np.cumsum((done != NO_ID).sum(axis=1)) * 4
            for name, first, end in zip(names[~live].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                out[name] = packed[first:end]
            names, ids, found, at, least = names[live], ids[live], found[live], at[live], least[live]
            if not len(names):
                break
            row, n = np.arange(len(names)), ids.shape[1]
            ids[row, at] = least & ID_MASK
            stay, open_ = np.ones(ids.shape, bool), np.ones(found.shape, bool)
            stay[row, at + 1], open_[row, at] = False, False
            ids, found = ids[stay].reshape(len(names), n - 1), found[open_].reshape(len(names), n - 2)
            behind = at < n - 2
            found[row[behind], at[behind]] = self.rules(ids[row, at], ids[row, np.minimum(at + 1, n - 2)])[behind]
            before = at > 0
            found[row[before], at[before] - 1] = self.rules(ids[row, np.maximum(at - 1, 0)], ids[row, at])[before]
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same for one word, with a heap over linked places, for words of any length."""
        from heapq import heapify, heappop, heappush

        n, rules = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rules]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = rules[pair] & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (p := (ids[left], ids[after[left]])) in rules:
                    heappush(heap, (rules[p], left, p))
        return tuple(i for i in ids if i >= 0)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """The automaton over the words, and their ids, as bytes.

    Words are added in order. Once the next word leaves a path, the states
    behind the fork are final, and each is replaced by an equal earlier one.
    """
    nodes: list[dict[int, int]] = [{}]
    accepting: list[bool] = [False]
    known: dict[tuple, int] = {}

    def freeze(path: list[int], labels: list[int], keep: int) -> None:
        while len(path) - 1 > keep:
            node = path.pop()
            label = labels.pop()
            signature = (accepting[node], tuple(nodes[node].items()))
            nodes[path[-1]][label] = known.setdefault(signature, node)

    path, labels = [0], []
    for word in sorted(entries):
        shared = 0
        while shared < min(len(labels), len(word)) and labels[shared] == word[shared]:
            shared += 1
        freeze(path, labels, shared)
        for b in word[shared:]:
            nodes.append({})
            accepting.append(False)
            nodes[path[-1]][b] = len(nodes) - 1
            path.append(len(nodes) - 1)
            labels.append(b)
        accepting[path[-1]] = True
    freeze(path, labels, 0)

    reached: dict[int, int] = {}
    order: list[int] = []

    def number(root: int) -> None:
        """Words below each state, children first, without recursion."""
        stack = [(root, False)]
        while stack:
            node, ready = stack.pop()
            if node in reached:
                continue
            if ready:
                reached[node] = accepting[node] + sum(reached[t] for t in nodes[node].values())
                order.append(node)
            else:
                stack.append((node, True))
                stack.extend((t, False) for t in nodes[node].values())

    number(0)
    place = {node: k for k, node in enumerate(reversed(order))}  # the root comes first
    first, target, skipped, label_bytes = [0], [], [], bytearray()
    for node in reversed(order):
        before = int(accepting[node])
        for label, t in sorted(nodes[node].items()):
            label_bytes.append(label)
            target.append(place[t])
            skipped.append(before)
            before += reached[t]
        first.append(len(target))
    ids, starts = [], [0]
    for word in sorted(entries):
        ids.extend(entries[word])
        starts.append(len(ids))
    final = [int(accepting[node]) for node in reversed(order)]
    parts = [first, target, skipped, final, starts, ids]
    labels_first = bytes(label_bytes) + bytes(-len(label_bytes) % 4)  # so that a label's place is its transition's number
    return labels_first + b"".join(array("I", p).tobytes() for p in parts) + struct.pack("<7I", len(labels_first), *map(len, parts))


class Lexicon:
    """A compiled lexicon, mapped into memory from an unnamed file."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        place, *sizes = struct.unpack("<7I", self.map[-28:])
        words, views = memoryview(self.map), []
        for n in sizes:
            views.append(words[place:place + 4 * n].cast("I"))
            place += 4 * n
        self.first, self.target, self.skipped, self.final, self.starts, self.ids = views

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word, packed, if it is in the lexicon."""
        state, rank = 0, 0
        find, first, target, skipped = self.map.find, self.first, self.target, self.skipped
        for label in word:
            at = find(BYTES[label], first[state], first[state + 1])
            if at < 0:
                return None
            rank += skipped[at]
            state = target[at]
        return self.ids[self.starts[rank]:self.starts[rank + 1]].tobytes() if self.final[state] else None


class Encoder:
    """Texts to ids: chunks that were met are remembered; the words of others come from the lexicon or are merged, those of
    all texts that are given at once together."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Remember the packed ids of ``chunks``."""
        known, older, split, words = self.known, self.older, {}, set()
        for chunk in chunks:
            ids = older.get(chunk)
            if ids is not None:
                known[chunk] = ids
            elif chunk.isalpha():  # letters alone are one word
                words.add(chunk)
            else:
                split[chunk] = self.bpe.words(chunk)
        ids_of, unseen = {}, []
        for word in words.union(*split.values()):
            ids = self.lexicon.get(word.encode())
            if ids is None:
                unseen.append(word)
            else:
                ids_of[word] = ids
        ids_of.update(zip(unseen, self.bpe.merge_all(unseen), strict=True))
        for chunk in words:
            known[chunk] = ids_of[chunk]
        for chunk, parts in split.items():
            known[chunk] = b"".join(map(ids_of.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. They are kept packed until here: millions of small tuples would burden the collector."""
        if len(self.known) > REMEMBERED:  # of two generations the older one goes
            self.known, self.older = {}, self.known
        parts = [[*self.bpe.stretches(text)] for text in texts]
        new = set().union(*(chunks for part in parts for chunks, _ in part)).difference(self.known)
        self.learn(new)
        out = []
        for part in parts:
            packed = []
            for chunks, added in part:
                packed.extend(map(self.known.__getitem__, chunks))
                if added is not None:
                    packed.append(array("I", [self.bpe.added[added]]).tobytes())
            out.append(np.frombuffer(b"".join(packed), np.uint32).astype(np.int32))
        for chunk in new:
            if len(chunk) > LEXICON_BYTES:
                del self.known[chunk]
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, name: str, compiled) -> Encoder:
    """The worker's encoder for one lexicon; an earlier one is let go."""
    if (path, name) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, name] = Encoder(word_bpe(path), Lexicon(compiled.value))
    return _ENCODERS[path, name]


def frequent_words(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of the whole corpus, at most ``limit`` of them: all whose count reaches one bound."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = word_bpe(path), Counter()

        def passed_on() -> pa.RecordBatch:
            found = Counter()
            for chunk, n in seen.items():
                for word in bpe.words(chunk):
                    found[word] += n
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for chunks, _ in bpe.stretches(text.as_py() or ""):
                    seen.update(chunks)
                if len(seen) > COUNTED:
                    yield passed_on()
                    seen = Counter()
        yield passed_on()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    short = counted.filter(F.octet_length("word") <= LEXICON_BYTES)
    cell = F.floor(F.log2(F.col("n").cast("double")) * 16)
    totals = materialize(short.groupBy("word").agg(F.sum("n").alias("n")).withColumn("cell", cell), "word-counts")
    # The lowest count that leaves at most ``limit`` words; there are at most 16 cells for each doubling of a count.
    least, above = None, 0
    for row in sorted(totals.groupBy("cell").count().collect(), reverse=True):
        above += row["count"]
        if above > limit:
            break
        least = row["cell"]
    return [] if least is None else [r["word"] for r in totals.filter(F.col("cell") >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of a corpus."""
    bpe = word_bpe(path)
    words = frequent_words(docs, path, limit)
    return compile_lexicon({w.encode(): memoryview(ids).cast("I") for w, ids in zip(words, bpe.merge_all(words), strict=True)})


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of doc_id and text, cut up to the bounds of a slice."""
    begin, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
        if at > begin and (at - begin == SLICE or held + size > SLICE_BYTES):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    if begin < len(batch):
        yield batch.slice(begin)


def _encoding(docs: DataFrame, path: str, lexicon: bytes, fields: dict[str, Callable], schema: str) -> DataFrame:
    """doc_id and, per document, what ``fields`` make of its ids, in one pass over the texts."""
    spark: SparkSession = docs.sparkSession
    compiled, name = spark.sparkContext.broadcast(lexicon), f"{len(lexicon)}-{hash(lexicon)}"

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, name, compiled)
        for batch in batches:
            for part in _slices(batch):
                rows = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                made = [f(encoder.bpe, rows) for f in fields.values()]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", *fields])

    named = docs.select(F.col("doc_id").cast("long"), "text")
    return named.mapInArrow(encoded, f"doc_id long, {schema}")


def _as_lists(_: WordBPE, rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _as_numerals(bpe: WordBPE, rows: list[np.ndarray]) -> pa.Array:
    return pa.array([" ".join(map(bpe.numerals.__getitem__, r.tolist())) for r in rows], pa.string())


def _as_text(bpe: WordBPE, rows: list[np.ndarray]) -> pa.Array:
    return pa.array([bpe.decode(r.tolist()) for r in rows], pa.string())


def encode(docs: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """doc_id and ids of every document. ``path`` is the tokenizer file, present on every executor."""
    return _encoding(docs, path, lexicon, {"ids": _as_lists}, "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids."""

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows = [np.array(r.as_py() or [], np.int32) for r in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _as_text(bpe, rows)], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, lexicon: bytes) -> DataFrame:
    """doc_id, numerals (the ids in decimal, joined by one space), n_tokens, and the text that the ids decode to."""
    fields = {
        "numerals": _as_numerals, "n_tokens": lambda _, rows: pa.array([*map(len, rows)], pa.int64()), "decoded": _as_text,
    }
    return _encoding(docs, path, lexicon, fields, "numerals string, n_tokens long, decoded string")
