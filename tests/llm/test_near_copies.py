"""SimHash near-dedup, line dedup and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from gradeweave.llm import line_dedup, simhash
from gradeweave.operators import components as comp

LONG = " ".join(f"w{i % 977}" for i in range(90_000))


def spelt_out(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closest(fps, max_bits=4):
    """Smallest place reachable, for each fingerprint."""
    root = list(range(len(fps)))
    for _ in fps:
        before = list(root)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= max_bits:
                    root[i] = min(root[i], root[j])
        if before == root:
            return root
    return root


def test_fingerprints():
    for text in ("", " \n\t", "One", "one TWO three", "a b c d e f", "Ünï Çödé x y z", "a a a a a a", "x\xa0y z w q r"):
        assert simhash.fingerprint(text) == spelt_out(text), text
    assert simhash.fingerprint(LONG) == spelt_out(LONG)


def flipped(base, bits):
    for b in bits:
        base ^= 1 << b
    return base


@pytest.mark.parametrize("few,block", [(64, 4096), (2, 4096), (2, 8)])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, few, block):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {flipped(c, rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)}
    fps |= {0, (1 << 64) - 1, 0b1111, 0b11111}
    fps |= {flipped(centres[0], rng.sample(range(30), rng.randint(1, 6))) for _ in range(30)}  # one segment alike
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.u: r.root for r in comp.components(simhash.near_links(df)).collect()}
    groups, want = {}, {}
    for i, r in enumerate(closest(fps)):
        want.setdefault(r, set()).add(signed[i])
    for s in signed:
        groups.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_documents_nulls_repeats_and_extra_columns(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word7 ", "other ", 1)
    docs = docs_of([(5, base), (3, near), (9, base), (9, base), (4, None), (7, ""), (8, "  "), (None, base), (11, "alone here")], extra="fp")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 9
    # The same rule spelt out over all pairs.
    fps = [spelt_out(t) for t in (base, near, base, base, None, "", "  ", base, "alone here")]
    ids = [5, 3, 9, 9, 4, 7, 8, None, 11]
    root = closest(fps)
    want = sorted(str((i, min((ids[k] for k in range(9) if root[k] == root[j] and ids[k] is not None), default=None))) for j, i in enumerate(ids))
    assert sorted(str((r.doc_id, r.component_id)) for r in rows) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(ids[k] for k in range(9) if root[k] == r and ids[k] is not None) for r in root})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_only_nameless_documents_leave_one(docs_of):
    assert simhash.one_of_each(docs_of([(None, "same text here"), (None, "same text here")])).count() == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    found = {r.u: r.root for r in comp.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


KEY = "A line that several documents share"


def cleaned(index, docs):
    return {(r.doc_id, r.cleaned.kept, r.cleaned.n_lines, r.cleaned.n_dropped) for r in index.clean(docs).collect()}


def test_lines_are_dropped_but_for_the_largest_document(docs_of):
    docs = docs_of([
        (1, f"  {KEY.upper()}\t\nown line of the first document\n{KEY}"), (2, f"{KEY}\nshort"), (3, f"x\n{KEY}\ny\n{KEY} "),
        (4, "short"), (6, None), (7, ""), (8, "own line of the first document"), (None, KEY), (2, KEY),
        (9, "é" * 19 + "\n" + "é" * 20), (10, "é" * 20), (11, "É" * 20), (12, "é" * 20),
    ], extra="cleaned2")
    got = cleaned(line_dedup.LineIndex.build(docs), docs)
    assert got == {
        (1, "own line of the first document", 3, 2), (2, "short", 2, 1), (3, f"x\n{KEY}\ny\n{KEY} ", 4, 0), (4, "short", 1, 0),
        (6, "", 1, 0), (7, "", 1, 0), (8, "own line of the first document", 1, 0), (None, KEY, 1, 0), (2, "", 1, 1),
        (9, "é" * 19, 2, 1), (10, "", 1, 1), (11, "É" * 20, 1, 0), (12, "é" * 20, 1, 0),
    }
    again = line_dedup.clean_documents(docs)
    assert again.columns == docs.columns and {r.n_chars == len(r.text) for r in again.collect()} == {True}
    assert line_dedup.clean_documents(docs.limit(0)).count() == 0


def filter_state(index):
    return {r.shard: sorted(np.frombuffer(r.cells, np.uint16).tolist() + list(r.stash)) for r in index.filters.collect()}


def test_deleting_what_was_inserted_restores_the_index(docs_of):
    rng = random.Random(3)
    lines = [f"line number {i} that is long enough" for i in range(40)]
    texts = [(d, "\n".join(rng.sample(lines, 6))) for d in range(30)]
    first, more = docs_of(texts[:20]), docs_of(texts[20:])
    index = line_dedup.LineIndex.build(first)
    grown = index.insert(more)
    assert cleaned(grown, docs_of(texts)) == cleaned(line_dedup.LineIndex.build(docs_of(texts)), docs_of(texts))
    assert sorted(grown.insert(more).counts.collect()) == sorted(grown.counts.collect())
    back = grown.delete(more)
    assert sorted(back.counts.collect()) == sorted(index.counts.collect())
    assert cleaned(back, first) == cleaned(index, first)
    assert filter_state(back) == filter_state(index)
    # Without the largest holder, the next largest keeps the line.
    shared = docs_of([(i, KEY) for i in range(4)])
    lost = line_dedup.LineIndex.build(shared).delete(docs_of([(3, "")]))
    assert {r[0] for r in cleaned(lost, shared) if r[1]} == {2}


@pytest.mark.parametrize("shard_keys", [50_000, 40])
def test_filters_grow_with_their_keys_and_shrink_again(docs_of, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    lines = [f"line number {i} that is long enough" for i in range(3_000)]
    few = docs_of([(d, "\n".join(lines[:5])) for d in range(3)])
    many = docs_of([(10 + d, "\n".join(lines)) for d in range(3)])
    index = line_dedup.LineIndex.build(few)
    grown = index.insert(many)
    state = grown.filters.collect()
    assert sum(len(r.stash) for r in state) < 30 and sum(len(r.cells) for r in state) < 2 * 16 * 3_000
    assert (grown.shards == 1) == (shard_keys > 3_000)
    again = line_dedup.LineIndex.build(few.union(many))
    assert cleaned(grown, few.union(many)) == cleaned(again, few.union(many))
    back = grown.delete(many)
    assert cleaned(back, few) == cleaned(index, few) and back.shards == index.shards
    assert sum(len(r.cells) for r in back.filters.collect()) <= 4 * sum(len(r.cells) for r in index.filters.collect())
    assert cleaned(back.insert(many), few.union(many)) == cleaned(again, few.union(many))


def test_cuckoo_filter_holds_all_even_when_overfull():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    f = line_dedup.CuckooFilter.sized(40)
    for h in hashes.tolist():
        f.add(h)
    assert f.holds(hashes).all() and f.stash
    for h in hashes.tolist():
        f.remove(h)
    assert not f.table.any() and not f.stash and not f.holds(hashes).any()
