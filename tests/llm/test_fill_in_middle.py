"""Fill-in-middle against slicing, and back."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeweave.llm import fill_in_middle as fim


def spelt_out(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)], len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("window", [3, 7, 1 << 20])
def test_bytes_move_as_slices_do(monkeypatch, window):
    monkeypatch.setattr(fim, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(150):
        texts = ["".join(rng.choice("a<>é日😀PSM") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        marked = [not t or any(x in t for x in ("<P>", "<S>", "<M>")) for t in texts]
        forms = np.array(["plain" if bad else rng.choice(["plain", "psm", "spm"]) for bad in marked], object)
        n = np.array([len(t) for t in texts], np.int64)
        low, high = np.sort(np.array([[rng.randint(0, len(t)), rng.randint(0, len(t))] for t in texts], np.int64).reshape(-1, 2), axis=1).T
        given = pa.array(["before", *texts], pa.string())[1:]
        out = fim.scattered(given, forms, n, low, high).to_pylist()
        for t, form, a, b, o in zip(texts, forms, low, high, out, strict=True):
            p, m, s = t[:a], t[a:b], t[b:]
            assert o == {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert fim.gathered(pa.array(out, pa.string()), forms).to_pylist() == texts


def test_outputs_that_were_not_made_so_are_an_error():
    for output, form in (("abc", "psm"), ("<P>a<M>b<S>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<S>c<M>", "psm")):
        with pytest.raises(ValueError):
            fim.gathered(pa.array([output, "plain <P>"]), np.array([form, "plain"], object))


def test_documents(docs_of):
    texts = [(i, f"text {i} é日😀\n") for i in range(200)] + [
        (1000, None), (1001, ""), (1002, "holds <M> inside"), (1003, "<S><P><M>"), (1004, "a"), (1005, "long ü " * 300_000),
        (None, "without a name"), (7, "text 7 é日😀\n"), (1006, "<P" * 50), (1007, "S>M>" * 50),
    ]
    docs = docs_of(texts, extra="n")
    made = fim.fill_in_middle(docs, "fim2")
    assert made.columns == [*docs.columns, "fim2"]
    rows = made.withColumn("back", fim.restored(F.col("fim2.output"), F.col("fim2.form"))).collect()
    want = sorted(str((i, *spelt_out(i, t), t or "")) for i, t in texts)
    assert sorted(str((r.doc_id, *r.fim2, r.back)) for r in rows) == want
    assert {r.fim2.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_policy_decides_the_shares(docs_of):
    docs = docs_of([f"text {i}" for i in range(300)])
    forms = lambda **p: {r.form for r in fim.fill_in_middle(docs, policy=fim.Policy(**p)).select("fim.form").collect()}
    assert forms(plain=100) == {"plain"} and forms(plain=0, suffix_first=100) == {"spm"} and forms(plain=0, suffix_first=0) == {"psm"}


def test_windows_hold_few_bytes():
    """Besides the texts, a worker holds some numbers of eight bytes for each byte of a window: at most 1 MB each."""
    assert all(8 * (end - begin) <= 1 << 20 for begin, end in fim.windows(10_000_000))
    assert sum(end - begin for begin, end in fim.windows(10_000_000)) == 10_000_000
