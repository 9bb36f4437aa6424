"""The five stages against the same steps spelt out, one document after the other."""

import random
from collections import Counter

import duckdb
import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from gradeweave.llm import knn_quality
from gradeweave.llm.oracle import ORACLE
from gradeweave.session import materialize
from tests.llm.test_near_copies import closest, spelt_out

WHITE = " \t\n\x0b\x0c\r"
SHARED = "This long passage stands in a number of documents, word for word."


def documents():
    """(doc_id, text): good and bad prose, copies, near copies, shared lines, nulls, repeated rows and a very long text."""
    rng = random.Random(12)
    small, words = "the of and to a in is that with".split(), "river stone morning window garden letter quiet answer paper winter road".split()
    word = lambda: rng.choice(small) if rng.random() < 0.3 else rng.choice(words) + str(rng.randint(0, 60) or "")
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shout = lambda n: " ".join(rng.choice(words).upper() + "!!###" for _ in range(n))
    made = [(i, prose(rng.randint(60, 140)) if i % 3 else shout(rng.randint(60, 140))) for i in range(90)]
    base = prose(400)
    made += [(200 + i, base) for i in range(4)] + [(210 + i, base.replace(" stone", " sand", 1) + " End." * (i == 0)) for i in range(2)]
    made += [(300 + i, f"{prose(70)}\n{SHARED}\n{prose(40)}") for i in range(5)]
    made += [(400, None), (401, ""), (402, " \n "), (None, prose(80)), (403, prose(80)), (403, prose(90)), (404, "\n".join(prose(60) for _ in range(3_000)))]
    made += [(405, base + "x")] * 2
    return made


def without_shared_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    holders = {}
    for i, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            if i is not None and len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return [(i, "\n".join(x for x in t.split("\n") if i is None or gone.get(key(x), i) == i)) for i, t in docs]


def one_of_each(docs):
    root = closest([spelt_out(t) for _, t in docs])
    first = {}
    for k, (i, _) in enumerate(docs):
        at = first.setdefault(root[k], k)
        if docs[at][0] is None or i is not None and i < docs[at][0]:
            first[root[k]] = k
    return [docs[k] for k in sorted(first.values())]


def stored(spark, folder, made):
    rows = [(i, t, "en", "s", len(t or ""), "x", 1.5, 7) for i, t in made]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, quality int")
    docs.write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(not (t or "").isupper() and len(t or "") > 100), 0) for i, t in made if i is not None]
    spark.createDataFrame(sorted(set(marks)), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, marks


def test_stages_equal_the_same_steps_spelt_out(spark, tmp_path):
    made = documents()
    docs, _ = stored(spark, str(tmp_path), made)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    now, got = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.schema == docs.schema, name
        now = materialize(after, "test-stage")
        rows = now.collect()
        assert all((r.lang, r.source, r.fp, r.score, r.quality) == ("en", "s", "x", 1.5, 7) for r in rows), name
        assert name in ("quality classifier", "quality rules") or all(r.n_chars == len(r.text) for r in rows), name
        got.append(Counter((r.doc_id, r.text or "") for r in rows))

    model = knn_quality.fit(docs, labels)
    kept = []
    for i, t in made:
        unit = model.latent(knn_quality.term_vector(t)[None], model.projection)[0]
        cosines = np.round(model.vectors @ unit / knn_quality.STEP).astype(int)
        near = np.argsort(-cosines, kind="stable")[:knn_quality.NEIGHBOURS]
        weight = np.clip(cosines[near] * knn_quality.STEP, 0, None) ** knn_quality.SHARPNESS
        score = (weight * model.labels[near]).sum() / weight.sum() if weight.sum() > 0 else model.prior()
        if score >= 0.5:
            kept.append((i, t or ""))
    assert got[0] == Counter(kept)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(kept)])
    ruled = [kept[k] for (k,) in sorted(con.execute(f"SELECT doc_id FROM ({ORACLE['op6_quality_rules']}) WHERE kept").fetchall())]
    assert got[1] == Counter(ruled) and ruled
    lines = without_shared_lines(ruled)
    assert got[2] == Counter(lines) and lines != ruled
    alone = one_of_each(lines)
    assert got[3] == Counter(alone) and len(alone) < len(lines)

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == Counter((i, len(pieces.findall(t))) for i, t in alone)
    assert all(r.n_tokens <= r.bucket_tokens for r in packed) and len({(r.bucket, r.shard, r.batch, r.slot) for r in packed}) == len(packed)
    for (bucket, *_), n in Counter((r.bucket, r.shard, r.batch) for r in packed).items():
        size = next(r.bucket_tokens for r in packed if r.bucket == bucket)
        assert n == 1 or n * size <= 65_536
