"""Nearest neighbours, chat formatting, HTML extraction, and the pipeline."""

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeweave.llm import chat_parts, rotated_codes, wrappers
from gradeweave.llm.oracle import ORACLE
from gradeweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
has_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="no driver tables")


def nearest_by_force(ids, rows, asks, k=10):
    out = {}
    for i in asks:
        d = np.sqrt(((rows - rows[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


@pytest.mark.parametrize("block,asked", [(16_384, 1_024), (64, 2)])
def test_neighbours_have_high_recall_and_exact_scores(spark, monkeypatch, block, asked):
    monkeypatch.setattr(rotated_codes, "BLOCK", block)
    monkeypatch.setattr(rotated_codes, "ASKED", asked)
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((1500, 32)).astype(np.float32)
    rows[700:1000] = rows[700]  # copies
    ids = np.arange(1500)
    found = rotated_codes.nearest(vectors(spark, [(int(i), r.tolist(), 0, 0.5) for i, r in zip(ids, rows)]), F.col("vec_id") % 100 == 0).collect()
    want = nearest_by_force(ids, rows.astype(float), range(0, 1500, 100))
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert all(len(got[q]) == 10 for q in want)
    assert got[700] == want[700] and got[800] == want[800]  # ties go to smaller ids
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 150
    exact = {(q, v): s for q, pairs in want.items() for v, s in pairs}
    assert all(exact[q, v] == s for q, pairs in got.items() for v, s in pairs if (q, v) in exact)


def test_odd_vectors_take_no_part(spark):
    odd = [
        (0, [1.0, 0.0], 0, 0.0), (100, [0.0, 1.0], 0, 0.0), (1, None, 0, 0.0), (2, [0.0, 0.0], 0, 0.0), (3, [1.0, None], 0, 0.0),
        (4, [float("nan"), 1.0], 0, 0.0), (5, [float("inf"), 1.0], 0, 0.0), (6, [1.0, 1.0], 0, 0.0), (6, [1.0, 1.0], 0, 0.0),
        (7, [1.0], 0, 0.0), (None, [1.0, 2.0], 0, 0.0), (200, [0.0, 0.0], 0, 0.0),
    ]
    rows = sorted(map(tuple, rotated_codes.nearest(vectors(spark, odd), F.col("vec_id") % 100 == 0).collect()))
    assert [(q, r, v) for q, r, v, _ in rows] == [(0, 1, 6), (0, 2, 100), (100, 1, 6), (100, 2, 0)]
    assert rotated_codes.nearest(vectors(spark, odd[:1]), F.col("vec_id") % 100 == 0).count() == 0
    assert rotated_codes.nearest(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_bound_covers_the_estimates_error():
    rng = np.random.default_rng(9)
    rows, queries = rng.standard_normal((800, 64)), rng.standard_normal((20, 64))
    code = rotated_codes.RotatedCode.of(rotated_codes.fit_centres(rows, 1))
    home, bits, length, aligned = code.encode(rows)
    outside = 0
    for q in queries:
        estimate, error = code.estimate(q, 0, bits, length, aligned)
        outside += (np.abs(estimate - ((rows - q) ** 2).sum(axis=1)) > error).sum()
    assert outside < 0.01 * 800 * 20


def test_sums_looked_up_are_inner_products_with_the_signs():
    rng = np.random.default_rng(3)
    for d in (1, 7, 8, 20):
        rows, q = rng.standard_normal((50, d)), rng.standard_normal(d)
        code = rotated_codes.RotatedCode.of(np.zeros((1, d)))
        _, bits, length, aligned = code.encode(rows)
        signs = 2.0 * np.unpackbits(bits, axis=1)[:, :d] - 1
        far = np.linalg.norm(q)
        want = length**2 + far**2 - 2 * length * far * (signs @ (q / far @ code.rotation)) / np.sqrt(d) / aligned
        assert np.allclose(code.estimate(q, 0, bits, length, aligned)[0], want)


def test_a_limit_from_near_lists_spares_most_exact_comparisons():
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((40_000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    code = rotated_codes.RotatedCode.of(rotated_codes.fit_centres(rows[:20_000], 50, 4))
    home, bits, length, aligned = code.encode(rows)
    members = [np.flatnonzero(home == h) for h in range(50)]
    held = [{"vectors": rows[m], "codes": bits[m], "length": length[m], "aligned": aligned[m]} for m in members]
    compared = hits = 0
    for q in range(0, 40_000, 2_000):
        found, limit = [], np.inf
        for place, h in enumerate(rotated_codes.nearest_centres(rows[q:q + 1], code.centres, 50)[0]):
            at = rotated_codes.nearest_in_block(code, rows[q], limit if place >= rotated_codes.NEAR else np.inf, 10, h, held[h])
            compared += len(at)
            found += zip(np.linalg.norm(rows[members[h][at]] - rows[q], axis=1).tolist(), members[h][at].tolist(), strict=True)
            if place == rotated_codes.NEAR - 1:
                limit = sorted(found)[10][0]
        hits += len({v for _, v in sorted(found)[:11]} & set(np.argsort(((rows - rows[q]) ** 2).sum(axis=1))[:11].tolist()))
    assert compared < 0.3 * 20 * 40_000 and hits >= 0.99 * 20 * 11


def test_of_rows_of_one_id_the_smallest_vector_asks(spark):
    rows = [(100, [0.0, 5.0], 0, 0.0), (100, [0.0, 1.0], 0, 0.0), (3, [0.0, 2.0], 0, 0.0), (3, [0.0, 4.9], 0, 0.0), (4, [9.0, 9.0], 0, 0.0)]
    got = rotated_codes.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 1)) for r in got] == [(3, 1.0), (3, 3.9)]


CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "<||", "a<|b", "\\<|image|>", "<", "|", ""]


def test_escaping_is_reversible():
    rng = random.Random(6)
    texts = CONTROL + ["".join(rng.choice("<|\\a\nn>") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert all(chat_parts.unescape(chat_parts.escape(t)) == t and "<|" not in chat_parts.escape(t) for t in texts)
    assert all(chat_parts.unescape_role(chat_parts.escape_role(t)) == t and "\n" not in chat_parts.escape_role(t) for t in texts)
    assert len({chat_parts.escape(t) for t in texts}) == len(set(texts))


def test_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "assistant", [part("text", "see <|image|> "), part("image", ref="a.png", w=57, h=28), part("text", "."),
                                 part("audio", ref="b.wav", s=2.01), part("document", ref="c.pdf", p=3), part("odd", "x"), None]),
            (1, 1, "user", None), (1, 2, None, [part(None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_parts.PART_TYPE}>")
    out = chat_parts.format_turns(df).orderBy("turn").collect()
    r = out[0]
    assert r.segment == "<|im_start|>assistant\nsee <\\|image|> <|image|>.<|audio|><|document|>x<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 768)]
    assert all(r.segment[a.place:].startswith(f"<|{a.kind}|>") for a in r.attachments) and r.expanded_tokens == 822
    assert [r.segment[s.begin:s.end] for s in r.loss] == ["see <\\|image|> ", ".", "x"]
    assert out[1].segment == "<|im_start|>user\n<|im_end|>\n" and out[2].segment == "<|im_start|>\n<|im_end|>\n"


def test_very_long_texts_are_formatted_whole(spark):
    text = "word <| and é " * 200_000
    turns = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    made = chat_parts.format_turns(turns.withColumn("parts", chat_parts.text_part(F.col("text"))))
    (r,) = chat_parts.conversation_digests(made).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"assistant\n{text}\nuser\n\n".encode()).hexdigest()


def test_control_strings_cut_into_parts_stay_text():
    rng = random.Random(7)
    pieces = [*CONTROL, "<", "|", "\\", "<\\", "<|", "|>", "<\\\\|", "a", "\n", "<|image|>"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        parts = [{"kind": "text", "text": text[a:b]} for a, b in zip([0, *cuts], [*cuts, len(text)])]
        at = rng.randint(0, len(parts))
        for role, given, said in (("assistant", parts, [text]), ("user", parts, [text]),
                                  ("assistant", [*parts[:at], {"kind": "image"}, *parts[at:]],
                                   ["".join(p["text"] for p in half) for half in (parts[:at], parts[at:])])):
            turn = chat_parts.Flattener(role, chat_parts.Expansion()).turn(given)
            assert turn["segment"].count("<|im_start|>") == 1 and turn["segment"].count("<|im_end|>") == 1
            assert turn["segment"].count("<|image|>") == len(said) - 1 and turn["segment"].count("<|") == 1 + len(said)
            read_role, body = chat_parts.read_segment(turn["segment"])
            assert (read_role, chat_parts.unescape(body)) == (role, "<|image|>".join(said))
            spans = [chat_parts.unescape(turn["segment"][s["begin"]:s["end"]]) for s in turn["loss"]]
            assert spans == ([t for t in said if t] if role == "assistant" else [])


def test_digests_of_conversations(spark):
    rows = [(i % 7 if i % 11 else None, i // 7, random.Random(i).choice(["user", "assistant", None, "system\n"]), random.Random(i).choice([*CONTROL, None, "é" * 9]), "x")
            for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat_parts.conversation_digests(
        chat_parts.format_turns(turns.withColumn("parts", chat_parts.text_part(F.col("text"))))).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, held in by.items():
        if len({t for t, _, _ in held}) < len(held):
            assert got[c].n_turns == len(held)
            continue
        held.sort()
        said = "".join(x for _, r, x in held if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in held).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_parts.conversation_digests(chat_parts.format_turns(
        turns.limit(0).withColumn("parts", chat_parts.text_part(F.col("text"))))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><a href="/">Site {n}</a></header>
<div id="nav"><ul><li><a>One</a><li><a>Two</a></ul></div><div class="cookie-notice">We use cookies {n}</div><div class="content">
<h1>Title &amp; {n}</h1><p>First <b>bold</b> text {n}<p>Second &nbsp; para<br>of {n} <a href=x>link</a><table><tr><td>c1 {n}<td>c2 {n}</table>
<ul>{items}</ul><p>Share this page</p><div class="comments"><p>bad comment {n}</p></div><form><p>mail {n}</p></form></div>
<aside>side {n}</aside><footer>foot {n}</footer><script>if(a<b){{x("</p>")}}</script></body>"""


def page(n):
    return PAGE.format(n=n, items="".join(f"<li>item {n} {i}" for i in range(n % 4)))


def blocks(n):
    return [f"Title & {n}", f"First bold text {n}", f"Second para of {n} link", f"c1 {n}", f"c2 {n}", *[f"item {n} {i}" for i in range(n % 4)]]


def test_pages_without_marks_of_their_article(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(i), "x") for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string")
    for r in wrappers.extract(df).collect():
        assert r.text.split("\n\n") == blocks(r.page_id), r.text  # what all pages share is the template's
    found = wrappers.infer_wrappers(df)
    assert sorted(r.host for r in found.collect()) == ["h0.example.com", "h1.example.com"]


def test_template_texts_fall_away():
    pages = [f"<body><div><h2>Read on</h2><p>Text of page number {n}</p><div>Terms apply</div></div></body>" for n in range(6)]
    wrapper = wrappers.wrapper_of(wrappers.parsed(pages[0]))
    for p in pages[1:]:
        wrapper = wrappers.merged(wrapper, wrappers.wrapper_of(wrappers.parsed(p)))
    import json
    slots = wrappers.Slots(json.dumps(wrapper))
    assert [wrappers.main_text(p, slots) for p in pages] == [f"Text of page number {n}" for n in range(6)]
    # A text on few pages, or on many copies of one article, is no template.
    copies = [p.replace("<h2>", "<h4>Note</h4><h2>") for p in [pages[0].replace("Text of page number 0", "The longest text of all")] * 9]
    for i, p in enumerate(copies):
        wrapper = wrappers.merged(wrapper, wrappers.wrapper_of(wrappers.parsed(p.replace("</body>", f"<footer>{i}</footer></body>"))))
    assert wrappers.main_text(copies[0], wrappers.Slots(json.dumps(wrapper))) == "Note\n\nThe longest text of all"


def test_alignment_makes_options_and_repeats():
    tree = lambda h: wrappers.wrapper_of(wrappers.parsed(h))
    both = wrappers.merged(tree("<div><h1>a</h1><p>b</p></div>"), tree("<div><h1>c</h1><h2>d</h2><p>b</p><p>e</p></div>"))
    kids = both[2][0][0][2]
    assert [(k[0][1], k[1], k[2]) for k in kids] == [("h1/texts", False, False), ("h2/texts", True, False), ("p/texts", False, True)]
    group = tree("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")[2][0][0][2]
    assert len(group) == 1 and group[0][0][0] == "R" and group[0][2]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://X.example/", "plain <b>x</b> &lt;y&gt; 1 < 2"), (4, None, deep),
            (5, "http://x.example/", "<p>" + "word " * 60_000), (5, "http://x.example/", "<p>again"), (None, "", "<article>a<br>b</article>c"),
            (7, "u", "<!-- <p>no --><![CDATA[no]]><article><p>yes</article"), (8, "u", "<li>" * 4000 + "x<p><h2>y")]
    rows += [(9, "http://z.example/", "<p>twice</p>")] * 2
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(1, ""), (2, ""), (3, "plain x <y> 1 < 2"), (4, "deep text"), (5, ("word " * 60_000).strip()), (5, "again"), (None, "a b"),
            (7, "yes</article"), (8, "x\n\ny"), (9, "twice"), (9, "twice")]
    assert sorted(str((r.page_id, r.text)) for r in got) == sorted(map(str, want))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.extract(empty).count() == 0


@has_tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.execute(ORACLE[name])
    heads = [d[0] for d in rel.description]
    got = QUERIES[name](spark, SMALL).select(*heads).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


@has_tables
def test_every_query_covers_its_table(spark):
    n = {t: spark.read.parquet(f"{SMALL}/{t}.parquet").count() for t in ("documents", "pages")}
    for name in ("op2_simhash", "op3_length_buckets", "op8_knn_quality", "op9_lexicon_bpe", "op10_token_counts"):
        assert QUERIES[name](spark, SMALL).select("doc_id").distinct().count() == n["documents"], name
    assert QUERIES["op7_wrappers"](spark, SMALL).count() == n["pages"]


@has_tables
def test_pipeline_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns and after.schema == docs.schema, name
        from gradeweave.session import materialize
        after = materialize(after, "test")
        assert after.select("doc_id").exceptAll(now.select("doc_id")).isEmpty(), name
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert sorted(r.doc_id for r in packed.select("doc_id").collect()) == sorted(r.doc_id for r in now.select("doc_id").collect())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    left = now.join(labels, "doc_id")
    assert left.filter("quality = 0").count() <= 0.05 * labels.filter("quality = 0").count()


def test_pipeline_takes_an_empty_table(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
