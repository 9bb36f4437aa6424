"""What wrappers match, what they choose, and how they grow."""

import html
import json
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from gradeweave.llm import wrappers


def wrapper_of(pages):
    trees = [wrappers.wrapper_of(wrappers.parsed(p)) for p in pages]
    wrapper = trees[0]
    for t in trees[1:]:
        wrapper = wrappers.merged(wrapper, t)
    return wrapper


def matches(node, item):
    """Whether a wrapper's node matches an element or a text; tried out in every way, with no alignment."""
    if node[0] == "#":
        return not isinstance(item, wrappers.Element) and (node[1] is None or node[1] == wrappers._digest(item[0]))
    if node[0] == "R" or not isinstance(item, wrappers.Element):
        return False
    return node[1] == item.tag and stream_matches(node[2], item.kids)


def stream_matches(kids, items):
    """Whether the expression ``kids`` matches a whole stream: the sets of places that each child can end at."""
    ends = {0}
    for node, optional, repeated in kids:
        options = [k[0] for k in node[1]] if node[0] == "R" else [node]
        step = lambda at: {i + 1 for i in at if i < len(items) and any(matches(o, items[i]) for o in options)}  # noqa: B023, E731
        after, new = (set(ends) if optional or node[0] == "R" else set()), step(ends)
        while new - after:
            after |= new
            new = step(new) if repeated else set()
        ends = after
    return len(items) in ends


def random_page(rng, depth=0):
    if depth == 3 or rng.random() < 0.3:
        return f"<p>{rng.choice(['same', 'text ' + str(rng.randint(0, 99))])}</p>"
    tag = rng.choice(["div", "section", "ul"])
    return f"<{tag}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(0, 5))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(30))
def test_a_wrapper_matches_all_pages_it_was_aligned_from(seed):
    rng = random.Random(seed)
    pages = ["".join(random_page(rng) for _ in range(rng.randint(1, 4))) for _ in range(6)]
    wrapper = wrapper_of(pages)
    assert all(stream_matches(wrapper[2], wrappers.parsed(p).kids) for p in pages)
    halves = wrappers.merged(wrapper_of(pages[:3]), wrapper_of(pages[3:]))
    assert all(stream_matches(halves[2], wrappers.parsed(p).kids) for p in pages)
    assert not stream_matches(wrapper[2], wrappers.parsed(pages[0] + "<table><tr><td>x</table>").kids)


def longest_common(x, y):
    """Length of the longest common sequence, by trying all of the shorter stream's choices."""
    return max(sum(m) for m in [[bin(k).count("1")] for k in range(1 << len(x)) if is_within([c for i, c in enumerate(x) if k >> i & 1], y)])


def is_within(part, whole):
    rest = iter(whole)
    return all(c in rest for c in part)


def test_alignment_keeps_the_longest_common_sequence():
    rng = random.Random(1)
    for _ in range(300):
        x, y = (["".join(rng.choice("abcd")) for _ in range(rng.randint(0, 7))] for _ in range(2))
        if any(a == b for s in (x, y) for a, b in zip(s, s[1:])):
            continue  # runs are folded before
        kids = [[[["E", f"{c}/texts", []], False, False] for c in s] for s in (x, y)]
        out = wrappers.aligned(*kids)
        assert sum(not k[1] for k in out) <= longest_common(x, y)
        runs = any(k[2] for k in out)
        assert runs or sum(not k[1] for k in out) == longest_common(x, y)


LONG = "Words of the article that go on for a while, as articles do, number {0}."


def bare(n, rng):
    """A page of plain elements only: menu, advert, article and sidebar, all varying."""
    menu = "<div><div>" + "".join(f"<div>m{rng.randint(0, 99)}</div>" for _ in range(5)) + "</div></div>"
    body = [f"Title {n}", *[LONG.format(rng.randint(0, 10**6)) for _ in range(rng.randint(2, 9))]]
    article = "<div>" + "".join(f"<div>{t}</div>" for t in body) + "</div>"
    return f"{menu}<div>Advert {rng.randint(0, 99)}</div>{article}<div>Weather {n % 7} degrees</div>", body


def test_the_wrapper_chooses_the_article_where_nothing_marks_it():
    rng = random.Random(3)
    for count in (1, 3, 40):
        made = [bare(n, rng) for n in range(count)]
        slots = wrappers.Slots(json.dumps(wrapper_of([p for p, _ in made])))
        assert [wrappers.main_text(p, slots).split("\n\n") for p, _ in made] == [b for _, b in made]
        assert all(wrappers.main_text(p, None).split("\n\n") != b for p, b in made)  # without it, all of the body counts


def test_order_of_pages_and_their_classes_change_nothing(spark):
    rng = random.Random(4)
    made = [bare(n, rng) for n in range(60)]
    pages = [(n, "http://a.example.com/x", p.replace("<div>", f"<div class='c{n}x{n % 9}'>", 3)) for n, (p, _) in enumerate(made)]
    schema = "page_id long, url string, html string"
    for order in (pages, pages[::-1], rng.sample(pages, 60)):
        got = {r.page_id: r.text.split("\n\n") for r in wrappers.extract(spark.createDataFrame(order, schema)).collect()}
        assert got == {n: b for n, (_, b) in enumerate(made)}


def test_a_wrapper_does_not_grow_with_its_host():
    sizes = []
    for count in (200, 2_000):
        rng = random.Random(9)
        pages = [bare(n, rng)[0].replace("<div>", f"<div id=x{rng.random()} class='a{n} b{rng.random()}'>") for n in range(count)]
        sizes.append(len(json.dumps(wrapper_of(pages))))
    assert sizes[1] < 1.1 * sizes[0]


def test_main_part_in_two_forms_and_texts_spread_over_the_page():
    flat = "<div><div>head</div></div><h1>{0}</h1><section><p>" + LONG + "</p><p>more {0}</p></section><footer>x</footer>"
    deep = "<div><div>head</div></div><h1>{0}</h1><section><p>" + LONG + "</p><ul><li>item {0}</li></ul></section><footer>x</footer>"
    pages = [(flat if n % 2 else deep).format(n) for n in range(8)]
    slots = wrappers.Slots(json.dumps(wrapper_of(pages)))
    assert [wrappers.main_text(p, slots).split("\n\n") for p in pages] == [[LONG.format(n), f"more {n}" if n % 2 else f"item {n}"] for n in range(8)]
    spread = [f"<div><p>{LONG.format(n)}</p></div><section><p>{LONG.format(-n)}</p></section>" for n in range(8)]
    slots = wrappers.Slots(json.dumps(wrapper_of(spread)))
    assert not slots.main and all(len(wrappers.main_text(p, slots).split("\n\n")) == 2 for p in spread)


SMALL = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SMALL.exists(), reason="no driver tables")
def test_given_pages_without_tags_classes_and_roles():
    """The articles of the given pages, with every element a plain div and links as texts: the wrapper finds them."""
    def plain(element):
        return "".join(f"<div>{plain(k)}</div>" if isinstance(k, wrappers.Element) else html.escape(k[0]) for k in element.kids)

    by_host = defaultdict(list)
    for url, page in duckdb.sql(f"SELECT url, html FROM '{SMALL}/pages.parquet' ORDER BY page_id").fetchall():
        by_host[(url or "").split("/")[2:3] and url.split("/")[2]].append(page)
    found = alone = total = 0
    for pages in by_host.values():
        want = [wrappers.main_text(p, None) for p in pages]  # by the page's own marks
        bare = [plain(wrappers.parsed(p)) for p in pages]
        slots = wrappers.Slots(json.dumps(wrapper_of(bare)))
        found += sum(wrappers.main_text(p, slots) == w for p, w in zip(bare, want, strict=True))
        alone += sum(wrappers.main_text(p, None) == w for p, w in zip(bare, want, strict=True))
        total += len(pages)
    assert found >= 0.9 * total and alone <= 0.1 * total
