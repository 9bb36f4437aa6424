"""What of a page counts as its main part."""

import json

from gradeweave.llm import wrappers


def texts(*pages):
    """Texts of a host's pages, whose wrapper is aligned in the order given."""
    wrapper = wrappers.wrapper_of(wrappers.parsed(pages[0]))
    for p in pages[1:]:
        wrapper = wrappers.merged(wrapper, wrappers.wrapper_of(wrappers.parsed(p)))
    slots = wrappers.Slots(json.dumps(wrapper))
    return [wrappers.main_text(p, slots).split("\n\n") for p in pages]


def test_constant_texts_of_an_article_stay():
    for n in (4, 9):  # on small and large hosts
        pages = [f"<p>Site</p><article><h1>Dish {i}</h1><p>Some text {i}</p><h2>Ingredients</h2><p>Salt</p></article>" for i in range(n)]
        assert texts(*pages) == [[f"Dish {i}", f"Some text {i}", "Ingredients", "Salt"] for i in range(n)]


def test_pages_are_told_apart_by_texts_that_count():
    copies = [f"<div><p>Short</p></div><div class='ad'>A long advert, number {i}</div><nav><a>And a long menu {i}</a></nav>" for i in range(9)]
    assert texts(*copies) == [["Short"]] * 9


def test_a_text_is_template_only_if_it_is_the_constant():
    first = ["<div><p>a</p>x</div>", "<div>y</div>"]
    rest = [f"<div>Advert<p>Longer text {i}</p>z{i}</div>" for i in range(5)]
    assert texts(*first, *rest) == [["a", "x"], ["y"], *[[f"Longer text {i}", f"z{i}"] for i in range(5)]]


def test_nesting_has_no_bound():
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    assert texts(f"<div id=page><article>{deep(200, 'a')}<p>rest</p></article></div>") == [["a", "rest"]]
    assert texts("x" + deep(200, "<nav>menu</nav><div class='ad'>buy<div>now</div></div>b") + "c") == [["x", "b", "c"]]
    assert texts("<div>" * 200 + "<nav>menu</nav>b") == [["b"]]
    assert texts("x" + deep(200, "<article>y</article>")) == [["y"]]
    assert texts(deep(20_000, "z")) == [["z"]]
    pages = [deep(200, f"<p>Text of page {i}</p>") + "<p>Terms</p>" for i in range(6)]
    assert texts(*pages) == [[f"Text of page {i}"] for i in range(6)]


def test_layout_classes_do_not_drop_the_article():
    for holder in ('div class="content has-sidebar"', 'div id=page class="no-sidebar"', 'div class="elementor-widget"',
                   'div class="post social-policy"', 'article class="post tag-ads"', 'main class="no-comments"'):
        name = holder.split()[0]
        assert texts(f"<body><{holder}><p>Text</p></{name}></body>") == [["Text"]], holder
    for holder in ("sidebar", "widget", "cookie-notice", "ads"):  # what holds the article stays, whatever its class
        for part in ("article", "main", "div role=main", "article class=promo"):
            assert texts(f"<p>Site</p><div class={holder}><{part}><p>All the text</p></{part.split()[0]}></div>")[0][-1] == "All the text"
    assert texts("<div class=widget><p>All there is</p></div>") == [["All there is"]]
    assert texts("<article><div class=widget><p>All there is</p></div></article><p>Site</p>") == [["All there is"]]
    pages = [f"<div><p>Text of page {i}</p></div><p>Terms</p>" for i in range(6)]  # what the wrapper leaves nothing of
    assert texts(*pages, "<div class=notice><p>A notice</p></div><p>Terms</p>")[-1] == ["A notice"]


def test_marked_classes_still_fall_away():
    for mark in ("ad", "ad-slot", "google-ads", "cookie-notice", "site-footer", "left-sidebar", "related-posts", "share-buttons", "comment-list",
                 "main-nav", "newsletter-signup", "top-bar banner", "widget widget_text", "site-header", "usercomments", "Sidebar--left", "ad-300"):
        assert texts(f'<div class="{mark}"><p>bad</p></div><div><p>Text</p></div>') == [["Text"]], mark
    answers = "<div id=comments>" + "<article class='comment even'><p>A long comment</p></article>" * 5 + "</div>"
    assert texts(f"<div><p>Text</p></div>{answers}") == [["Text"]]
    assert texts(f"<article><p>Text</p></article>{answers}") == [["Text"]]
    assert texts("<article><p>Text</p></article><div class=related><article><p>Another and a longer text</p></article></div>") == [["Text"]]
    assert texts("<div class=ad><p>buy</p></div>") == [[""]]


def test_embedded_markup_costs_no_article():
    article = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><p>Rest</p></article>"
    assert texts(article) == [["Let x=2 be", "Rest"]]
    assert texts("<article><object data=a.svg><p>Fallback</p></object><p>Rest</p></article>") == [["Fallback", "Rest"]]
    for tag in ("math", "object", "svg", "select"):  # without an end tag
        assert texts(f"<p>a <{tag}></p><article><p>One</p><p><{tag} x=y></p><p>Two</p></article>") == [["One", "Two"]], tag
        assert texts(f"<{tag}><article><p>One</p></article>") == [["One"]], tag
    assert texts("<p>Click <svg><title>t</title><g><text>no</text></g><a>no</a><svg/></svg> here <select><option>a<hr><option>b</select>too</p>") == [["Click here too"]]
    assert texts("<p>a <svg><foreignObject><div>no</div><p>no</p></foreignObject><text>no</text></svg>b</p>") == [["a b"]]
    assert texts("<p>a <svg><foreignObject></p><p>b</p>") == [["a", "b"]]
    assert texts("<p>a <svg><foreignObject></p><p>b <svg><foreignObject>no</foreignObject></svg></p><p>c</p>")[0][-1] == "c"
