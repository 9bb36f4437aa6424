"""HTML extraction with wrappers that are inferred per host.

A page is a stream of tokens, tags and texts. A tag is told by its name and its shape: whether it holds texts only, such
elements, or deeper ones; classes and ids do not count, so they cannot make a wrapper grow. Within each element's stream
of children, a run of one tag becomes one repeated child, and so does a repeated group of two or three, each in its
place. Then the pages of a host are aligned one after the other with the wrapper so
far: children that match are aligned in turn, a text that differs becomes a slot, a child that one side lacks
becomes optional, and a child met several times repeated. A stream that stays longer than ``WIDE`` becomes one repeated
group of optional children, of which there are no more than tags. There are
no alternatives, so a wrapper is a union-free regular expression over tokens.

Wrappers align with wrappers in the same way. So each task folds its pages into one
wrapper per host, and these are aligned in two steps per host; a host with a
third of all pages is folded in all tasks.

Extraction walks a page along its host's wrapper. Elements that are not content by their tag, role,
class or id fall away. Of the rest, a part that the page itself marks as its article or main counts, whole. On other
pages the wrapper chooses the part: from the root on, it goes down to the child whose slots, over all pages of the host, hold
``SHARE`` of the text in slots, until the text is spread over several children or a repeated one. Of that part, and of the
body where the wrapper finds none on a page, lists of
links fall away and what the wrapper shows to be the template's (a text that stayed the same on ``ENOUGH``
pages whose longest texts, of those that count, differ). A text that the wrapper does not place is judged by the
page alone.

Defined results: null or empty html gives an empty text; a null or odd url stands for the host ""; unclosed and stray
tags are tolerated; repeated rows are extracted each; extra columns are dropped; nothing is cut off.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.session import materialize

#: Different pages over which a text must stay the same to count as template.
ENOUGH = 5
#: Children a wrapper's stream may have before it becomes a repeated group, hosts a task folds at a time, and parts in
#: which a host's wrappers are aligned first.
WIDE, HOSTS, PARTS = 128, 2_000, 64
#: Share of the text in slots that a part has to hold to be the main one.
SHARE = 0.7
#: Nesting that wrappers tell apart; deeper elements are flat to them. The tree of a page has no bound.
DEEP = 150

# HTML's void elements, elements whose content is no markup, elements that fall away within a text and
# end at a block, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
MUTE = frozenset("svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
# Elements that an opening tag closes, up to the nearest of the tags behind it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NOT_CONTENT = frozenset("nav footer aside form button dialog menu head fieldset".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Names in a class or id by which an element is no content: a token counts if each of its parts, between hyphens and
# underscores, is one of these words or an affix, and one is a word. So ``cookie-notice`` and ``sidebar-left`` count, and
# ``has-sidebar``, ``tag-ads`` and ``social-policy`` do not.
SURE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer ad ads advert adverts advertisement advertising "
    "sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus replies respond login signup "
    "pagination pager skip-link".split()
)
WORDS = SURE | frozenset(
    "sidebar side-bar aside masthead banner topbar promo promotion notice notices notification alert newsletter subscribe "
    "subscription share sharing social related recommended popup modal overlay toolbar widget widgets".split()
)
AFFIXES = frozenset(
    "site page main top bottom left right first second primary secondary tertiary global sub mobile desktop sticky fixed "
    "floating js google dfp the bar box block wrapper wrap container inner outer area section group holder list item items "
    "slot unit zone label title link links button buttons btn icon icons bar form trail posts articles stories body text "
    "header center side".split()
)
HEADERS = re.compile(r"(?:(?:site|page|main|top)[_-]?)?header")
TEASERS = frozenset("comment comments reply replies related teaser promo ad ads sponsored".split())
ANSWERS = frozenset("comment comments reply replies".split())
JOINED = re.compile(r"(?!no|has|with|hide|show)[a-z]+comment(?:s|list)?")
#: Marks of elements that fall away: by tag or role, and surely or less so by class or id.
DROPS = ("drop", "sure", "class")


def _says(named: str, words: frozenset[str]) -> bool:
    """Whether a token of a class or id consists of such words and affixes."""
    for token in named.lower().split():
        parts = [x for x in re.split(r"[_-]+", token) if x and not x.isdigit()]
        if token in words or any(x in words for x in parts) and all(x in words or x in WORDS or x in AFFIXES for x in parts):
            return True
    return False


TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")


#: Shapes of elements, by their height: of texts only, of such elements, of deeper ones.
SHAPES = ("texts", "flat", "deep")


class Element:
    """An element of a page: its name, what its attributes say of it, its children and texts in order.

    The mark "sure" or "class" is one by class or id alone; the page as a whole decides about these (``_settle``).

    Set once all is read, for the whole subtree: the number of texts and of those that are links, whether a main part
    with text stands outside what is dropped, whether one stands there by tag and role alone, whether that is a ``main``,
    the characters of such parts and of all texts but links outside what is dropped, and whether there is a heading.
    """

    __slots__ = ("name", "tag", "height", "mark", "part", "kids", "texts", "linked", "main", "held", "only", "chars", "kept", "doubt", "heading")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.kids, self.part = name, [], ""
        self.texts = self.linked = self.chars = self.kept = self.height = 0
        self.main = self.held = self.only = self.doubt = self.heading = False
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        self.tag = name
        hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        role = attributes.get("role", "").lower()
        if hidden or name in NOT_CONTENT or role in ROLES:
            self.mark = "drop"
        elif name in ("article", "main") or role in ("main", "article"):
            self.part = "main" if "main" in (name, role) else "article"
            self.mark = "class" if self.part == "article" and _says(named, TEASERS) else "main"
            if self.mark == "class" and _says(named, ANSWERS):
                self.part = "answer"
        elif name in ("html", "body"):
            self.mark = ""
        elif name == "header":
            self.mark = "header"
        else:
            self.mark = "" if not named else "sure" if _says(named, SURE) or any(map(JOINED.fullmatch, named.lower().split())) else "class" if _says(named, WORDS) else ""
            if not self.mark and any(HEADERS.fullmatch(x) for x in named.lower().split()):
                self.mark = "class"

    def sum_up(self) -> None:
        """Sets what is said of the subtree; its elements come first."""
        size = 0
        for kid in self.kids:
            if not isinstance(kid, Element):
                self.texts += 1
                self.linked += kid[1]
                size += 0 if kid[1] else len(kid[0])
                continue
            self.texts += kid.texts
            self.linked += kid.linked
            self.height = max(self.height, kid.height + 1)
            self.heading = self.heading or kid.heading or kid.name in ("h1", "h2")
            if kid.mark == "drop":
                continue
            self.held = self.held or kid.held or kid.mark == "main" and kid.texts > 0
            self.only = self.only or kid.only or kid.part == "main" and kid.texts > 0
            self.chars += kid.chars
            if kid.mark not in DROPS:
                self.main = self.main or kid.main or kid.mark == "main" and kid.texts > 0
                size += kid.kept
        self.kept = size
        self.tag = f"{self.name}/{SHAPES[min(self.height, 2)]}"
        if self.part in ("main", "article"):
            self.chars = max(self.chars, size)


def attributes_of(rest: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}


def parsed(page: str | None) -> Element:
    """Tree of a page's block-level elements. Texts are strings with a flag for texts that are links."""
    root = Element("#root", {})
    stack, text, links, in_link = [root], [], [], 0
    muted: list[str] = []  # open elements of MUTE, and a foreignobject within an svg, which may hold blocks
    elements, at = [root], defaultdict(list)  # in the order of their start tags; places in the stack by name

    def flush() -> None:
        joined = SPACE.sub(" ", "".join(text)).strip()
        if joined:
            linked = sum(len(x.strip()) for x in links) >= 0.8 * len(joined)
            stack[-1].kids.append((joined, linked))
        text.clear()
        links.clear()

    def close(down_to: int) -> None:
        flush()
        while len(stack) > down_to:
            at[stack.pop().name].pop()

    def enter(element: Element) -> None:
        at[element.name].append(len(stack))
        stack[-1].kids.append(element)
        stack.append(element)
        elements.append(element)

    def nearest(names: set[str]) -> int:
        return max((at[x][-1] for x in names if at[x]), default=0)

    def add(piece: str) -> None:
        if muted:
            return
        text.append(piece)
        if in_link:
            links.append(piece)

    place, page = 0, page or ""
    last_foreign = -1
    while found := TOKEN.match(page, place):
        place = found.end()
        if found["text"] is not None:
            add(entities.unescape(found["text"]))
            continue
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not found["end"] and not found["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, place)
                place = end.end() if end else len(page)
            add(" ")
        elif name in MUTE or muted and name == "foreignobject":
            if found["end"]:
                if name in muted:
                    while muted.pop() != name:
                        pass
            elif not found["rest"].endswith("/"):
                if name == "foreignobject" and last_foreign < 0:
                    last_foreign = page.lower().rfind("</foreignobject")
                if name != "foreignobject" or place < last_foreign:
                    add(" " if name == "select" else "")
                    muted.append(name)
        elif muted and muted[-1] == "foreignobject" and place <= last_foreign:
            continue
        elif found["end"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCK or _marked_inline(stack, name):
                muted.clear()
                if at[name]:
                    close(at[name][-1])
                else:
                    flush()
        elif name == "br":
            add(" ")
        elif name == "a":
            in_link += 1
        elif name in BLOCK:
            if name == "hr" and muted:
                continue
            muted.clear()
            flush()
            if name in CLOSES:
                shut, bound = CLOSES[name]
                while (place_of := nearest(shut)) > nearest(bound):
                    close(place_of)
            elif stack[-1].name == "p":
                close(len(stack) - 1)
            if name != "hr":
                enter(Element(name, attributes_of(found["rest"])))
        elif name not in VOID and found["rest"].strip(" /"):
            element = Element(name, attributes_of(found["rest"]))
            if element.mark in DROPS:  # inline, but not content
                flush()
                enter(element)
    flush()
    for element in reversed(elements):
        element.sum_up()
    _settle(elements)
    return root


def _settle(elements: list[Element]) -> None:
    """Decides about elements marked by class or id alone.

    One that holds the page's ``main`` stays. Where no main part stands outside of them, those that hold articles stay if
    these have most of the text. The others fall away, but for the case that nothing else counts (``counted``).
    """
    root = elements[0]
    outweigh = not root.main and root.chars > 0 and root.chars >= root.kept
    for x in elements:
        if x.mark in ("sure", "class"):
            x.doubt = x.mark == "class" and x.part != "answer"
            x.mark = "drop" if not (x.only or outweigh and x.chars > 0) else "main" if x.part else ""
    root.main = root.main or root.only or outweigh and root.held


def _marked_inline(stack: list[Element], name: str) -> bool:
    return stack[-1].name == name and stack[-1].mark in DROPS


# A wrapper's nodes are lists, which JSON can hold:
#   ["#", value or None, linked, pages, size] a text, its slot open (None) once values differ; until then, digests of
#                                             up to ENOUGH pages that show it, by their longest text; size is the length
#                                             of all texts met here, but of links and of what falls away
#   ["E", tag, children]                      an element
#   ["R", children]                           a repeated group of optional children
# and a child is [node, optional, repeated].


def _symbol(node: list) -> str:
    return "#" if node[0] == "#" else "(*)" if node[0] == "R" else f"<{node[1]}>"


def _digest(text: str) -> str:
    return f"{zlib.crc32(text.encode()):08x}{len(text)}"


def wrapper_of(page: Element) -> list:
    """The wrapper of a single page."""
    seen = _digest(max(counted(page, None), key=len, default=""))

    def node(element: Element, depth: int, counts: bool) -> list:
        counts = counts and element.mark not in ("drop", "header") and depth < DEEP
        kids = [
            [node(kid, depth + 1, counts) if isinstance(kid, Element)
             else ["#", _digest(kid[0]), kid[1], [seen], len(kid[0]) if counts and not kid[1] else 0], False, False]
            for kid in (element.kids if depth < DEEP else _texts(element))
        ]
        return ["E", element.tag, folded(kids)]

    return node(page, 1, True)


def folded(kids: list) -> list:
    """Children with a run of one symbol as one repeated child, then groups of two or three that repeat as one group."""
    out: list = []
    for kid in kids:
        if out and _symbol(out[-1][0]) == _symbol(kid[0]):
            out[-1] = [merged(out[-1][0], kid[0]), out[-1][1] and kid[1], True]
        else:
            out.append(kid)
    for width in (2, 3):
        names = [_symbol(k[0]) for k in out]
        done, place = [], 0
        while place < len(out):
            times = 1
            while names[place:place + width] == names[place + times * width:place + (times + 1) * width] and place + (times + 1) * width <= len(names):
                times += 1
            taken = times * width if times > 1 and "(*)" not in names[place:place + width] else 1
            done.append([_group(out[place:place + taken]), False, True] if taken > 1 else out[place])
            place += taken
        out = done
    return out if len(out) <= WIDE else [[_group(out), False, True]]


def _group(kids: list) -> list:
    """A repeated group in which each different child is optional, in the order of first meeting."""
    held: dict[str, list] = {}
    for node, _, _ in kids:
        for inner in ([k[0] for k in node[1]] if node[0] == "R" else [node]):
            name = _symbol(inner)
            held[name] = merged(held[name], inner) if name in held else inner
    return ["R", [[n, True, True] for n in held.values()]]


def merged(a: list, b: list) -> list:
    """The wrapper that matches whatever either of two nodes of one symbol matches."""
    if a[0] == "#":
        same = a[1] is not None and a[1] == b[1]
        return ["#", a[1] if same else None, a[2] and b[2], sorted({*a[3], *b[3]})[:ENOUGH] if same else [], a[4] + b[4]]
    if a[0] == "R":
        return _group(a[1] + b[1])
    return ["E", a[1], aligned(a[2], b[2])]


def aligned(a: list, b: list) -> list:
    """Two streams of children as one, along their longest common sequence: a child that one side lacks is optional, and
    one that a group of the other side holds joins it."""
    x, y = [_symbol(k[0]) for k in a], [_symbol(k[0]) for k in b]
    n, m = len(x), len(y)
    longest = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if x[i] == y[j] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append([merged(a[i][0], b[j][0]), a[i][1] or b[j][1], a[i][2] or b[j][2]])
            i, j = i + 1, j + 1
        elif j >= m or i < n and longest[i + 1][j] >= longest[i][j + 1]:
            out.append([a[i][0], True, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], True, b[j][2]])
            j += 1
    return _refolded(out)


def _refolded(kids: list) -> list:
    """Runs of one symbol that an alignment has brought together as one child, and a stream too long as one group."""
    out: list = []
    for kid in kids:
        if out and _symbol(out[-1][0]) == _symbol(kid[0]):
            out[-1] = [merged(out[-1][0], kid[0]), out[-1][1] and kid[1], True]
        else:
            out.append(kid)
    return out if len(out) <= WIDE else [[_group(out), False, True]]


def slot_text(node: list) -> int:
    """Characters of all texts met in the open slots of a wrapper's node."""
    if node[0] == "#":
        return node[4] if node[1] is None or len(node[3]) < ENOUGH else 0
    return sum(slot_text(k[0]) for k in node[-1])


def main_nodes(root: list) -> list[list]:
    """The nodes of a wrapper's main part: one element, or the forms it takes in turn, which stand side by side as optional
    children of one name. None where the text is spread over the page."""
    chosen, node, all_text = [], root, slot_text(root)
    while all_text:
        kids = node[2]
        sizes = [slot_text(k[0]) for k in kids]
        best = max(range(len(kids)), key=sizes.__getitem__, default=None)
        if best is None or kids[best][0][0] != "E" or kids[best][2]:
            break
        name, shape = kids[best][0][1].split("/")
        like = lambda k: k[1] and not k[2] and k[0][0] == "E" and k[0][1].split("/")[0] == name
        first = last = best
        while kids[best][1] and first > 0 and like(kids[first - 1]):
            first -= 1
        while kids[best][1] and last + 1 < len(kids) and like(kids[last + 1]):
            last += 1
        beside = [k for i, k in enumerate(kids) if not first <= i <= last and sizes[i]]
        alone = not any(k[0][0] == "#" or k[0][0] == "R" or k[0][1].endswith("/texts") for k in beside)
        if sum(sizes[first:last + 1]) < SHARE * all_text or shape == "texts" and not alone:
            break
        chosen = [k[0] for k in kids[first:last + 1]]
        if last > first:
            break
        node = chosen[0]
    return chosen


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


SCHEMA = "host string, part int, wrapper string"


def _entry(name: str, part: int, wrapper: list) -> dict:
    return {"host": name, "part": part, "wrapper": json.dumps(wrapper, separators=(",", ":"))}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pages as one wrapper per host."""
    held: dict[str, list] = {}
    schema = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])

    def out() -> pa.RecordBatch:
        rows = [_entry(h, zlib.crc32(json.dumps(w).encode()) % PARTS, w) for h, w in held.items()]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            wrapper = wrapper_of(parsed(page.as_py()))
            held[name] = merged(held[name], wrapper) if name in held else wrapper
        if len(held) > HOSTS:
            yield out()
    yield out()


def _align_all(rows: pd.DataFrame) -> pd.DataFrame:
    texts = sorted(set(rows["wrapper"]))
    wrapper = json.loads(texts[0])
    for other in texts[1:]:
        wrapper = merged(wrapper, json.loads(other))
    return pd.DataFrame([_entry(rows["host"].iloc[0], 0, wrapper)])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper of every host."""
    by_task = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_fold, SCHEMA)
    by_part = by_task.groupBy("host", "part").applyInPandas(_align_all, SCHEMA)
    return by_part.groupBy("host").applyInPandas(_align_all, SCHEMA).drop("part")


class Slots:
    """What a host's wrapper says about places in its pages."""

    def __init__(self, wrapper: str):
        self.root = json.loads(wrapper)
        self.main = {id(n) for n in main_nodes(self.root)}

    def child(self, kids: list, place: int, symbol: str) -> tuple[list | None, int]:
        """The wrapper's child that matches ``symbol`` at or behind ``place``, and the place to go on from."""
        for at in range(place, len(kids)):
            node, _, repeated = kids[at]
            inner = next((k[0] for k in node[1] if _symbol(k[0]) == symbol), None) if node[0] == "R" else None
            if inner is not None or _symbol(node) == symbol:
                return inner or node, at + (not repeated)
        return None, place


@lru_cache(maxsize=256)
def _slots(wrapper: str) -> Slots:
    return Slots(wrapper)


def main_text(page: str | None, slots: Slots | None) -> str:
    """The blocks of a page's main part, two line ends between them."""
    return "\n\n".join(counted(parsed(page), slots))


def counted(root: Element, slots: Slots | None) -> list[str]:
    """The texts that count, in order; without a wrapper, by the page alone. Where none does, a class or id that does not
    tell surely is not followed, and then all of the body counts."""
    if not root.main and slots and slots.main and (found := _blocks(root, slots, PART, False)):
        return found
    marked = MARKED if root.main else BODY
    return _blocks(root, slots, marked, False) or _blocks(root, slots, marked, True) or _blocks(root, slots, BODY, True)


#: Where texts count: in the part that the page marks, in the wrapper's main part, or in the whole body.
MARKED, PART, BODY = "marked", "part", "body"


def _blocks(root: Element, slots: Slots | None, where: str, trusting: bool) -> list[str]:
    blocks: list[str] = []
    # Of each open element: children to come, its node, the place in the node's children, whether in a marked part, and
    # whether in the part that counts.
    walk: list[list] = [[iter(root.kids), slots.root if slots else None, 0, False, where == BODY]]
    while walk:
        kids, node, place, marked, inside = walk[-1]
        kid = next(kids, None)
        if kid is None:
            walk.pop()
            continue
        is_text = not isinstance(kid, Element)
        found = None
        if not is_text and len(walk) >= DEEP:
            found = node
        elif node is not None and node[0] == "E":
            found, walk[-1][2] = slots.child(node[2], place, "#" if is_text else f"<{kid.tag}>")
        if is_text:
            template = found is not None and len(found[3]) >= ENOUGH and found[1] == _digest(kid[0])
            if marked or inside and not template:
                blocks.append(kid[0])
            continue
        if kid.mark == "drop" and not (trusting and kid.doubt) or kid.mark == "header" and not (marked and kid.heading):
            continue
        if where != MARKED and not marked and kid.texts > 1 and kid.texts == kid.linked:  # a list of links
            continue
        walk.append([
            iter(kid.kids), found, 0, marked or kid.mark == "main",
            inside or where == PART and found is not None and id(found) in slots.main,
        ])
    return blocks


def _texts(element: Element) -> Iterator[tuple[str, bool]]:
    walk = [iter(element.kids)]
    while walk:
        kid = next(walk[-1], None)
        if kid is None:
            walk.pop()
        elif isinstance(kid, Element):
            walk.append(iter(kid.kids))
        else:
            yield kid


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    wrappers = materialize(infer_wrappers(pages), "wrappers")

    @F.arrow_udf("string")
    def text(htmls: pa.Array, found: pa.Array) -> pa.Array:
        slots = (_slots(w.as_py()) if w.is_valid else None for w in found)
        return pa.array([main_text(page.as_py(), s) for page, s in zip(htmls, slots, strict=True)], pa.string())

    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(wrappers, "host", "left")
    return joined.select("page_id", "url", text("html", "wrapper").alias("text"))
