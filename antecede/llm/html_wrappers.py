"""Main text of web pages by wrappers that are inferred from the pages of a host (operator 5).

A page is a stream of tags and texts, nested into elements. A wrapper is a union-free regular expression
over such streams: elements, texts, optional groups ``?`` and repeated groups ``+``. Within a page,
neighbouring groups with the same tags are folded into a repeated group. Page by page the streams of one host
are aligned with its wrapper: what matches is merged, a mismatch of tags becomes a repeated group where it continues
the one before it, else an optional group; texts that are unlike become a slot, those that ``LEAST_PAGES`` pages and half of a slot's pages share are part of
the template. A slot knows how many texts met in it, their characters, and how many of these are links. Every page of the host takes part. Tasks infer
wrappers for their own pages and send one wrapper a host, which are aligned in the same way; so a host of any size
costs one task no more than one wrapper from each other task. Lists of more than ``MOST_ITEMS`` unlike items become one repeated group of
optional ones, so a wrapper's size is bounded by the kinds of elements: their tags, the known names, one of ``NAMES`` classes of their first
own name, and for nameless containers whether they hold links, prose, plain text or other containers.

The wrapper decides (``decide``): the main element is found from the page down, into the container that holds at least ``SHARE`` of the prose
(characters in slots, without links), an article, main or content element counting twice; the way ends at an article, and where a heading would be left
behind. A page is then read along its host's wrapper: its texts in the main element's slots are the main text. Template texts go
where they are a small part beside the slots (else many pages are copies), and so do lists of links in containers outside articles. Tags and names only settle the rest: menus, headers,
footers, sidebars, adverts, forms and comments by their tags and by names in ``_OUTSIDE`` go; an element with a name in ``_WEAK`` (``related``, ``share``, ``alert``)
stays if its slots hold prose. Pages without the host's main element are read by the wrapper of their own.

Definitions: a null or empty page has an empty text; null urls share one wrapper. Blocks are the texts between
block-level tags; white space in them (Unicode's, after decoding references) becomes one space, they are
trimmed and joined by two newlines, empty ones left out. A page header's elements go, but those inside the article
stay. Repeated pages count as one page each. Other columns are kept, but for ``text`` and ``n_chars``, which are replaced. A class, id or role names an element outside the text by what it is (``sidebar``), not by what it has (``has-sidebar``); html,
body, main, article and elements whose whole class, id or role is a content name are never outside by it. Elements nested deeper than ``DEEPEST`` count as part of their ancestor. Unclosed scripts and comments
reach to the end of the page.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antecede.llm.common import rows_of, stored, whole

DEEPEST = 150
#: Pages from which on a text that all of them have is part of the template.
LEAST_PAGES = 5
#: Share of an element's prose that leads on to a child; share of links from which on texts are a list of links.
SHARE, LINKS = 0.5, 0.6
#: Template texts of the main element, as a share of its prose, up to which they go; beyond it they come from copies of pages.
TEMPLATE = 0.25
#: Characters of a text that is prose, on average.
PROSE = 40
#: Items of one element in a wrapper, and pairs of items that are compared one by one.
MOST_ITEMS, MOST_PAIRS = 300, 250_000
#: Classes of own names of elements: elements of unlike classes do not match.
NAMES = 64
#: Texts of a slot that are counted at least.
HELD = 64
#: Hosts whose wrappers a task holds before it sends them on.
MOST_HOSTS = 2_000
#: Characters of all wrappers together up to which they are sent to every task; beyond it pages are joined to theirs.
BROADCAST_CHARS = 16_000_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# HTML's element kinds, and the usual names of what surrounds an article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("head nav footer aside form button dialog menu fieldset".split()) | _RAW
_ROOTS = ("article", "main")
_OUTSIDE = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal "
    "comment comments disqus reply replies respond subscribe newsletter signup login form breadcrumb breadcrumbs pagination pager toolbar contentinfo complementary".split()
)
_WEAK = frozenset("promo promotion notice notices banner share sharing social related recommended widget search alert".split())
_INSIDE = frozenset("article content post entry story main".split())
#: In a name like ``has-sidebar`` or ``comments-open``: it says what the element has, not what it is.
_HAS = frozenset("has have no non with without show hide open opened closed enabled disabled layout".split())
#: Elements that the way to the main element leads through.
_CONTAINERS = frozenset("html body main article section div center table tbody tr td ul ol dl".split())
_NAMELESS = frozenset("div section center td".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
_NEVER_OUTSIDE = frozenset("html body main article".split())
_CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_SCOPES = frozenset("ul ol table dl article section div main body html td th".split())

#: An element: [label, children]; a child is an element or a ``Text``.
Element = list


class Text:
    """The texts between two block tags, and how many of their characters are in links."""

    __slots__ = ("links", "parts")

    def __init__(self):
        self.parts, self.links = [], 0

    def words(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(whole(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _label(name: str, attributes: str) -> str:
    if not attributes:
        return name
    outside, inside, root, own_name = set(), set(), name in _NEVER_OUTSIDE, ""
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for token in (a or b or c).lower().split():
            own_name = own_name or token.strip("0123456789-_")
            own = set(re.split("[^a-z0-9]+", token))
            if not own & _HAS:
                outside |= own & (_OUTSIDE | _WEAK)
                inside |= own & _INSIDE
                root |= token in _INSIDE
    return ".".join([name, *sorted(inside if root else inside | outside), *([f"~{zlib.crc32(own_name.encode()) % NAMES}"] if own_name else [])])


def _kinds(element: Element) -> tuple[int, int]:
    """Characters and characters in links of an element; nameless containers get the kind of what they hold as a further word of their label."""
    chars = links = 0
    texts = inner = blocks = False
    for child in element[1]:
        if isinstance(child, Text):
            n, k, texts = sum(map(len, child.parts)), child.links, True
        else:
            n, k = _kinds(child)
            inner, blocks = True, blocks or child[0].split(".")[0] in _BLOCKS
        chars, links = chars + n, links + k
    if element[0] in _NAMELESS:
        element[0] += ".:links" if links > LINKS * chars else ".:prose" if blocks else ".:text" if texts and not inner else ".:box"
    return chars, links


def parse(page: str) -> Element:
    """The page's elements; inline tags are left out, their texts joined to what is around them."""
    root: Element = ["#page", []]
    stack, names = [root], ["#page"]
    at, n = 0, len(page)

    in_link = False

    def text(part: str) -> None:
        if part:
            children = stack[-1][1]
            if not children or not isinstance(children[-1], Text):
                children.append(Text())
            children[-1].parts.append(part)
            if in_link:
                children[-1].links += len("".join(part.split()))

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:n])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[2] is None and not m[0].endswith(">"):
            break  # a tag that the page's end cuts off
        if m[1] or m[4]:
            if name in names and name not in _INLINE:
                k = len(names) - 1 - names[::-1].index(name)
                del names[k:], stack[k:]
            in_link &= name in _INLINE and name != "a"
            continue
        if name in _INLINE:
            in_link |= name == "a"
            if name in ("br", "img"):
                text(" ")
            continue
        for k in range(len(names) - 1, 0, -1):
            if name in _CLOSES.get(names[k], ()):
                del names[k:], stack[k:]
                break
            if names[k] in _SCOPES:
                break
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            stack[-1][1].append([name, []])
            continue
        own: Element = [_label(name, m[3] or m[6] or ""), []]
        stack[-1][1].append(own)
        if name not in _VOID and len(stack) <= DEEPEST:
            stack.append(own)
            names.append(name)
    _kinds(root)
    return root


# Wrapper items: ["e", label, items], ["?", items], ["+", items], and texts: ["t", {mark of a text: [pages, characters]}, texts, characters,
# characters in links, pages]; of a slot's texts only the HELD most frequent ones are counted.


def key(item: list) -> str:
    """What an item matches by: its own tag, or those of the group in it."""
    return item[1] if item[0] == "e" else "#" if item[0] == "t" else " ".join(map(key, item[1]))


def fold(items: list) -> list:
    """Neighbouring groups of up to three items with the same keys become one repeated group."""
    for period in (1, 2, 3):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 and period == 1 and key(out[-2]) == key(out[-1]) and key(item) != "#":
                b, a = out.pop(), out.pop()
                both = ["+", align(_body(a), _body(b))]
                out.append(["?", [both]] if a[0] == b[0] == "?" else both)
            if period > 1 and len(out) >= 2 * period and [key(x) for x in out[-period:]] == [key(x) for x in out[-2 * period : -period]]:
                b = out[-period:]
                del out[-period:]
                a = out[-period:]
                del out[-period:]
                out.append(["+", align(a, b)])
            elif period > 1 and len(out) > period and out[-period - 1][0] == "+" and key(out[-period - 1]) == " ".join(key(x) for x in out[-period:]):
                b = out[-period:]
                del out[-period:]
                out[-1] = ["+", align(out[-1][1], b)]
        items = out
    return _any_order(items) if len(items) > MOST_ITEMS else items


def _any_order(items: list) -> list:
    """One repeated group with an optional item for each tag: it matches the items in any order."""
    kinds: dict[str, list] = {}

    def add(x: list) -> None:
        if x[0] in "?+":
            for y in x[1]:
                add(y)
        else:
            kinds[key(x)] = _merge(kinds[key(x)], x) if key(x) in kinds else x

    for item in items:
        add(item)
    return [["+", [["?", [x]] for x in kinds.values()]]]


def _body(item: list) -> list:
    return item[1] if item[0] in "?+" else [item]


def _merge(a: list, b: list) -> list:
    kinds = {a[0], b[0]}
    if kinds == {"t"}:
        marks = {k: list(v) for k, v in a[1].items()}
        for k, (n, size) in b[1].items():
            marks[k] = [marks[k][0] + n, size] if k in marks else [n, size]
        if len(marks) > 2 * HELD:
            marks = dict(sorted(marks.items(), key=lambda x: (-x[1][0], x[0]))[:HELD])
        return ["t", marks, *(x + y for x, y in zip(a[2:], b[2:], strict=True))]
    if kinds == {"e"}:
        return ["e", a[1], align(a[2], b[2])]
    inner = align(_body(a), _body(b))
    return ["+" if "+" in kinds and "?" not in kinds else "?", inner if "+" not in kinds or "?" not in kinds else [["+", inner]]]


def _pairs(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys in both, in order: a longest common subsequence, or for very long lists the next equal key from where the last pair was."""
    start = 0
    while start < min(len(ka), len(kb)) and ka[start] == kb[start]:
        start += 1
    end = 0
    while end < min(len(ka), len(kb)) - start and ka[-1 - end] == kb[-1 - end]:
        end += 1
    out = [(i, i) for i in range(start)]
    a, b = ka[start : len(ka) - end], kb[start : len(kb) - end]
    n, m = len(a), len(b)
    if n * m > MOST_PAIRS:
        places: dict[str, list[int]] = {}
        for j, k in enumerate(b):
            places.setdefault(k, []).append(j)
        j = 0
        for i, k in enumerate(a):
            own = places.get(k, ())
            at = bisect_left(own, j)
            if at < len(own) and own[at] - j <= max(16, m - n):
                out.append((start + i, start + own[at]))
                j = own[at] + 1
    elif n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if a[i] == b[j]:
                out.append((start + i, start + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(ka) - k, len(kb) - k) for k in range(end, 0, -1)]


def align(a: list, b: list) -> list:
    """One sequence that matches all that ``a`` and ``b`` match."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list = []
    i = j = 0
    for x, y in [*_pairs(ka, kb), (len(a), len(b))]:
        out += [item if item[0] == "?" else ["?", [item]] for item in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def _mark_of(words: str) -> str:
    return hashlib.blake2b(words.encode(errors="replace"), digest_size=6).hexdigest()


def _items(element: Element) -> list:
    items = []
    for child in element[1]:
        if isinstance(child, Text):
            if words := child.words():
                own = ["t", {_mark_of(words): [1, len(words)]}, 1, len(words), min(child.links, len(words)), 1]
                if items and items[-1][0] == "t":
                    own = _merge(items.pop(), own)
                items.append(own)
        elif child[0].split(".")[0] not in _RAW:
            items.append(["e", child[0], _items(child)])
    return fold(items)


def _once(items: list) -> list:
    """A page counts once for each slot and text, however often they repeat on it."""
    for item in items:
        if item[0] == "t":
            item[5] = 1
            for of in item[1].values():
                of[0] = 1
        else:
            _once(item[-1])
    return items


def expression(element: Element) -> list:
    """The wrapper of one page."""
    return _once(_items(element))


def templates(item: list) -> dict[str, list[int]]:
    """Texts of a slot that at least ``LEAST_PAGES`` pages and half of its pages have."""
    return {k: of for k, of in item[1].items() if of[0] >= max(LEAST_PAGES, item[5] / 2)}


def _is_root(label: str) -> bool:
    name, *words = label.split(".")
    return name in _ROOTS or bool(_INSIDE.intersection(words))


def _outside(label: str, in_article: bool) -> bool:
    name, *words = label.split(".")
    return name in _SKIP or bool(_OUTSIDE.intersection(words)) or (name == "header" and not in_article)


class Wrapper:
    """A host's wrapper with what ``decide`` has found: the main element, and the items that are no main text."""

    def __init__(self, items: list):
        self.items = items
        self._flat: dict[int, tuple[dict[str, list[int]], list[list]]] = {}
        self.dropped: set[int] = set()
        self.templates: dict[int, frozenset[str]] = {}
        self.main: list = ["e", "#page", items]
        #: Whether the template holds more than the slots do: then the pages are copies, and nothing can be told from it.
        self.copies = False
        prose, constant, _, _ = self.sums(self.main)
        self.copies = constant >= prose
        self.decide()

    def sums(self, item: list) -> tuple[int, int, int, int]:
        """Characters in slots without links, in template texts, in links, and the number of texts; none of what is outside by its names."""
        if item[0] == "t":
            constant = 0 if self.copies else min(item[3] - item[4], sum(n * size for n, size in templates(item).values()))
            return item[3] - item[4] - constant, constant, item[4], item[2]
        if item[0] == "e" and _outside(item[1], False):
            return 0, 0, 0, 0
        found = [self.sums(x) for x in (item[2] if item[0] == "e" else item[1])]
        return tuple(map(sum, zip(*found, strict=True))) if found else (0, 0, 0, 0)

    @staticmethod
    def children(items: list) -> Iterator[list]:
        """Elements and texts of a list of items, through its groups."""
        for item in items:
            if item[0] in "?+":
                yield from Wrapper.children(item[1])
            else:
                yield item

    def has_heading(self, item: list) -> bool:
        return item[0] == "e" and (item[1].split(".")[0] in ("h1", "h2") or (item[1].split(".")[0] in ("header", "div", "section") and any(map(self.has_heading, self.children(item[2])))))

    def decide(self) -> None:
        at, in_article = self.main, False
        while not in_article:
            inner = [x for x in self.children(at[2]) if x[0] == "e" and not _outside(x[1], False)]
            prose = {id(x): self.sums(x)[0] for x in inner}
            total = self.sums(at)[0]
            inner = [x for x in inner if x[1].split(".")[0] in _CONTAINERS and prose[id(x)] > 0]
            best = max(inner, key=lambda x: prose[id(x)] * (2 if _is_root(x[1]) else 1), default=None)
            if best is None or prose[id(best)] * (2 if _is_root(best[1]) else 1) < SHARE * total:
                break
            left = [x for x in inner if x is not best] + [x for x in self.children(at[2]) if x[0] == "e" and x[1].split(".")[0] in ("h1", "h2", "header")]
            if not _is_root(best[1]) and any(map(self.has_heading, left)):
                break
            at = best
            in_article = at[1].split(".")[0] == "article"
        self.main = at
        prose, constant, _, _ = self.sums(at)
        self._mark(at[2], not self.copies and constant <= TEMPLATE * prose, _is_root(at[1]))

    def _mark(self, items: list, template_goes: bool, in_article: bool) -> None:
        for item in self.children(items):
            if item[0] == "t":
                if template_goes and (found := templates(item)):
                    self.templates[id(item)] = frozenset(found)
                continue
            name, *words = item[1].split(".")
            prose, constant, links, texts = self.sums(item)
            if _WEAK.intersection(words) and (prose <= constant or links > LINKS * (prose + links) or prose < PROSE * texts) or (
                not in_article and name in _CONTAINERS and texts >= 3 and links > LINKS * (prose + constant + links)
            ):
                self.dropped.add(id(item))
            else:
                self._mark(item[2], template_goes, in_article)

    def flat(self, items: list) -> tuple[dict[str, list[int]], list[list]]:
        if id(items) not in self._flat:
            found = list(self.children(items))
            places: dict[str, list[int]] = {}
            for k, item in enumerate(found):
                places.setdefault(key(item), []).append(k)
            self._flat[id(items)] = places, found
        return self._flat[id(items)]

    def matched(self, children: list, items: list) -> Iterator[tuple[Element | Text, list | None]]:
        """Each child with the item that it matches: the next one of its kind, else the first."""
        places, found = self.flat(items)
        at = 0
        for child in children:
            own = places.get("#" if isinstance(child, Text) else child[0])
            if own is None:
                yield child, None
            else:
                k = bisect_left(own, at)
                at = own[k] if k < len(own) else own[0]
                yield child, found[at]


def _read(wrapper: Wrapper, children: list, items: list, in_main: bool, in_article: bool, blocks: list[str]) -> bool:
    """Adds the texts of the main element's slots to ``blocks``; whether the main element was met."""
    met = False
    for child, item in wrapper.matched(children, items):
        if item is not None and id(item) in wrapper.dropped:
            continue
        if isinstance(child, Text):
            if in_main and (words := child.words()) and not ((known := wrapper.templates.get(id(item))) and _mark_of(words) in known):
                blocks.append(words)
        elif not _outside(child[0], in_article):
            here = in_main or item is wrapper.main
            met |= here
            met |= _read(wrapper, child[1], item[2] if item else [], here, in_article or (here and _is_root(child[0])), blocks)
    return met


def main_text(page: str, wrapper: Wrapper | None) -> str:
    """The texts of the page in its host's main element; of a page without it, by a wrapper of its own."""
    tree = parse(page)
    for own in (wrapper, None):
        own = own or Wrapper(expression(tree))
        blocks: list[str] = []
        whole_page = own.main[1] == "#page"
        if _read(own, tree[1], own.items, whole_page, False, blocks) or whole_page:
            return "\n\n".join(blocks)
    return ""


def infer(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """``host, wrapper``: one wrapper (JSON) a host, from all its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(map(json.dumps, found.values()), pa.string())], ["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), rows_of(batch.column(1)), strict=True):
                own = expression(parse(page))
                found[name] = align(found[name], own) if name in found else own
                if len(found) > MOST_HOSTS:
                    yield sent()
        yield sent()

    def merge(group: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole_ = None
        for part in parts:
            for x in sorted(part.column("wrapper").to_pylist()):
                whole_ = json.loads(x) if whole_ is None else align(whole_, json.loads(x))
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.string()), pa.array([json.dumps(whole_)], pa.string())], ["host", "wrapper"])

    parts = pages.select(host.alias("host"), whole(html_col).alias("html")).mapInArrow(partial, "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(merge, "host string, wrapper string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """All columns of ``pages`` but the html, and ``text``, ``n_chars`` (which replace columns of these names)."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    host = host_of(url_col)
    wrappers = stored(infer(pages, host, html_col), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    few = size <= broadcast_chars
    sent = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.toLocalIterator()}) if few else None
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("_host"), whole(html_col).alias("_html"))
    if not few:
        rows = rows.join(wrappers.withColumnsRenamed({"host": "_of", "wrapper": "_wrapper"}), F.col("_host") == F.col("_of"), "left").drop("_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ready = len(keep), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                hosts = part.column(at).to_pylist()
                theirs = [sent.value.get(h) for h in hosts] if few else part.column(at + 2).to_pylist()
                texts = []
                for h, page, own in zip(hosts, part.column(at + 1).to_pylist(), theirs, strict=True):
                    if h not in ready:
                        if len(ready) >= MOST_HOSTS:
                            ready.clear()
                        ready[h] = Wrapper(json.loads(own)) if own else None
                    texts.append(main_text(page, ready[h]))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars bigint"]))
