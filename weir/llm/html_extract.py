"""Main text of web pages by union-free wrappers inferred from the pages of a host.

A page is a stream of tokens: tags of blocks, and runs of text between them. What recurs side by side in it is folded into
repeated elements, and into repeated groups of several (a heading and a paragraph, say). The streams of one host are
then aligned one after another, element by element and in order: where they don't match, what only one side has becomes
optional, and where that makes neighbours alike, repeated; where texts differ, the text becomes a slot. The result is a
union-free regular expression. An element whose expression outgrows WIDTH items keeps one repeated item for each tag.
Streams are aligned first within a task, then in salted groups of a host, in three steps; a host with a third of all pages is
many small tasks, and what is shuffled is wrappers.

Extraction lays a page over its host's wrapper. Elements that say what they are (navigation, footers, asides,
forms, scripts, comments and the like) go. If an element declares itself the article, its text stays, but for what
stands on the host's pages word for word at the same place, titles and paragraphs excepted, as long as the
host's articles otherwise differ. On pages without such an element the wrapper decides: from the page down to the part in
which all the prose stands (text in paragraphs and headings that differs from page to page), leaving out lists of links,
fixed texts, and, beside prose, blocks of bare text. No part is left out because its share of the text is small.

A null html counts as empty. Broken markup (unclosed, crossing or stray tags, a page cut off anywhere) is read
as far as it goes; end tags without a start are ignored; an attribute's quote that is never closed is part of its value. Elements
nested deeper than DEPTH are read as if they stood at that depth, as browsers do. A page whose url has no host is laid
over its own wrapper only, as are pages of hosts with fewer than SEEN pages.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import small_batches, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split()
)
#: A start tag ends these open elements, up to the nearest element of the second set.
CLOSES = {
    **{t: (frozenset(["p"]), frozenset("td th li body article section div button caption table".split())) for t in BLOCK - {"li", "dd", "dt", "tr", "td", "th", "option", "body", "html"}},
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu dir table".split())),
    "dd": (frozenset(["dd", "dt", "p"]), frozenset(["dl", "table"])),
    "dt": (frozenset(["dd", "dt", "p"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas audio video button select textarea input label fieldset dialog menu head title noframes noembed map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note status tooltip".split())
#: Names of classes and ids. The first kind is noise anywhere; the second only outside an article; the third says
#: nothing, so that it may stand beside either in compound names.
_NOISE = re.compile(
    r"nav\w*|menus?|submenu|sidebars?|footers?|mastheads?|topbar|breadcrumbs?|crumbs?|ads?|adv|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo\w*|banners?|cookies?|consent|gdpr|notices?|notifications?|popups?|modals?|newsletters?|subscri\w+|signup|login|paywall|share|sharing|social|comments?|commentlist|replies|respond|disqus|pagination|pager|toolbar"
)
_OUTER = re.compile(r"side|rail|foot|alerts?|pop|overlay|register|reply|discussion|responses|related|recommend\w*|widgets?|search\w*|skip|copyright|legal|disclaimer|tags|tagcloud|rating|feedback|forms?|aside|hidden")
_FILLER = frozenset("site page main top bottom left right box block list bar container wrapper wrap section area inner outer global primary secondary item items group links link buttons button icons icon header head title text content body unit slot post posts article articles entry story blog mobile desktop sticky fixed form count inline js the my".split())
_HEADER = re.compile(r"^(?:headers?|page-?header|site-?header)$")
_MAIN = re.compile(r"^(?:article-?(?:body|content|text)?|post-?(?:body|content|text|entry)?|entry-?(?:content|body|text)?|main-?(?:content|text)?|content-?(?:body|main)?|story-?(?:body|content)?|body-?(?:text|content|copy)|text-?(?:body|content)|page-?content)$")
#: A quote counts only where a value begins.
_ATTRIBUTE = r"=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]++)?+)?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[\s/=]|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
#: Elements of prose, and those that may hold text without it beside prose.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
GENERIC = frozenset("div section article main center body".split())
TEXTUAL = PROSE | frozenset("ul ol dl table figure section article address details".split())
#: Pages on which a text must be the same to be a host's, and levels of nesting that are told apart.
SEEN, DEPTH = 3, 128


@dataclass
class Node:
    """An element; children are nodes and (raw) texts."""

    tag: str
    names: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)

    @property
    def shape(self) -> str:
        return ".".join((self.tag, *self.names))


def _element(tag: str, attributes: str) -> Node:
    names, role, hidden = [], "", False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names += [v.lower() for v in value.split() if not any(c.isdigit() for c in v)]
        elif key == "role":
            role = value.strip().lower()
        elif key == "itemprop" and value.strip().lower() == "articlebody":
            names.append("article-body")
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return Node(tag, tuple(sorted(set(names))), role, hidden)


def parse(html: str | None) -> Node:
    """The page as a tree, with the ends that HTML lets authors leave out."""
    html = html or ""
    root = Node("#page")
    stack, at = [root], 0
    deeper: Counter[str] = Counter()  # open elements beyond DEPTH, which have no place on the stack
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not m:
            return root
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].children.append(m[0][9:].removesuffix("]]>"))
        elif m[1]:
            tag = m[1].lower()
            if deeper[tag]:
                deeper[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag doesn't close blocks
            else:
                if tag == "p":  # a stray one still ends what came before
                    stack[-1].children.append(Node("p"))
        elif m[2]:
            tag = m[2].lower()
            closes, until = CLOSES.get(tag, (frozenset(), frozenset()))
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        del stack[k:]
                    elif stack[k].tag in until:
                        break
            node = _element(tag, m[3] or "")
            stack[-1].children.append(node)
            if tag in RAW and not m[0].endswith("/>"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                raw = html[at : end.start() if end else len(html)]
                node.children.append(raw)
                at = end.end() if end else len(html)
            elif tag not in VOID and len(stack) <= DEPTH:
                stack.append(node)
            elif tag not in VOID:
                deeper[tag] += 1


def _declares(node: Node) -> bool:
    return node.tag == "article" or any(_MAIN.match(n) for n in node.names)


def _opens(node: Node) -> bool:
    """Whether what stands inside is an article's."""
    return _declares(node) or node.tag == "main" or node.role == "main"


def _noisy(name: str, in_main: bool) -> bool:
    """Whether a class or id names noise: all of its parts do, or say nothing."""
    known = [True if _NOISE.fullmatch(part) or not in_main and _OUTER.fullmatch(part) else None if part in _FILLER else False for part in re.split(r"[-_]+", name) if part]
    return True in known and False not in known


def _noise(node: Node, in_main: bool) -> bool:
    if node.tag in DROPPED or node.role in ROLES or node.hidden:
        return True
    if node.tag in ("html", "body", "main", "#page"):
        return False
    if any(_noisy(n, in_main) for n in node.names):
        return not (node.tag in ("article", "p") and any(_MAIN.match(n) for n in node.names))
    if node.tag == "header" or any(_HEADER.match(n) for n in node.names):
        return not in_main
    return False


# The page as blocks: a Block's items are blocks and runs, in page order. A run is text between block tags, with
# the inline elements in it: (text, its characters outside links, and inside, none of them white space).


@dataclass
class Block:
    node: Node
    items: list = field(default_factory=list)
    shape: str = ""
    plain: int = 0
    linked: int = 0
    prose: bool = False

    def close(self) -> None:
        """Once its items are there: what they hold, and the shape, to which elements that say little about themselves add that."""
        for i in self.items:
            if isinstance(i, Block):
                self.plain, self.linked = self.plain + i.plain, self.linked + i.linked
                self.prose = self.prose or i.prose or i.node.tag in PROSE and bool(i.items)
            else:
                self.plain, self.linked = self.plain + i[1], self.linked + i[2]
        self.shape = self.node.shape
        if self.node.tag in GENERIC:
            self.shape += ":prose" if self.prose else ":links" if self.linked > self.plain else ":text" if self.plain else ":nothing"


def blocks_of(root: Node, inside: bool = False) -> Block:
    """The blocks of an element, without what declares itself noise. An inline element that holds blocks is transparent."""
    top = Block(root)
    parts: list[tuple[str, bool]] = []

    def flush(into: Block) -> None:
        words = "".join([t for t, _ in parts]).split()
        if words:
            linked = sum(len(w) for t, a in parts if a for w in t.split())
            into.items.append((" ".join(words), sum(map(len, words)) - linked, linked))
        parts.clear()

    def walk(n: Node, into: Block, link: bool, within: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append((c, link))
            elif c.tag == "br":
                parts.append((" ", link))
            elif _noise(c, within):
                if c.tag in BLOCK:
                    flush(into)
            elif c.tag in BLOCK:
                flush(into)
                own = Block(c)
                into.items.append(own)
                walk(c, own, link, within or _opens(c))
                flush(own)
                own.close()
            else:
                walk(c, into, link or c.tag == "a", within or _opens(c))

    walk(root, top, False, inside)
    flush(top)
    top.close()
    return top


# A wrapper is an expression over the tokens of a host's pages, as a list of items in order:
#   [key, pages, many, text, plain, linked, items]
#   key     an element's shape, '#' for a run of text, '()' for a group of several elements that repeats
#   pages   pages of the host that have it; where that is fewer than the parent's, it is optional
#   many    repeated
#   text    of a run: a digest while all pages agree (of a repeated element's runs, of all of a page's), 0 (a slot) once they differ
#   plain, linked   characters of a run outside links, and inside, over all pages
#   items   what stands between the element's tags, or in a group
KEY, PAGES, MANY, TEXT, PLAIN, LINKED, ITEMS = range(7)
#: Longest group of elements that is looked for, and items of one element before names are left out of shapes.
GROUP, WIDTH = 4, 48


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).hexdigest()


def wrapper_of(block: Block) -> list:
    """The wrapper of one page: its tokens, with what recurs side by side folded into repeated elements and groups."""
    items = []
    for part in block.items:
        if isinstance(part, Block):
            items.append(wrapper_of(part))
        else:
            items.append(["#", 1, False, _digest(part[0]), part[1], part[2], []])
    return [block.shape, 1, False, None, 0, 0, _folded(items)]


def _key(item: list) -> str:
    return item[KEY] if item[KEY] != "()" else "(" + " ".join(_key(i) for i in item[ITEMS]) + ")"


def _merge(a: list, b: list, pages: bool = True) -> None:
    """Take b into a, both of the same key; pages: they stand on different pages, not on one."""
    a[PAGES] = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    a[MANY] = a[MANY] or b[MANY]
    if a[KEY] == "#":
        a[TEXT] = 0 if 0 in (a[TEXT], b[TEXT]) else _digest(a[TEXT] + b[TEXT]) if not pages else a[TEXT] if a[TEXT] == b[TEXT] else 0
        a[PLAIN], a[LINKED] = a[PLAIN] + b[PLAIN], a[LINKED] + b[LINKED]
    a[ITEMS] = _aligned(a[ITEMS], b[ITEMS], pages)


def _folded(items: list) -> list:
    """Neighbours of one key become a repeated element, recurring runs of up to GROUP elements a repeated group."""
    if len(items) > WIDTH:  # names that differ from page to page would grow without end
        for i in items:
            i[KEY] = _tag(i[KEY])
    for size in range(1, GROUP + 1):
        keys, out, k = [_key(i) for i in items], [], 0
        while k < len(items):
            run = keys[k : k + size]
            if len(run) < size or keys[k + size : k + 2 * size] != run or (size == 1 and not _alike(items[k], items[k + 1])) or (size > 1 and (len(set(run)) == 1 or "#" in run)):
                out.append(items[k])
                k += 1
                continue
            group = items[k] if size == 1 else ["()", max(i[PAGES] for i in items[k : k + size]), True, None, 0, 0, items[k : k + size]]
            k += size
            while keys[k : k + size] == run and (size > 1 or _alike(group, items[k])):
                _merge(group, items[k] if size == 1 else ["()", 1, True, None, 0, 0, items[k : k + size]], False)
                k += size
            group[MANY] = True
            out.append(group)
        items = out
    if len(items) <= WIDTH:
        return items
    kept: dict[str, list] = {}
    for i in items:
        for one in i[ITEMS] if i[KEY] == "()" else [i]:
            if one[KEY] in kept:
                _merge(kept[one[KEY]], one, False)
            kept.setdefault(one[KEY], one)[MANY] = True
    return list(kept.values())


def _tag(key: str) -> str:
    return re.split("[.:]", key, maxsplit=1)[0]


def _alike(a: list, b: list) -> bool:
    """Whether two elements of one shape may be one that repeats: of those that say little about themselves, if they hold the same."""
    if _tag(a[KEY]) not in GENERIC:
        return True
    x, y = ({_key(i) for i in w[ITEMS]} for w in (a, b))
    return 3 * len(x & y) >= 2 * len(x | y)


def _grouped(items: list, groups: list) -> list:
    """Where the elements of another page's group stand once here, they are a group too."""
    for g in groups:
        own, size, out, k = [_key(i) for i in g[ITEMS]], len(g[ITEMS]), [], 0
        keys = [_key(i) for i in items]
        while k < len(items):
            if keys[k : k + size] == own:
                out.append(["()", max(i[PAGES] for i in items[k : k + size]), False, None, 0, 0, items[k : k + size]])
                k += size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _aligned(a: list, b: list, pages: bool = True) -> list:
    """Both sequences as one: equal keys are aligned in order, as many as can be, and the rest of either is optional."""
    ga, gb = [i for i in a if i[KEY] == "()"], [i for i in b if i[KEY] == "()"]
    if ga or gb:
        a, b = _grouped(a, gb), _grouped(b, ga)
    ka, kb = [_key(i) for i in a], [_key(i) for i in b]
    if ka == kb:
        for x, y in zip(a, b, strict=True):
            _merge(x, y, pages)
        return a
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if ka[i] == kb[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j]:
            _merge(a[i], b[j], pages)
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return _folded(out + a[i:] + b[j:])


def align(wrappers: list[list]) -> list:
    out = wrappers[0]
    for w in wrappers[1:]:
        _merge(out, w)
    return out


def expression(w: list, pages: int | None = None) -> str:
    """The wrapper as a regular expression: ? optional, + repeated, TEXT fixed text, SLOT text that differs."""
    inner = "".join(expression(i, w[PAGES]) for i in w[ITEMS])
    own = ("SLOT" if w[TEXT] == 0 else "TEXT") if w[KEY] == "#" else inner if w[KEY] == "()" else f"<{w[KEY]}>{inner}</>"
    mark = ("+" if w[MANY] else "") + ("?" if pages and w[PAGES] < pages else "")
    return f"({own}){mark}" if mark else own


def laid(block: Block, w: list | None) -> list:
    """For each of the block's items the item of the wrapper that it is, or None: in order, repeated ones as often as they come."""
    if not w:
        return [None] * len(block.items)
    flat, ahead = [], []
    for i in w[ITEMS]:
        flat += i[ITEMS] if i[KEY] == "()" else [i]
    keys = [i[KEY] for i in flat]
    at = -1
    for part in block.items:
        key = part.shape if isinstance(part, Block) else "#"
        for name in (key, _tag(key)):
            if at >= 0 and keys[at] == name and flat[at][MANY]:
                k = at
            elif name in keys[at + 1 :]:
                k = keys.index(name, at + 1)
            else:
                k = keys.index(name) if name in keys else -1
            if k >= 0:
                break
        ahead.append(flat[k] if k >= 0 else None)
        at = k if k >= 0 else at
    return ahead


def _fixed(run: list, pages: int) -> bool:
    """Whether a run of text is the same on the pages of an element that are many enough, and not a few among them."""
    return isinstance(run[TEXT], str) and run[PAGES] >= SEEN and 2 * run[PAGES] >= pages


def _totals(w: list, inside: str = "", pages: int = 0) -> tuple[int, int, int, int]:
    """Characters of a wrapper's part, over all pages: of prose that differs, of other text that differs, of fixed text, in links.

    Prose is what stands in paragraphs, headings and the like.
    """
    if w[KEY] == "#":
        if _fixed(w, pages):
            return 0, 0, w[PLAIN] + w[LINKED], 0
        return (w[PLAIN], 0, 0, w[LINKED]) if inside in PROSE else (0, w[PLAIN], 0, w[LINKED])
    tag = inside if w[KEY] == "()" else _tag(w[KEY])
    parts = [_totals(i, tag if tag in PROSE or inside not in PROSE else inside, w[PAGES]) for i in w[ITEMS]]
    return tuple(map(sum, zip(*parts, strict=True))) if parts else (0, 0, 0, 0)


def _template(w: list) -> bool:
    """Whether the host's pages have nothing here but fixed texts, or lists of links."""
    prose, other, fixed, linked = _totals(w)
    return w[PAGES] >= SEEN and (fixed > 0 and prose + other + linked == 0) or linked > 9 * (prose + other) and _tag(w[KEY]) not in PROSE


def region(block: Block, w: list) -> tuple[Block, list, bool]:
    """Without a declared article: the element whose parts are the text, its wrapper, and whether some of them hold prose.

    Down from the page, an element is left for its one part with prose, if all others have none (menus,
    adverts and notices of bare text, links, fixed texts).
    """
    while True:
        kids = [(p, i) for p, i in zip(block.items, laid(block, w), strict=True) if isinstance(p, Block)]
        prose = [(p, i or wrapper_of(p)) for p, i in kids if p.node.tag in PROSE or (_totals(i) if i else _totals(wrapper_of(p)))[0] > 0]
        if len(prose) != 1 or prose[0][0].node.tag in PROSE | {"ul", "ol", "dl", "table"}:
            return block, w, bool(prose)
        block, w = prose[0]


def _mains(node: Node) -> list[Node]:
    """The outermost elements that declare themselves the article, in page order; not inside noise."""
    found = []
    for c in node.children:
        if isinstance(c, Node) and not _noise(c, False):
            found += [c] if _declares(c) else _mains(c)
    return found


def _find(block: Block, w: list | None, wanted: Node) -> tuple[Block, list | None] | None:
    """An element among the blocks below, and the wrapper's part for it."""
    if block.node is wanted:
        return block, w
    for part, i in zip(block.items, laid(block, w), strict=True):
        if isinstance(part, Block) and (got := _find(part, i, wanted)) is not None:
            return got
    return None


def _texts(block: Block, w: list | None, out: list[str], fixed: bool) -> None:
    """The runs of text in page order. fixed: those that the host's pages repeat word for word are left out, but for titles and paragraphs."""
    spare = not fixed or block.node.tag in ("p", "h1")
    for part, i in zip(block.items, laid(block, w), strict=True):
        if isinstance(part, Block):
            _texts(part, i, out, fixed)
        elif spare or i is None or not _fixed(i, w[PAGES]):
            out.append(part[0])


def extract(html: str | None, wrapper: list | None = None) -> str:
    """The main text: runs of text in page order, joined by two line ends; empty if there is none. wrapper: the host's."""
    root = parse(html)
    out: list[str] = []
    mains = _mains(root)
    page = blocks_of(root)
    if mains:
        whole = {id(m): blocks_of(m, True) for m in mains}
        texts = [m for m in mains if len(mains) == 1 or whole[id(m)].plain or not whole[id(m)].linked]  # cards that are links lie beside an article
        for m in texts or mains:
            found = _find(page, wrapper, m)
            own = found[1] if found else None
            totals = _totals(own) if own else (0, 0, 0, 0)
            _texts(whole[id(m)], own, out, bool(own) and own[PAGES] >= SEEN and sum(totals[:2]) > totals[2])
        return "\n\n".join(out)
    w = wrapper if wrapper and wrapper[PAGES] >= SEEN else wrapper_of(page)
    block, own, prose = region(page, w)
    totals = _totals(own)
    fixed = own[PAGES] >= SEEN and sum(totals[:2]) > totals[2]
    for part, i in zip(block.items, laid(block, own), strict=True):
        if not isinstance(part, Block):
            kept = not prose and not (fixed and i and _fixed(i, own[PAGES])) or block.node.tag in PROSE
            out += [part[0]] * kept
            continue
        known = i or wrapper_of(part)
        if part.node.tag not in PROSE and (_template(known) or prose and _totals(known)[0] == 0 and part.node.tag not in TEXTUAL):
            continue
        _texts(part, i, out, fixed)
    return "\n\n".join(out)


def _dump(w: list) -> str:
    return json.dumps(w, separators=(",", ":"))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


#: Hosts whose wrappers a task holds before it hands them on; bytes of wrappers that may be broadcast.
HELD, SMALL = 2000, 64_000_000


def wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host, wrapper: the aligned wrapper of all pages of each host."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def hand_on() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([_dump(w) for w in held.values()], pa.string())], ["host", "wrapper"])
            held.clear()
            return got

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = wrapper_of(blocks_of(parse(html)))
                if host in held:
                    _merge(held[host], new)
                else:
                    held[host] = new
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    own = small_batches(pages).select(host_of(F.col("url")).alias("host"), "html").where("host <> ''")
    parts = own.mapInArrow(first, "host string, wrapper string")
    for n in (salts * salts, salts, 1):
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(n))).groupBy("host", "salt").applyInArrow(_joined, "host string, wrapper string")
    return parts


def _joined(table: pa.Table) -> pa.Table:
    """Wrappers of one host aligned: a share of those of the tasks, or no more than there were salts, each a few KB."""
    found = sorted(table.column("wrapper").to_pylist())
    return pa.table({"host": [table.column("host")[0].as_py()], "wrapper": [_dump(align([json.loads(w) for w in found]))]})


def main_text(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page. Repeated and null ids and urls keep their rows; other columns are ignored."""
    found = written(wrappers(pages), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0)).alias("n")).first()["n"]
    found = F.broadcast(found) if size <= small else found
    with_wrapper = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, list | None] = {None: None}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                texts = []
                for html, w in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if w not in known:
                        if len(known) > 500:
                            known = {None: None}
                        known[w] = json.loads(w)
                    texts.append(extract(html, known[w]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_wrapper.mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long")
