"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Scripts, menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, known by tag, role or class, are
taken out.  Every block element that is left, and the text that stands directly
in one, gets its composite density: characters per tag, adjusted by the share of
link characters and link tags.  The core is the block whose own text and child
blocks have the largest sum of densities; of equal ones the outermost, then the
first.  The least density on the path from the core to the body is the threshold.
From the body down, every block that reaches the threshold gives the block of the
largest sum in it to the text, and its child blocks are looked at in turn; a block
below the threshold goes with all that it holds, unless a chosen block holds it.

The text is that of the chosen parts: blocks in page order, references decoded,
white space within a block made one space, blocks joined by an empty line.

Defined cases: a null or empty page, or one without text, gives an empty text;
unclosed and stray tags, comments and cut-off pages are read as far as they go, in
time that is linear in the page's length; repeated pages are extracted each; an
empty table gives no rows; a column named like the result is replaced.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))|\b(hidden)\b""")
_TOKEN = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("table ul ol dl select body html".split())
_DROPPED = frozenset("aside audio button canvas dialog footer form head iframe input math menu nav noscript object script select style svg template textarea title video".split())
_DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_DROPPED_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_KEPT = frozenset("article main body html h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("tag", "parent", "block", "article", "parts", "dropped", "counts", "inline", "density", "loose", "total", "best", "kept", "kept_loose")

    def __init__(self, tag, parent, dropped):
        self.tag, self.parent, self.dropped, self.parts = tag, parent, dropped, []
        self.block = parent.block if tag in _INLINE else self
        self.article = tag in ("article", "main") or parent is not None and parent.article


def _is_dropped(tag, attributes, node):
    if tag in _KEPT:
        return False
    if tag in _DROPPED:
        return True
    if tag == "header":
        return not node.article
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name == "role" and value.lower() in _DROPPED_ROLES:
            return True
        if name in ("class", "id") and any(t.lower() in _DROPPED_NAMES for t in _TOKEN.findall(value)):
            return True
    return False


class _Open:
    """The open elements: which one is innermost, and how many of a tag a search may meet.

    A search for a tag looks first whether there is one, and then closes all that it
    passes, so searches take no longer than the elements that were opened.
    """

    def __init__(self):
        self.node = self.root = _Node("", None, False)
        self.all, self.inline, self.scope = {}, [{}], [{}]

    def push(self, child):
        self.node, tag = child, child.tag
        self.all[tag] = self.all.get(tag, 0) + 1
        if tag in _INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        else:
            self.inline.append({})
        if tag in _SIBLING:
            self.scope[-1][tag] = self.scope[-1].get(tag, 0) + 1
        elif tag in _SCOPE:
            self.scope.append({})

    def pop(self):
        tag = self.node.tag
        self.all[tag] -= 1
        if tag in _INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        if tag in _SIBLING:
            self.scope[-1][tag] -= 1
        elif tag in _SCOPE:
            self.scope.pop()
        self.node = self.node.parent

    def close(self, tags):
        """Closes the innermost element of these tags and all in it."""
        while self.node.tag not in tags:
            self.pop()
        self.pop()

    def end(self, tag):
        """A closing tag: an inline one reaches no further than its block."""
        if (self.inline[-1] if tag in _INLINE else self.all).get(tag):
            self.close((tag,))

    def make_room(self, tag):
        """Closes what an opening tag ends: a paragraph, or a sibling in the same list or table."""
        if tag in _CLOSES_P:
            if self.node.block.tag == "p":
                self.close(("p",))
        elif tag in _SIBLING and any(self.scope[-1].get(t) for t in _SIBLING[tag]):
            self.close(_SIBLING[tag])


def parse(page):
    """The tree of a page; the parts of a node are texts and nodes."""
    opened = _Open()
    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        node = opened.node
        if less > at and not node.dropped:
            node.parts.append(page[at:less])
        if less == size:
            break
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), less):
            end = page.find(">", less)
            at = size if end < 0 else end + 1
            continue
        match = _TAG.match(page, less)
        if match is None:
            if re.match(r"</?[a-zA-Z]", page[less : less + 3]) and page.find(">", less) < 0:
                break  # a tag that the page's end cuts off
            if not node.dropped:
                node.parts.append("<")
            at = less + 1
            continue
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] is not None else (match[4], match[5], match[6])
        tag = tag.lower()
        if closing:
            if tag != "br":
                opened.end(tag)
            elif not node.dropped:
                node.parts.append(" ")
            continue
        opened.make_room(tag)
        node = opened.node
        child = _Node(tag, node, node.dropped or _is_dropped(tag, attributes, node))
        if not node.dropped:
            node.parts.append(child)
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^<>]*+>", re.I).search(page, at)
            at = size if end is None else end.end()
            continue
        if not attributes.endswith("/") or tag in _KEPT:
            opened.push(child)
    return opened.root


def _density(counts, body_share):
    """Composite density of (characters, tags, link characters, link tags)."""
    chars, tags, link_chars, link_tags = counts
    if not chars:
        return 0.0
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_share * chars + math.e)
    ratio = max(1.0, chars / max(1, link_chars) * tags / max(1, link_tags))
    return chars / tags * math.log(ratio) / max(1.0, math.log(base) if base > 1 else 1.0)


def _live(node):
    return (p for p in node.parts if type(p) is _Node and not p.dropped)


def measure(root):
    """Sets density and sums of every block, its own text's density and the best block in it; returns the body."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(_live(node))
    for node in reversed(order):
        counts, inline = [0, 0, 0, 0], [0, 0, 0, 0]
        for part in node.parts:
            if type(part) is str:
                n = len("".join(part.split()))
                counts[0] += n
                inline[0] += n
            elif not part.dropped:
                one = (0, 1, 0, part.tag == "a")
                counts = [a + b + c for a, b, c in zip(counts, part.counts, one)]
                if part.tag in _INLINE:
                    inline = [a + b + c for a, b, c in zip(inline, part.inline, one)]
        if node.tag == "a":
            counts[2], inline[2] = counts[0], inline[0]
        node.counts, node.inline, node.kept, node.kept_loose = counts, inline, False, False
    body = next((n for n in order if n.tag == "body"), root)
    share = body.counts[2] / max(1, body.counts[0])
    for node in reversed(order):
        block = node.tag not in _INLINE
        node.density = _density(node.counts, share) if block else 0.0
        node.loose = _density(node.inline, share) if block else 0.0
        node.total = node.loose + sum(p.density if p.tag not in _INLINE else p.total for p in _live(node))
        node.best = node if block else None
        for part in _live(node):
            if part.best is not None and (node.best is None or part.best.total > node.best.total):
                node.best = part.best
    return body


def _blocks_in(node):
    """The outermost blocks within a node, whatever inline elements stand between, in page order."""
    stack = [_live(node)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        elif part.tag in _INLINE:
            stack.append(_live(part))
        else:
            yield part


def choose(root):
    """Marks the parts of the tree that hold the article; returns the body."""
    body = measure(root)
    core = body.best
    if core.total <= 0:
        body.kept = True
        return body
    threshold, node = body.density, core
    while node is not body:
        threshold = min(threshold, node.density)
        node = node.parent.block
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold:
            node.best.kept = True
            if not node.kept:
                node.kept_loose = node.loose >= threshold
                stack.extend(_blocks_in(node))
    return body


def blocks(node):
    """The texts of the marked blocks below a node, in page order."""
    out, held = [], []

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append(text)
        held.clear()

    stack = [(node, 0, node.kept, node.kept or node.kept_loose)]
    while stack:
        now, k, whole, loose = stack.pop()
        block = now.tag not in _INLINE
        if k == 0 and block:
            flush()
        while k < len(now.parts):
            part = now.parts[k]
            k += 1
            if type(part) is str:
                if loose:
                    held.append(part)
            elif part.tag == "br":
                held.append(" ")
            elif part.tag == "hr":
                flush()
            elif not part.dropped:
                stack.append((now, k, whole, loose))
                inner = whole or part.kept
                stack.append((part, 0, inner, loose if part.tag in _INLINE else inner or part.kept_loose))
                break
        else:
            if block:
                flush()
    flush()
    return out


def main_text(page):
    return "\n\n".join(blocks(choose(parse(page)))) if page else ""


def extract(pages: DataFrame, page_html: str = "html", name: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (default: all others) and the main text of each page."""
    columns = [c for c in (pages.columns if carry is None else carry) if c not in (page_html, name)]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(page_html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, name])

    return pages.select(*columns, page_html).mapInArrow(run, pages.select(*columns).schema.add(name, "string", False))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every page row; cases as in the module's docstring."""
    return extract(pages, carry=["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
