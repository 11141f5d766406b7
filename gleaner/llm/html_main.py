"""Main text of web pages by a tree-structured graphical model.

Each element and each block of text of a page is a binary variable: main text or not. Unary potentials come from its
tag, attribute words, length, links, sentences, siblings and place, pairwise ones connect it to its parent. Sum-product
messages go up the tree and down again; what they leave at a block is its marginal. Weights are fitted by gradient
ascent on the likelihood of labelled pages, with expectations from the same messages.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from gleaner.llm.common import read_table
from gleaner.llm.html_pages import MARK, training_pages

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r"""[<>"']""")
SIGN = re.compile("[<>]")
#: Elements whose content is no text, to their end or the page's; and those whose content is dropped if they are closed.
RAW = frozenset({"script", "style", "textarea"})
DROPPED = frozenset({"svg", "iframe", "select", "template"})
#: Elements that neither end a block of text nor stand for a part of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr svg iframe canvas object select template math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover noscript semantics annotation".split())
VOID = frozenset("area base br col embed hr link meta param track".split())
#: A start tag closes an open element of these kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: How far up CLOSES looks: a list in an item keeps the item open.
SCOPES = frozenset("ul ol dl table body article section div main nav aside header footer form".split())
ATTRIBUTE = re.compile(r"""(?:\b(?:class|id|role|itemprop)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Words of attributes that tell what a part of a page is, and words of short texts that belong to its frame.
FRAME_PARTS = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored sidebar side widget widgets related recommended popular menu nav navbar navigation breadcrumb breadcrumbs header head masthead topbar "
    "footer foot bottom comment comments disqus reply replies respond discussion share sharing social follow newsletter subscribe signup login cookie cookies consent gdpr privacy notice alert popup "
    "modal overlay toolbar pagination pager tags meta byline legal copyright imprint search form print archive archives categories reviews poll skip".split()
)
MAIN_PARTS = frozenset("article articlebody content main post entry story body text prose blogpost".split())
FRAME_WORDS = frozenset(
    "cookie cookies subscribe newsletter copyright rights reserved privacy terms contact follow share login log sign register advertisement sponsored archive archives categories tags comment comments "
    "reply posts related menu search imprint email address phone office visit click download shop store free offer price sale join next previous home "
    "abonnieren impressum datenschutz kontakt anmelden suche werbung kommentare abonnez contact recherche commentaires publicité connexion suscríbete contacto buscar publicidad comentarios".split()
)


def tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Tags and what is no text, in order: start, end, the tag's name (None: not a tag), whether it is an end tag, and
    its attributes. Time is linear in the page: a search that fails is not made again.

    What never ends, or has another tag's sign before its end, is text. A quote that is never closed is no quote, nor is any after it. Comments, scripts,
    styles and forms' texts left open run to the end of the page; pictures, frames, choices and templates that are left
    open or closed at once ("/>") are tags like others.
    """
    at, n, last, quotes, open_ended = 0, len(html), html.rfind(">"), True, set()
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        begin = html[start + 1 : start + 2]
        shut = begin == "/"
        m = NAME.match(html, start + 1 + shut)
        if m is None:
            if begin not in ("!", "?", "/"):  # an ordinary sign
                at = start + 1
                continue
            mark = "-->" if html.startswith("<!--", start) else "]]>" if html.startswith("<![CDATA[", start) else ">"
            end = html.find(mark, start + 2)
            at = n if end < 0 else end + len(mark)
            yield start, at, None, False, ""
            continue
        if last < m.end():
            at = start + 1
            continue
        end = m.end()
        while quotes:
            stop = TAG_STOP.search(html, end)
            if stop is not None and stop[0] in "<>":
                end = stop.start()
                break
            close = -1 if stop is None else html.find(stop[0], stop.end())
            quotes, end = close >= 0, close + 1
        else:
            end = SIGN.search(html, m.end()).start()
        if html[end] == "<":  # a sign before a word, not a tag
            at = start + 1
            continue
        name, attributes, at = m[0].lower(), html[m.end() : end], end + 1
        if not shut and name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = n if found is None else found.end()
            yield start, at, None, False, ""
            continue
        if not shut and name in DROPPED and name not in open_ended and not attributes.rstrip().endswith("/"):
            depth = 1
            for other in re.compile(rf"<(/?){name}(?=[\s/>])", re.I).finditer(html, at):
                depth += -1 if other[1] else 1
                if depth == 0:
                    break
            closed = html.find(">", other.end()) if depth == 0 else -1
            if closed >= 0:
                at = closed + 1
                yield start, at, None, False, ""
                continue
            open_ended.add(name)
        yield start, at, name, shut, attributes


class Page:
    """Elements and blocks of text of a page in document order; ``parent`` is -1 for the root."""

    __slots__ = ("kind", "parent", "text", "links")

    def __init__(self, html: str):
        self.kind: list[str] = ["root"]  # of an element its tag and attributes, of a block of text ""
        self.parent: list[int] = [-1]
        self.text: list[str | None] = [None]
        self.links: list[int] = [0]
        stack: list[tuple[str, int]] = [("root", 0)]
        held: list[str] = []
        linked = in_link = at = 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join(unescape("".join(held)).split())
                held.clear()
                if text:
                    self._add("", stack[-1][1], text, linked)
            linked = 0

        counts: dict[str, int] = defaultdict(int)  # open elements by tag: what isn't open isn't looked for

        def close(depth: int) -> None:
            for t, _ in stack[depth:]:
                counts[t] -= 1
            del stack[depth:]

        for start, end, tag, shut_tag, attributes in tokens(html):
            if start > at:
                held.append(html[at:start])
                linked += in_link and start - at
            at = end
            if tag is None:
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not shut_tag
                continue
            if tag == "br":
                held.append(" ")
                continue
            flush()
            if tag in VOID:
                continue
            if shut_tag:
                if counts[tag]:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    close(depth)
                continue
            if stack[-1][0] == "p":
                close(len(stack) - 1)
            shut = CLOSES.get(tag, ())
            if any(counts[t] for t in shut):
                depth = len(stack) - 1
                while depth and (stack[depth][0] in shut or stack[depth][0] not in SCOPES):
                    if stack[depth][0] in shut:
                        close(depth)
                    depth -= 1
            if attributes.rstrip().endswith("/"):
                continue
            in_link = 0
            counts[tag] += 1
            stack.append((tag, self._add(tag + attributes.lower(), stack[-1][1], None, 0)))
        if at < len(html):
            held.append(html[at:])
        flush()

    def _add(self, kind: str, parent: int, text: str | None, links: int) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        self.text.append(text)
        self.links.append(links)
        return len(self.kind) - 1


@lru_cache(1 << 14)
def element_features(kind: str, parent: str) -> tuple[str, ...]:
    """The tag, alone and in its parent's, and the words of its class, id, role and itemprop."""
    tag, above = (re.match(r"[^\s]*", k)[0] for k in (kind, parent))
    words = {w for m in ATTRIBUTE.finditer(kind) for w in WORD.findall(m[1] or m[2] or m[3] or "")}
    told = (("attribute",) if words else ()) + (("frame part",) if words & FRAME_PARTS else ()) + (("main part",) if words & MAIN_PARTS and not words & FRAME_PARTS else ())
    return (f"tag {tag}", f"{tag} in {above}", *(f"attribute {w}" for w in sorted(words)), *told)


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x >= b for b in bounds)


def features(page: Page) -> list[tuple[str, ...]]:
    """The features of each node: of elements also how much of the page's text and links they hold, of blocks their
    length, sentences, links and words, where they stand, and what headings and long blocks stand beside them."""
    n, parent = len(page.kind), page.parent
    size, links, blocks, paragraphs, own, titled = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for v, text in enumerate(page.text):
        if text is not None:
            size[v] = own[v] = text.count(" ") + 1
            links[v], blocks[v] = (size[v] if page.links[v] * 2 > len(text) else 0), 1
            above = parent[v]
            if own[v] >= 8 and links[v] == 0:
                paragraphs[parent[above] if above > 0 and blocks[above] == 0 else above] += 1
    beside = paragraphs
    for v in range(n - 1, 0, -1):
        titled[parent[v]] |= page.kind[v][:2] in ("h1", "h2", "h3")
        for counts in (size, links, blocks):
            counts[parent[v]] += counts[v]
    whole, before, headed, out = max(size[0], 1), 0, 0, []
    for v in range(n):
        text, kind, above = page.text[v], page.kind[v], parent[v]
        if text is None:
            share, linked = _level(size[v] / whole, (0.1, 0.35, 0.7)), _level(links[v] / max(size[v], 1), (0.01, 0.3, 0.7))
            headed |= kind[:2] in ("h1", "h2")
            out.append((*element_features(kind, page.kind[above] if v else ""), f"share {share}", f"links {linked}", f"long blocks {_level(beside[v], (1, 2, 4))}", f"words {_level(size[v], (1, 6, 20, 60))}", f"titled {titled[v]}"))
            continue
        long = _level(own[v], (4, 10, 25))
        low = text.lower()
        mine = ["block", f"in {re.match(r'[^ ]*', page.kind[above])[0]}", f"length {long}", f"sentence {text[-1:] in '.!?:…”»'} {long > 1}", f"headed {headed}", f"place {_level(before / whole, (0.05, 0.9))}"]
        if links[v]:
            mine.append("linked")
        elif page.links[v]:
            mine.append("has links")
        if "©" in text:
            mine.append("copyright")
        if any(w in FRAME_WORDS for w in re.findall(r"[^\W\d_]+", low if len(low) < 400 else low[:0])):
            mine.append(f"frame words {long > 1}")
        grand = parent[above] if above > 0 else 0
        mine.append(f"titled beside {titled[above] | titled[grand]}")
        mine.append(f"beside {_level(max(beside[above], beside[grand]), (1, 2, 4))}")
        before += own[v]
        out.append(tuple(mine))
    return out


class Model:
    """Unary weights by feature and, for elements and for blocks, the log potentials of (parent, node)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.pairs = {True: [0.0, 0.0, 0.0, 0.0], False: [0.0, 0.0, 0.0, 0.0]}  # by block; 00, 01, 10, 11

    def unary(self, page: Page, known: list[tuple[str, ...]] | None = None) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in mine) for mine in known or features(page)]

    def marginals(self, page: Page, edges: bool = False, known: list[tuple[str, ...]] | None = None) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """The probability of each node to be main text; with ``edges`` also that of each pair (parent, node)."""
        n, parent, text = len(page.kind), page.parent, page.text
        here = self.unary(page, known)
        tables = {b: [exp(x) for x in t] for b, t in self.pairs.items()}
        up = [0.0] * n
        for v in range(n - 1, 0, -1):  # children come after their parent
            p00, p01, p10, p11 = tables[text[v] is not None]
            e = exp(min(max(here[v], -60.0), 60.0))
            up[v] = log((p11 * e + p10) / (p01 * e + p00))
            here[parent[v]] += up[v]
        pairs = [(0.0, 0.0, 0.0, 0.0)] * n if edges else []
        for v in range(1, n):  # now here[v] has all below v; the parent's has everything
            p00, p01, p10, p11 = tables[text[v] is not None]
            e = exp(min(max(here[parent[v]] - up[v], -60.0), 60.0))
            if edges:
                f = exp(min(max(here[v], -60.0), 60.0))
                cells = (p00, p01 * f, p10 * e, p11 * e * f)
                total = sum(cells)
                pairs[v] = tuple(c / total for c in cells)
            here[v] += log((p11 * e + p01) / (p10 * e + p00))
        return [1 / (1 + exp(-min(max(h, -60.0), 60.0))) for h in here], pairs

    def main_text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        found, _ = self.marginals(page)
        return "\n\n".join(t for t, p in zip(page.text, found) if t is not None and p > 0.5)


def labelled(html: str) -> tuple[Page, list[int]]:
    """A labelled page: a block is main text if it begins with the mark, an element if most of its text is."""
    page = Page(html)
    main, size = [0] * len(page.kind), [0] * len(page.kind)
    for v, text in enumerate(page.text):
        if text is not None:
            marked = text.startswith(MARK)
            page.text[v] = text.removeprefix(MARK).strip()
            main[v], size[v] = marked * len(text), len(text)
    for v in range(len(page.kind) - 1, 0, -1):
        main[page.parent[v]] += main[v]
        size[page.parent[v]] += size[v]
    return page, [int(2 * m > s) for m, s in zip(main, size)]


@lru_cache(1)
def fitted(rounds: int = 120, rate: float = 0.15, shrink: float = 0.003) -> Model:
    """The model that the labelled pages train: each round adds their features less what the messages expect.

    Steps are scaled as in Adam, so that rare features are learned as well as common ones, and shrink to nothing.
    """
    model, moments = Model(), defaultdict(lambda: [0.0, 0.0])
    pages = [(page, labels, features(page)) for page, labels in map(labelled, training_pages())]

    def step(key: object, now: float, gradient: float, done: int) -> float:
        gradient -= shrink * now
        m, v = moments[key]
        moments[key] = m, v = [0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient]
        return now + rate * (1 - done / rounds) * (m / (1 - 0.9 ** (done + 1))) / ((v / (1 - 0.99 ** (done + 1))) ** 0.5 + 1e-3)

    for done in range(rounds):
        by_feature, by_pair = defaultdict(float), {True: [0.0] * 4, False: [0.0] * 4}
        for page, labels, known in pages:
            found, pairs = model.marginals(page, edges=True, known=known)
            for v, mine in enumerate(known):
                for f in mine:
                    by_feature[f] += labels[v] - found[v]
                if v:
                    cells = by_pair[page.text[v] is not None]
                    cells[2 * labels[page.parent[v]] + labels[v]] += 1
                    for i, x in enumerate(pairs[v]):
                        cells[i] -= x
        for f, g in by_feature.items():
            model.weights[f] = step(f, model.weights.get(f, 0.0), g, done)
        for b, cells in by_pair.items():
            model.pairs[b] = [step((b, i), x, g, done) for i, (x, g) in enumerate(zip(model.pairs[b], cells))]
    return model


def main_texts(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` to each page; columns of these names that the pages have are replaced.

    Null and empty pages, and pages of markup alone, have the empty text; markup that is broken or never closed is read
    as far as it goes, in time and memory linear in the page, however long; a page without markup is one block. Rows are
    kept as they come, repeated ones and those without an id included; an empty table gives no rows.
    """
    trained = model or fitted()

    @pandas_udf(StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([trained.main_text(h) if isinstance(h, str) else "" for h in batch], dtype="object")

    return pages.withColumn("text", extract(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))


def op10_dom_graphical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
