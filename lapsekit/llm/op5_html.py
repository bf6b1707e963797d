"""Main text of pages by site style trees.

1. *Merge.* Each page becomes a list of all its text blocks with the path of styled elements above them
   (tag, class, id). Over all pages of a host, equal paths are one node of the site's style tree. Counted per
   node: pages that have it, how often each text occurs in it, and each sequence of children.
2. *Importance.* Content: ``1 - mean(log c / log m)`` over the texts of a node, c = pages with that text,
   m = pages with the node: 0 if every page says the same, 1 if each says something of its own.
   Presentation: entropy (base m) of the child sequences of the element above. Importance is ``CONTENT`` of
   the first and the rest of the second. A node below ``LOW`` on at least ``MIN_PAGES`` pages goes.
3. *Extract.* A page keeps its blocks outside low nodes. What elements mean is known beforehand: navigation,
   headers, footers, asides, forms, adverts, notices, comments and the like go, also on hosts with one page. A class or
   id tells so only if all its words do (noise and layout words); any other name is left to the tree.
   If a page has an article or main element, only its text is kept, less its low nodes. A site may repeat an
   article: if the low nodes hold over half of the text there, they stay. Class names, ids and forms are only
   guesses: one around a main element does not count, nor does one around an article or most of the text of a page
   that has no article or main outside its guesses (a layout 'has-sidebar', a form around the whole page).

Pages are parsed twice and not shuffled: the low nodes of all hosts are joined by host, as a broadcast if they are
few, else salted so that a host with a third of all pages is spread over many tasks.

Defined cases: null or empty html gives ''; a null url is the host ''; unclosed tags end with their parent,
stray end tags are ignored; equal rows count as pages of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.session import cut_lineage

LOW, CONTENT, MIN_PAGES = 0.3, 0.9, 4
BROADCAST_NODES = 50_000   # (host, node): under 5 MB
SALTS = 32

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math object select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
               "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
           "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
NOISE_TAGS = set("nav header footer aside form button fieldset dialog menu head legend input datalist".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = set("nav navbar navigation menu menubar sidebar side footer header masthead ad ads advert advertisement adverts "
                  "adsense advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
                  "popup modal overlay comment comments commentlist reply replies respond disqus share sharing social breadcrumb "
                  "breadcrumbs related recommended newsletter subscribe subscription signup login widget pagination pager toolbar "
                  "skip".split())
#: words that only say where or what kind of box; a name counts as noise if it is made of these and of noise words
LAYOUT_WORDS = set("a area articles bar bars block body bottom box btn btns button buttons center col column container content desktop "
                   "element fixed foot form global grid group head icon icons id inner item items js label left link links list lists main media "
                   "middle mobile mod module outer page panel policy post posts primary right row secondary section site slot space sticky "
                   "stories text title top unit wide wrap wrapper zone".split())
MAIN_TAGS = {"article", "main"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
                   r"|<(/?)([A-Za-z][^\s/>]*)([^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*)>"
                   r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: one attribute after another, so a quoted value is never read as a name
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
READ = {"class", "id", "role", "hidden", "aria-hidden"}
FORMS = {"form", "fieldset"}     # known noise, but a guess where they hold the main content
SPACE = re.compile(r"[ \t\n\r\f\v  -     　 \u0085\x1c-\x1f]+")
NUMBER = re.compile(r"\d+")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Guess:
    """An element that its name calls noise, and what it holds."""
    __slots__ = ("outer", "inside", "has_main", "has_article", "shows_article", "size", "void")

    def __init__(self, outer: _Guess | None, inside: bool):
        self.outer, self.inside, self.size = outer, inside, 0     # the guess around it; whether it is inside main content
        self.has_main = self.has_article = self.shows_article = self.void = False


class _Element:
    __slots__ = ("tag", "path", "noise", "main", "children", "guess")

    def __init__(self, tag: str, path: str, noise: bool, main: bool, guess: _Guess | None = None):
        self.tag, self.path, self.noise, self.main, self.children, self.guess = tag, path, noise, main, [], guess


def noise_name(name: str) -> bool:
    """Is a class or id made of noise words: 'site-footer' and 'cookieNotice' are, 'side-effects' and 'share-price' are not."""
    words = set(NAME.findall(CAMEL.sub("-", name).lower()))
    return bool(words & NOISE_WORDS) and words <= NOISE_WORDS | LAYOUT_WORDS


def _open(parent: _Element, tag: str, attributes: str, guesses: list[_Guess]) -> _Element:
    label, noise, role_main, guess, full_main = tag, tag in NOISE_TAGS and tag not in FORMS, False, tag in FORMS, tag == "main"
    if attributes and not attributes.isspace():
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next((v for v in values if v), ""), name.lower()
            if name not in READ:
                continue
            if name in ("class", "id"):
                label += ("." if name == "class" else "#") + NUMBER.sub("0", value.strip())
                guess |= tag not in ("html", "body", "article", "main") and any(map(noise_name, value.split()))
            elif name == "role":
                guess |= value.lower() in FORMS
                noise |= value.lower() in NOISE_ROLES - FORMS
                role_main = value.lower() in ("main", "article")
                full_main |= value.lower() == "main"
            elif name == "hidden" or value.lower() == "true":
                noise = True
    if tag == "header" and parent.main:
        noise, guess = parent.noise, False   # an article's own header holds its headline
    parent.children.append(label)
    noise |= parent.noise
    own = parent.guess
    if guess and not noise:
        own = _Guess(own, parent.main)
        guesses.append(own)
    if full_main and own and not noise:
        own.has_main |= not own.inside
    return _Element(tag, f"{parent.path}>{label}", noise, parent.main or tag in MAIN_TAGS or role_main, own)


def _settle(found: list[tuple], guesses: list[_Guess]):
    """Decide from the outside in which guesses do not count."""
    total, shown = 0, False
    for _, text, noise, main, guess in found:
        if not noise:
            total += len(text)
            if guess:
                guess.size += len(text)
                guess.shows_article |= main
                guess.has_article |= main and not guess.inside
            else:
                shown |= main
    for g in reversed(guesses):
        if g.outer:
            g.outer.size += g.size
            g.outer.has_main |= g.has_main and not g.outer.inside
            g.outer.has_article |= (g.has_article or g.inside and g.shows_article) and not g.outer.inside
    for g in guesses:
        if not g.outer or g.outer.void:
            g.void = g.has_main or not shown and (g.has_article or 2 * g.size > total)
            shown |= g.void and g.shows_article


def blocks_of(page: str) -> tuple[list[tuple[str, str, bool, bool]], list[_Element]]:
    """Text blocks (path, text, known noise, inside main content) in page order, and all block elements."""
    root = _Element("", "", False, False)
    stack, found, elements, run, guesses = [root], [], [root], [], []
    at, end = 0, len(page)

    def block_at(depth: int = -1) -> _Element:
        for e in reversed(stack):
            if e.tag not in INLINE:
                return e
        return root

    def close_run():
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip(" ")
            run.clear()
            if text:
                e = block_at()
                found.append((e.path, text, stack[-1].noise or e.noise, e.main, stack[-1].guess))

    def pop(n: int):
        while len(stack) > n:
            if stack[-1].tag not in INLINE:
                close_run()
            stack.pop()

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), (m[3] if m[2] else m[6]) or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            else:
                if tag in ("p", "br"):
                    close_run() if tag == "p" else run.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                close_run()
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLING:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SCOPE.get(tag, ()):
                    break
                if stack[i].tag in SIBLING[tag]:
                    pop(i)
                    if tag not in ("tr", "tbody", "tfoot", "thead"):
                        break
        if tag not in INLINE:
            close_run()
        e = _open(stack[-1], tag, attributes, guesses)
        stack.append(e)
        if tag not in INLINE:
            elements.append(e)
    close_run()
    _settle(found, guesses)
    for e in elements:
        e.noise |= e.guess is not None and not e.guess.void
    return [(path, text, noise or g is not None and not g.void, main) for path, text, noise, main, g in found], elements


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def style_counts(page: str) -> list[tuple[int, int, int]]:
    """What a page adds to its site's tree, each once: (node, kind, feature); kind 0 text, 1 child sequence, 2 the node."""
    blocks, elements = blocks_of(page)
    out = set()
    for path, text, _, _ in blocks:                 # all branches: the tree judges those with telling names as well
        node = _key(path)
        out.add((node, 0, _key(text)))
        out.add((node, 2, 0))
        out.add((node, 1, _key(path.rpartition(">")[0])))
    for e in elements:
        out.add((_key(e.path), 3, _key("|".join(e.children))))
    return list(out)


def judged_blocks(page: str, low: set[int] = frozenset()) -> list[tuple[str, str]]:
    """(text, why) of all blocks in page order: '' for kept ones, else 'tree' (a low node), 'name' (known by tag or name only) or 'outside'."""
    blocks, _ = blocks_of(page)
    low_at = [_key(b[0]) in low for b in blocks]
    known = [i for i, b in enumerate(blocks) if not b[2]]
    main = [i for i in known if blocks[i][3]]
    own = [i for i in main or known if not low_at[i]]
    size = lambda places: sum(len(blocks[i][1]) for i in places)
    if main:
        kept = own if 2 * size(own) >= size(main) else main
    else:
        kept = own or known
    kept = set(kept)
    return [(b[1], "" if i in kept else "tree" if low_at[i] else "name" if b[2] else "outside") for i, b in enumerate(blocks)]


def main_text(page: str, low: set[int] = frozenset()) -> str:
    return " ".join(text for text, why in judged_blocks(page, low) if not why)


def with_host(pages: DataFrame, url: str, html: str, *more) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(*more, F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))


def low_nodes(pages: DataFrame, url: str = "url", html: str = "html", low: float = LOW, content: float = CONTENT,
              min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, node, importance) of the style-tree nodes that carry a site's boilerplate."""
    def count(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                for x in style_counts(p):
                    seen[(h, *x)] = seen.get((h, *x), 0) + 1   # the map-side combine
            cols = list(zip(*((*k, n) for k, n in seen.items()))) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "node", "kind", "feature", "n"])

    counts = (with_host(pages, url, html).select("host", "html").mapInArrow(count, "host string, node long, kind int, feature long, n long")
              .groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n")))
    per_node = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log(F.col("n")))).alias("text_logs"),
        F.sum(F.when(F.col("kind") == 3, F.col("n"))).alias("layouts"),
        F.sum(F.when(F.col("kind") == 3, F.col("n") * F.log(F.col("n")))).alias("layout_logs"),
        F.max(F.when(F.col("kind") == 1, F.col("feature"))).alias("parent"))
    leaves = per_node.filter(F.col("m") >= min_pages).select(
        "host", "node", "parent", (1 - F.col("text_logs") / F.col("texts") / F.log("m")).alias("own"))
    above = per_node.filter(F.col("layouts") > 1).select(
        F.col("host").alias("p_host"), F.col("node").alias("p_node"),
        ((F.log("layouts") - F.col("layout_logs") / F.col("layouts")) / F.log("layouts")).alias("shape"))
    value = content * F.col("own") + (1 - content) * F.coalesce(F.col("shape"), F.lit(0.0))
    return (leaves.join(above, (F.col("host") == F.col("p_host")) & (F.col("parent") == F.col("p_node")), "left")
            .select("host", "node", value.alias("importance")).filter(F.col("importance") < low))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **tree) -> DataFrame:
    """(page_id, url, text) of every page."""
    low = cut_lineage(low_nodes(pages, url, html, **tree))
    few = low.count() <= BROADCAST_NODES
    low = low.groupBy("host").agg(F.collect_set("node").alias("low"))
    rows = with_host(pages, url, html, F.col(page_id).alias("page_id"))
    if few:
        joined = rows.join(F.broadcast(low), "host", "left")
    else:  # each site's list once per salt, so that a hot host is read by many tasks
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def read(batches):
        for batch in batches:
            texts = [main_text(p, frozenset(x or ())) for p, x in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "low").mapInArrow(read, f"page_id {kind}, url string, text string")
