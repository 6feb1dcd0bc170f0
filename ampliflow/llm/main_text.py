"""Main text of web pages: flat text blocks, told apart by a decision tree over word counts and link densities of each block and of its
neighbours, in the manner of shallow text features for boilerplate detection.

A page becomes a list of blocks: a block is the text between two tags of block elements, its character references decoded and its white
space (any, no-break spaces too) made single. Scripts, styles, comments, controls and the like hold no text. A block has the words and
link density of itself and of the blocks before and after it, and what its elements say: whether one of them is named as furniture of a
page (nav, aside, footer, form, ... or such a word in a class, id or role) or as the place of an article, whether it is a heading or an
item, and whether it ends as a sentence does. The tree is grown here (Gini impurity, on the driver) from LABELLED, a few pages whose
fragments are labelled; it is a few dozen numbers, and goes to the tasks with the function.

Nulls: a null html, like an empty one or one without an article, gives an empty text with 0 characters. Broken pages: elements may stay
open, a page may end inside a tag, a reference or a script; what a tag at the end lacks is left out, what was read before it counts.
Repeated rows each get their text. Very long pages are read whole, in one pass. Other columns stay; those that have the names of new ones
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

# Elements of HTML by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
SKIPPED = frozenset("applet audio button canvas datalist iframe map math noscript object picture select svg template video".split())
FURNITURE = frozenset("aside dialog footer form menu nav search".split())
PLACES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start closes if it is open: up to the elements after the stroke.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "optgroup")), "tbody": ("thead tbody tfoot tr td th", ("table",)), "tfoot": ("thead tbody tr td th", ("table",)), "body": ("head", ()),
}
#: Words in a class, id or role that name furniture, and those that name the place of an article.
FURNITURE_WORDS = frozenset(
    "ad ads adslot adsense advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo "
    "cookie cookies copyright disqus donate feedback footer footnav form gdpr hidden login masthead menu modal navbar navigation nav newsletter notice notification outbrain pager pagination paywall poll popup "
    "promo promotion recommended related replies reply respond rss search share sharing sidebar signup sitemap skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar topbar trending widget widgets".split()
)
PLACE_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))[^>"']*)*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BARE = re.compile(r"(?:^|\s)hidden(?:\s|/|$)", re.I)
_WORDS_OF = re.compile(r"[a-z]+(?=[A-Z_\W\d]|$)|[A-Z]?[a-z]+|[A-Z]+")


def _hints(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is named as furniture, as the place of an article, and as a header."""
    furniture, place, header = name in FURNITURE, name in PLACES, name == "header"
    if "=" in attributes or "hidden" in attributes.lower():
        furniture |= bool(_BARE.search(re.sub(_ATTRIBUTE, " ", attributes)))
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(a or b or c)
            if key in ("class", "id", "role", "itemprop"):
                words = {w.lower() for w in _WORDS_OF.findall(value)}
                furniture |= not FURNITURE_WORDS.isdisjoint(words)
                header |= "header" in words
                place |= not PLACE_WORDS.isdisjoint(words)
            elif key == "style":
                furniture |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                furniture = True
    return furniture, place, header


@dataclass
class Block:
    """A block's text, its words and those inside links, and hints: furniture, place, heading, item."""

    text: str
    words: int
    linked: int
    furniture: bool
    place: bool
    heading: bool
    item: bool


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in its order."""
    out: list[Block] = []
    parts: list[str] = []  # of the block, with white space as it is
    linked: list[str] = []
    opened: list[tuple[str, bool, bool]] = []  # block elements: name, furniture and place (their own or of one around them)
    link = skipped = 0
    skipping = ""

    def flush() -> None:
        text = html.unescape("".join(parts)).split()
        if text:
            name, furniture, place = opened[-1] if opened else ("", False, False)
            item = any(n in ("li", "td", "th", "dd", "dt") for n, _, _ in opened[-2:])
            out.append(Block(" ".join(text), len(text), min(len(text), len(html.unescape("".join(linked)).split())), furniture, place, name in HEADINGS, item))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not skipping:
            parts.append(text)
            if link:
                linked.append(text)

    def close(names: tuple[str, ...], until: tuple[str, ...]) -> None:
        for n in range(len(opened) - 1, -1, -1):
            if opened[n][0] in until:
                return
            if opened[n][0] in names:
                del opened[n:]
                if names[0] not in ("li", "dt dd") and len(names) == 1:
                    return

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if found[2] is None:  # a comment or declaration
            continue
        closing, name, attributes = bool(found[1]), found[2].lower(), found[3]
        if skipping:
            if name == skipping:
                skipped += -1 if closing else not attributes.endswith("/")
                skipping = skipping if skipped else ""
            continue
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if name in SKIPPED:
            if not closing and not attributes.endswith("/"):
                skipping, skipped = name, 1
            continue
        if name == "a":
            if link and not closing:
                linked.append(" ")
            link = 0 if closing else 1
            continue
        if name == "br":
            add("\n")
            continue
        if name not in BLOCKS:
            continue
        flush()
        link = 0
        if closing:
            n = next((n for n in range(len(opened) - 1, -1, -1) if opened[n][0] == name), None)
            if n is not None:
                del opened[n:]
            continue
        if opened and opened[-1][0] == "p":
            opened.pop()
        if name in CLOSES:
            close(tuple(CLOSES[name][0].split()), CLOSES[name][1])
        if name in VOID:
            continue
        furniture, place, header = _hints(name, attributes)
        _, around, inside = opened[-1] if opened else ("", False, False)
        place |= inside
        # A page's header, not an article's.
        opened.append((name, furniture or around or (header and not place), place))
    flush()
    return out


#: What a block is told by; densities are shares of words inside links. Neighbours that aren't there have no words.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "place", "heading", "item", "sentence")


def features(own: list[Block]) -> np.ndarray:
    out = np.zeros((len(own), len(FEATURES)))
    if not own:
        return out
    words = np.array([b.words for b in own], float)
    density = np.array([b.linked for b in own]) / words
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6:10] = [(b.furniture, b.place, b.heading, b.item) for b in own]
    out[:, 10] = [b.text.rstrip("\"'”’»)").endswith((".", "!", "?", "…", ":", "。")) for b in own]
    return out


@dataclass
class Tree:
    """A node asks whether a feature is at most a bound, and goes on left or right; leaves have feature -1 and a share of main text."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            f = np.maximum(self.feature[node], 0)
            below = x[np.arange(len(x)), f] <= self.bound[node]
            node = np.where(inner, np.where(below, self.left[node], self.right[node]), node)
        return self.share[node]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 4) -> Tree:
    """A tree of at most this depth; leaves have at least so many rows. Of equal splits the first feature's smallest bound is taken."""
    nodes: list[list] = []

    def impurity(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 2 * ones * (n - ones) / n

    def add(rows: np.ndarray, left_over: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean()) if len(rows) else 0.0])
        if left_over and len(rows) >= 2 * least and 0 < y[rows].mean() < 1:
            best = (impurity(y[rows].sum(), np.float64(len(rows))) - 1e-9, -1, 0.0)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(order) + 1)
                k = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= least) & (n[:-1] <= len(order) - least))
                if len(k):
                    cost = impurity(ones[k], n[k]) + impurity(ones[-1] - ones[k], len(order) - n[k])
                    if cost.min() < best[0] - 1e-12:
                        at = k[cost.argmin()]
                        best = (float(cost.min()), f, (v[at] + v[at + 1]) / 2)
            if best[1] >= 0:
                below = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1], best[2]
                nodes[me][2] = add(rows[below], left_over - 1)
                nodes[me][3] = add(rows[~below], left_over - 1)
        return me

    add(np.arange(len(y)), depth)
    f, b, le, r, s = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(b), np.array(le), np.array(r), np.array(s))


#: The labelled table: pages as fragments of HTML, each with 1 if its blocks are main text. A number in braces stands for so many words,
#: with a minus for so many linked ones (in links of two words).
LABELLED: list[list[tuple[str, int]]] = [
    [
        ("<title>{6}</title><nav><ul><li><a href=/>{-1}</a><li>{-1}<li>{-2}</ul></nav><div class=ad>{8}.</div>", 0), ("<article><h1>{6}</h1><p>{60}.<p>{90}.</p><p>{2}.<p>{1}.<p>{25}.</p><p>{40}, {-2} {20}.</p></article>", 1),
        ("<footer>&copy; {3} &middot; {2}</footer>", 0),
    ],
    [
        ("<header><h1>{2}</h1><p>{7}.</p></header><div class='breadcrumbs'>{-1} {-2}</div>", 0), ("<div id=content><h2>{5}</h2><p>{35}.</p><p>{3}</p><ul><li>{7}<li>{4}<li>{9}</ul><p>{50}.</p><blockquote>{16}.</blockquote><p>{12}.</p>", 1),
        ("<div class='share-buttons'>{3}</div><div class=related><h3>{2}</h3><ul><li>{-6}<li>{-8}</ul></div>", 0), ("<p>{30}.</p></div>", 1), ("<aside><h3>{2}</h3><p>{45}.</p></aside><footer><p>{20}.</p></footer>", 0),
    ],
    [
        ("<table><tr><td>{-1}<td>{-1}<td>{-2}<tr><td>{-2} {1}</table><div>{3} {-4}</div>", 0), ("<div><div>{48}.</div><div>{71}.</div><div>{33}.</div><div>{15}.</div><div>{28}.</div></div>", 1),
        ("<div>{-2} {-2} {-1}</div><div>{6}</div><div>{4}</div>", 0),
    ],
    [
        ("<div class='cookie-notice'><p>{28}.</p></div><div>{-1} {-1} {-1} {-1}</div>", 0), ("<main><h1>{8}</h1><p>{18}.</p><p>{64}.</p><h2>{3}</h2><p>{22}.</p><p>{5}!</p></main>", 1),
        ("<section id=comments><h3>{2}</h3><div><p>{35}.</p><p>{11}.</p></div><div><p>{62}.</p></div></section><form><p>{9}</p><label>{2}</label></form>", 0),
    ],
    [
        ("<header><p>{4}</p></header><nav>{-2} {-2} {-2}</nav>", 0), ("<article><h1>{4}</h1><p>{14}.</p></article>", 1), ("<aside>{30}.</aside><div class=newsletter><p>{15}.</p><p>{6}</p></div><footer>{-2} {-2} {5}</footer>", 0),
    ],
    [
        ("<div>{2}</div><div>{-1} {-1} {-1} {-1} {-1}</div><div>{5}</div>", 0), ("<h1>{7}</h1><p>{30}.</p><p>{41}.</p><p>{9}.</p><p>{26} {-3} {9}.</p><p>{19}.</p>", 1), ("<p>{-5}</p><p>{-7}</p><p>{-4}</p><p>{3} {-2}</p><p>{2}</p>", 0),
    ],
    [
        ("<div class=topbar>{6}</div><div class='site-header'>{3}</div><ul class=menu><li>{-1}<li>{-1}</ul>", 0), ("<div class='post-body'><p>{11}.</p><pre>{13}</pre><p>{24}:</p><table><tr><td>{3}<td>{2}<tr><td>{5}<td>{1}</table><p>{17}.</p>", 1),
        ("<div class='ad-slot'>{12}.</div>", 0), ("<p>{8}.</p><h3>{2}</h3><p>{55}.</p></div>", 1), ("<div class=sidebar><p>{22}.</p><p>{4}</p></div><div class=comment-list><p>{16}.</p><p>{3}</p></div>", 0),
    ],
    [
        ("<nav>{-3} {-1}</nav><div role=banner>{5}</div>", 0), ("<article><h1>{3}</h1><p>{2}?</p><p>{1}.</p><p>{7}.</p><p>{1}.</p><p>{80}.</p><ol><li>{12}.<li>{3}.</ol>", 1),
        ("<div class=promo>{10} {-2}.</div>", 0), ("<p>{6}.</p><p>{31}.</p><p>{20}</p>", 1), ("<ul><li>{-4}<li>{-5}<li>{-6}</ul>", 0), ("<figure><figcaption>{9}</figcaption></figure><p>{12}</p></article>", 1),
        ("<div class=comments><article><p>{44}.</p></article><article><p>{5}!</p></article></div><footer><ul><li>{-2}<li>{-2}</ul><p>{11}.</p></footer>", 0),
    ],
    [
        ("<div>{4}</div><div>{-2} {1} {-2}</div><ul><li>{-1}<li>{-3}<li>{-2}</ul>", 0), ("<h2>{6}</h2><div>{52}.</div><div>{38}.</div><div>{21}.</div>", 1), ("<div>{3}</div><ul><li>{-3}<li>{-4}</ul><div>{8}</div><div>{-2}</div>", 0),
    ],
    [
        ("<ul><li>{-1}<li>{-1}<li>{-1}</ul><div>{11}.</div><div>{-1} {-2} {-1}</div>", 0), ("<h1>{5}</h1><div>{40}.</div><div>{18}.</div><div>{66}.</div>", 1),
        ("<div>{-4}</div><div>{13}.</div><div>{-2}</div><div>{16}.</div><div>{-3}</div><div>{12}.</div><div>{-1} {-1} {-1}</div><div>{10}.</div>", 0),
    ],
    [
        ("<div>{-2} {-2}</div><p>{14}.</p><div>{-1} {-1} {-1}</div>", 0), ("<div>{24}.</div><div>{7}.</div><div>{31}.</div>", 1), ("<div>{-3} {-3}</div><div>{9}.</div><div>{-2}</div><div>{20}.</div><div>{-2}</div>", 0),
    ],
    [
        ("<div>{-24}</div><p>{-2} {-2} {1}</p>", 0), ("<div>{33} {-4} {12}.</div><div>{20}.</div><div>{45}.</div><p>{11}.</p><p>{29}.</p>", 1), ("<p>{-18} {3}</p><p>{-30}</p><p>{2} {-26}</p><p>{19} {-28}</p><div>{3}</div>", 0),
    ],
    [
        ("<div class=login><p>{4}</p></div><div hidden><p>{40}.</p></div>", 0), ("<div itemprop=articleBody><p>{27}, {-6} {8}.</p><p>{-3} {9}, {-4}.</p><p>{44}.</p><dl><dt>{2}<dd>{14}.</dl></div>", 1),
        ("<div class=tags>{-1} {-1} {-1}</div><div id=footer><p>{32}.</p></div>", 0),
    ],
]


#: Each labelled page is learnt with its blocks that much longer or shorter, so that no bound rests on one page's lengths.
SCALES = (1, 0.7, 1.4, 2.0)


def labelled_page(fragments: list[tuple[str, int]], scale: float = 1) -> tuple[str, list[int]]:
    """The page of a list of labelled fragments, and the label of each of its blocks. scale: of the numbers of words outside links."""
    words = lambda m: " ".join(["word"] * max(1, round(int(m[1]) * scale))) if int(m[1]) > 0 else " ".join(f"<a href='/p'>{'link ' * min(2, -int(m[1]) - k)}</a>" for k in range(0, -int(m[1]), 2))
    page, labels = "", []
    for fragment, label in fragments:
        page += re.sub(r"\{(-?\d+)\}", words, fragment)
        labels += [label] * (len(blocks(page)) - len(labels))
    return page, labels


def train(pages: list[list[tuple[str, int]]] | None = None) -> Tree:
    """The tree of labelled pages."""
    x, y = [], []
    for scale in SCALES:
        for fragments in LABELLED if pages is None else pages:
            page, labels = labelled_page(fragments, scale)
            x.append(features(blocks(page)))
            y += labels
    return grow(np.concatenate(x), np.array(y, float))


def main_blocks(page: str, tree: Tree) -> list[str]:
    own = blocks(page)
    return [b.text for b, share in zip(own, tree.predict(features(own)).tolist(), strict=True) if share >= 0.5] if own else []


def with_main_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """pages (html) with text, the main text's blocks with an empty line between two, and n_chars, its code points."""
    tree = tree or train()

    def extract(column: pa.Array) -> pa.Array:
        return pa.array(["\n\n".join(main_blocks(page.as_py() or "", tree)) for page in column], pa.string())

    rows = pages.withColumn("text", F.arrow_udf(extract, T.StringType())(pages["html"].cast("string")))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
