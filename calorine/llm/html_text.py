"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat list of text blocks, cut at block-level tags.  A block's features are its word count and
link density, those of the blocks before and after it, whether it is a heading, and what encloses it (an article or
main element; page furniture by its tag or by a name of its class, id or role).  A small CART tree, grown from the labelled table
below, tells main text from the rest: where nothing is named, by word counts and link densities alone.  Two rules go beyond single
blocks: what lies between main text belongs to it unless it is furniture or links, and a page in which the tree finds none gives its best run.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT_TAGS = frozenset("script style noscript template svg iframe object canvas select button textarea datalist audio video head title".split())
#: Of these, the ones that run to the page's end without an end tag: they hold code.  The others are empty then.
CODE_TAGS = frozenset("script style".split())
#: Of these, the ones whose content is raw text, in which no tag counts but their own end.
RAW_TEXT_TAGS = CODE_TAGS | frozenset("textarea title iframe noscript".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
SPACE_TAGS = frozenset("br wbr img hr input".split())
#: What the start of an element ends without an end tag: elements of these names, down to the nearest of those.
IMPLIED_ENDS = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset("ul ol menu dir".split()))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table"]))),
    **dict.fromkeys("thead tbody tfoot".split(), (frozenset("thead tbody tfoot".split()), frozenset(["table"]))),
}
#: Words of class, id and role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner popup modal overlay "
    "comment comments commentlist reply replies responses discussion disqus sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer footnav "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup signin login widget toolbar pagination pager copyright legal "
    "disclaimer complementary contentinfo search skip teaser trending popular outbrain taboola dialog form hidden".split()
)
#: Furniture only outside an article: an article may have a header of its own.
OUTER_WORDS = frozenset("header masthead topbar top".split())
#: Furniture that an article inside doesn't lift: comments and teasers are often articles themselves.
STRICT_WORDS = frozenset("comment comments commentlist reply replies responses discussion disqus related recommended recommendations sidebar aside teaser trending popular".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement sponsored promo".split())
#: Words that say nothing of a name's subject: a name of furniture words and these alone is furniture's.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons card cards column container content global group head inner item items label left link links list main middle module outer page panel policy post posts primary right "
    "section secondary site slot story tertiary text title top unit wrap wrapper zone".split()
)
#: In a name, these tell of the page as a whole, whatever else it has: ``has-sidebar``, ``menu-page``.
LAYOUT_WORDS = frozenset("has with no without layout page root app theme template".split())
#: Names of the element that holds an article: one of the first with one of the second.
SUBJECTS, BODIES = frozenset("article post entry story".split()), frozenset("body content text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of the names that are furniture's, whether a name is that of a main element, and whether of an article's body.

    A name speaks as a whole: ``cookie-notice`` and ``ad-slot`` are furniture, ``legal-analysis`` has a subject beside
    a word of furniture, and ``sidebar-layout`` tells of the page.
    """
    found: set[str] = set()
    main = body = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in NAME_WORD.findall(token)]
                known = set(words)
                main = main or known == {"main"} or known == {"main", "content"}
                body = body or len(words) == 2 and words[0] in SUBJECTS and words[1] in BODIES
                if len(words) > 1 and known & LAYOUT_WORDS or known - FURNITURE_WORDS - OUTER_WORDS - PLAIN_WORDS:
                    continue
                found |= known
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.add("hidden")
    return found & (FURNITURE_WORDS | OUTER_WORDS), main, body


class Block:
    """inside: 2 in an article, 1 in a main element, else 0."""

    __slots__ = ("furniture", "heading", "inside", "links", "text", "words")

    def __init__(self, text: str, words: int, links: int, heading: bool, inside: int, furniture: bool):
        self.text, self.words, self.links, self.heading, self.inside, self.furniture = text, words, links, heading, inside, furniture


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the closed elements of a name end, by where they start; one without an end tag of its own is not among them."""
    opened: list[int] = []
    found: dict[int, int] = {}
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).finditer(page):
        if not m[1]:
            if not m[0].endswith("/>"):
                opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def blocks(page: str) -> list[Block]:
    """The page's text blocks, in order, with white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []  # open elements: name, inside, in furniture, of the strict kind
    open_names: Counter[str] = Counter()
    inside, furniture, strict = 0, False, False
    parts: list[str] = []
    linked: list[str] = []
    anchor, heading, at, n = 0, False, 0, len(page)
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()  # raw text elements without an end tag from here on

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(html.unescape(" ".join(linked)).split())
            words = len(text.split())
            out.append(Block(text, words, min(links, words), heading, inside, furniture))
        parts.clear()
        linked.clear()

    def leave(depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        nonlocal inside, furniture, strict
        for e in stack[depth:]:
            open_names[e[0]] -= 1
        del stack[depth:]
        inside, furniture, strict = stack[-1][1:] if stack else (0, False, False)

    match = TOKEN.match
    while at < n:
        m = match(page, at)
        if m is None:
            break
        at = m.end()
        text = m[7]
        if text is not None:
            parts.append(text)
            if anchor:
                linked.append(text)
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in SILENT_TAGS:
            if name == "head":
                continue  # its elements are silent themselves, and its end tag may be missing
            if not closing and not attributes.endswith("/"):
                if name in RAW_TEXT_TAGS:
                    end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                    if end is None:
                        endless.add(name)
                    after = n if name in CODE_TAGS else page.find("<", at)
                    at = end.end() if end else after if after >= 0 else n
                else:
                    if name not in ends:
                        ends[name] = _ends(page, name)
                    at = max(at, ends[name].get(m.start(), at))
            if name in ("button", "select", "textarea"):
                parts.append(" ")
            continue
        if name == "a":
            anchor = 0 if closing else 1
            continue
        if name in SPACE_TAGS and name != "hr":
            parts.append(" ")
            continue
        if name not in BLOCK_TAGS:
            continue
        flush()
        anchor = 0
        if name == "hr":
            continue
        if closing:
            heading = False
            if open_names[name] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                leave(depth)
            continue
        if stack and stack[-1][0] in PARAGRAPHS:  # a paragraph or heading ends where a block begins
            leave(len(stack) - 1)
        if name in IMPLIED_ENDS:
            same, scope = IMPLIED_ENDS[name]
            if any(open_names[e] > 0 for e in same):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in scope:
                        break
                    if stack[i][0] in same:
                        leave(i)
                        break
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in PARAGRAPHS and not attributes or name in ("html", "body"):
            continue  # closed by whatever follows
        names, main, body = _names(attributes) if attributes else (set(), False, False)
        if name in ("article", "main") or (main or body) and name in ("div", "section", "td") and not names:
            # What else names an article may be its subject.
            furniture = strict or bool(names & (STRICT_WORDS | ADVERT_WORDS))
            strict = strict or bool(names & STRICT_WORDS)
            inside = 2 if name == "article" or body else max(inside, 1)
        else:
            furniture = furniture or name in FURNITURE_TAGS or bool(names & FURNITURE_WORDS) or not inside and (name == "header" or bool(names & OUTER_WORDS))
            strict = strict or name == "aside" or bool(names & STRICT_WORDS)
        stack.append((name, inside, furniture, strict))
        open_names[name] += 1
    flush()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "heading", "place")


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """One row of FEATURES a block; beyond the page's ends a block counts as empty.

    place: 0 in furniture, 1 outside the article of a page that has one, 2 where nothing tells, 3 in a main element, 4 in an article.
    """
    plain = [(float(b.words), b.links / b.words) for b in page]
    around = [(0.0, 0.0), *plain, (0.0, 0.0)]
    outside = 1.0 if any(b.inside == 2 and not b.furniture for b in page) else 2.0
    place = [0.0 if b.furniture else outside if b.inside == 0 else b.inside + 2.0 for b in page]
    return [(*around[i + 1], *around[i], *around[i + 2], float(b.heading), place[i]) for i, b in enumerate(page)]


#: Each labelled page counts at these lengths; a leaf has so many blocks at least.
SCALES, LEAF = (0.8, 1.0, 1.3), 3
# The labelled table: pages as lists of (fragment, 1 for main text); {n} stands for n words, [n] for a link of n words.
LABELLED = [
    # Semantic elements and telling names.
    [("<nav><ul><li>[1]</li><li>[2]</li></ul></nav>", 0), ("<div class=ad>{9}</div>", 0), ("<article><h1>{8}</h1>", 1), ("<p>{60}</p><p>{3}</p><p>{25}</p>", 1), ("</article><footer>{12}</footer>", 0)],
    [("<header>[2]<div>{4}</div></header>", 0), ("<article><header><h1>{6}</h1></header><div>{3}</div><p>{40}</p><h2>{3}</h2><p>{80} [4]</p>", 1), ("<div class=share>[1]</div>", 0), ("<p>{2}</p></article>", 1), ("<aside class=sidebar><h3>{3}</h3><p>{30}</p></aside>", 0)],
    [("<div class=cookie-notice><p>{25}</p></div>", 0), ("<main><h1>{5}</h1><p>{30}</p><ul><li>{4}</li><li>{9}</li></ul><p>{45}</p></main>", 1), ("<section class=comments><h2>{2}</h2><p>{40}</p><p>{15}</p></section>", 0), ("<form><label>{3}</label></form>", 0)],
    [("<article><h1>{9}</h1><p>{22}</p><blockquote>{15}</blockquote><p>[5]</p><p>{1}</p><ul><li>[2]</li><li>[3]</li></ul>", 1), ("<div class=advert>{14}</div>", 0), ("<p>{55}</p><table><tr><td>{1}</td><td>{2}</td></tr></table><figcaption>{5}</figcaption></article>", 1), ("<article class=comment><p>{28}</p></article><article class=comment><p>{6}</p></article>", 0), ("<footer>{20}</footer>", 0)],
    [("<div class=x>[1] [1] [2]</div><div class=x>{4}</div>", 0), ("<article><p>{1}</p><div>{70}</div></article>", 1), ("<div class=y>{34}</div><div class=y><p>{26}</p><p>{48}</p></div><div>{3} [4]</div>", 0)],
    [("<main><div>[1] [1]</div><ul><li>[2]</li><li>[2]</li><li>[1]</li></ul>", 0), ("<h1>{7}</h1><p>{50}</p><p>{4}</p><p>{31} [3]</p>", 1), ("<div>[4]</div><div>[5]</div></main>", 0), ("<footer>[2] [2]</footer>", 0)],
    [("<ul class=menu><li>[1]</li><li>[1]</li></ul>", 0), ("<h1>{4}</h1><p>{120}</p><p>{18}</p><p>{33}</p>", 1), ("<div class=newsletter><p>{20}</p></div>", 0), ("<footer><p>{25}</p><p>[3]</p></footer>", 0)],
    [("<article>{4}</article>", 1)],
    [("<article><h1>{2}</h1><p>{1}</p><p>[3]</p></article>", 1), ("<div>{5}</div>", 0)],
    [("<div>[3]</div>", 0), ("<article><p>{35}</p><p>{2}</p><div>[1]</div><div>{3}</div><ul><li>[4]</li><li>[1]</li><li>{2}</li></ul><p>{1}</p></article>", 1)],
    [("<article><ul><li>[2]</li><li>[1]</li></ul><p>{5}</p><p>[2]</p><p>{12}</p><div>{2}</div></article>", 1), ("<div>[2]</div>", 0)],
    [("<article><div>{1}</div><h2>{1}</h2><div>[6]</div><p>{90}</p><p>{1}</p></article>", 1), ("<div>{40}</div><div>[1]</div><div>{1}</div>", 0)],
    [("<article><p>{8}</p></article>", 1), ("<nav>{30}</nav><aside><p>{60}</p><p>{40}</p></aside><form><p>{35}</p></form><footer>{50}</footer>", 0)],
    [("<div>{4}</div>", 0), ("<article><p>{30}</p><p>[4]</p><p>{2}</p></article>", 1)],
    [("<nav>[2]</nav>", 0), ("<article><p>{7}</p><p>{3} [3]</p><p>{28}</p><p>[5]</p><div>{9}</div><p>[1] {1}</p><div>{1}</div></article>", 1)],
    [("<article><p>[2]</p><p>{6}</p><p>{4} [3] {2}</p><p>{11}</p><p>{2} [1]</p><p>{40}</p><p>{3} [9]</p></article>", 1)],
    [("<p>[2]</p>", 0), ("<article><div>{3}</div><div>[3]</div><div>{5}</div><div>[2] {2}</div><div>{8}</div><div>[1]</div><div>{17}</div></article>", 1), ("<p>[2]</p>", 0)],
    [("<div>{12}</div><div>[1] [2]</div>", 0), ("<article><h2>{2}</h2><p>{1} [1]</p><p>{6}</p><p>[3]</p><p>{33}</p><table><tr><td>[1]</td><td>{1}</td><td>[2]</td><td>{7}</td></tr></table></article>", 1)],
    [("<main><p>{3}</p></main>", 1)],
    [("<main><p>{28}</p><p>{10} [1] {4}</p><p>{2}</p><div>{15}</div></main>", 1)],
    [("<main><h1>{2}</h1><p>{14}</p><p>{2}</p></main>", 1), ("<footer>{4}</footer>", 0)],
    [("<div class=menu>{22}</div>", 0), ("<main><p>{1}</p><p>{6}</p><p>{25}</p><div>{3}</div></main>", 1)],
    # Nothing is named: words and links have to tell.
    [("<p>{30}</p>", 1)],
    [("<p>{14}</p><p>{19}</p>", 1)],
    [("<h1>{3}</h1><p>{60}</p><p>{26}</p><p>{5}</p>", 1)],
    [("<div>{45}</div><div>{7}</div><div>{22}</div>", 1), ("<div>[1] [2]</div>", 0)],
    [("<div>[1]</div><div>[3]</div>", 0), ("<h2>{4}</h2><div>{21}</div><div>{36}</div>", 1)],
    [("<p>[1]</p><p>[1]</p>", 0)],
    [("<ul><li>[2]</li><li>[3]</li><li>[1]</li></ul><div>{2}</div>", 0)],
    [("<div>[2]</div><div>[1]</div>", 0), ("<h1>{7}</h1><p>{70}</p><p>{35}</p><p>{50}</p><p>{12}</p><p>{90}</p>", 1), ("<div>[6]</div><div>[2]</div><div>{4}</div>", 0)],
    [("<div>{2}</div><div>[1] [1] [2]</div>", 0), ("<div>{65}</div><div>{40}</div><div>{110}</div>", 1), ("<div>[3]</div><div>{3}</div>", 0)],
    [("<p>[1]</p><p>[1]</p>", 0), ("<h1>{6}</h1><p>{38}</p><p>{9}</p><p>{64}</p><p>{7}</p><p>{23}</p>", 1), ("<ul><li>[4]</li><li>[5]</li><li>[7]</li></ul>", 0), ("<p>{9}</p>", 0)],
    [("<table><tr><td>[2]</td><td>[1]</td><td>[2]</td></tr><tr><td>{1}</td>", 0), ("<td><p>{90}</p><p>{20}</p><p>{41} [2] {8}</p></td></tr>", 1), ("<tr><td>[3]</td><td>{5} [4]</td></tr></table>", 0)],
    [("<div>[1]</div><div>[2]</div><div>[1]</div>", 0), ("<div>{9}</div><div>{14}</div><div>{11}</div><div>{21}</div><div>{8}</div><div>{17}</div><div>{6}</div><div>{12}</div>", 1), ("<div>[3]</div><div>[2]</div><div>{8}</div>", 0)],
    [("<ul><li>[1]</li><li>[3]</li></ul><div>{3}</div>", 0), ("<h1>{5}</h1><p>{28}</p><h2>{3}</h2><p>{33}</p><p>{11} [1] {5}</p><h2>{2}</h2><p>{57}</p>", 1), ("<h3>{2}</h3><ul><li>[6]</li><li>[8]</li><li>[5]</li></ul><h3>{1}</h3><p>[2]</p><p>{11} [1]</p>", 0)],
    [("<div>{4}</div><div>[2] [2] [1] [2]</div><div>{2} [3]</div>", 0), ("<div>{130}</div>", 1), ("<div>{2} [2]</div><div>{5}</div><div>[1] [1] [3]</div>", 0)],
    [("<p>[2] {1} [2] {1} [2]</p>", 0), ("<h2>{9}</h2><p>{44}</p><p>{19}</p><ul><li>{8}</li><li>{6}</li><li>{13}</li></ul><p>{27}</p>", 1), ("<p>[9]</p><p>[12]</p><p>[10]</p><p>{6}</p>", 0)],
    [("<div>{1}</div><div>{2}</div><div>[2]</div>", 0), ("<p>{24} [3] {12}</p><p>{10}</p><p>{31}</p>", 1), ("<p>{2} [5]</p><p>{3} [6]</p>", 0), ("<div>{3}</div><div>{2}</div>", 0)],
    [("<p>{50}</p>", 1), ("<div>[4]</div><div>[3]</div>", 0), ("<p>{44}</p>", 1)],
    [("<ul><li>[1]</li><li>[2]</li></ul>", 0), ("<h1>{4}</h1><p>{62}</p>", 1), ("<p>[6]</p>", 0), ("<p>{31}</p>", 1)],
    [("<p>{36}</p><p>{24}</p>", 1), ("<div>[5]</div>", 0), ("<p>{58}</p>", 1), ("<div>[1] [2]</div><div>{7}</div>", 0)],
    [("<div>[1] [1]</div><h3>{2}</h3><div>[4]</div><div>[3]</div>", 0), ("<h1>{8}</h1><p>{52}</p><p>{16}</p><p>{75}</p>", 1), ("<h3>{3}</h3><p>[7]</p><p>[6]</p><div>{2}</div>", 0)],
]


def labelled_rows(table=None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled table's blocks."""
    rows, labels = [], []
    for page, scale in [(p, s) for p in (LABELLED if table is None else table) for s in SCALES]:
        run = lambda n: " ".join(["word"] * max(1, round(int(n) * scale)))  # noqa: B023, E731
        fill = [re.sub(r"\{(\d+)\}|\[(\d+)\]", lambda m: run(m[1]) if m[1] else f"<a href=/>{run(m[2])}</a>", f) for f, _ in page]
        rows += features(blocks("".join(fill)))
        labels += [label for f, (_, label) in zip(fill, page) for _ in blocks(f)]
    return np.array(rows), np.array(labels)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A CART tree: nested (feature, threshold, at most, above), or a leaf's label.  Splits lower the Gini impurity most."""
    ones = int(labels.sum())
    if depth == 0 or ones in (0, len(labels)):
        return int(2 * ones > len(labels))
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, k = rows[order, f], np.cumsum(labels[order])[:-1]
        n = np.arange(1, len(x))
        gini = k * (n - k) / n + (ones - k) * (len(x) - n - ones + k) / (len(x) - n)
        gini[(x[1:] == x[:-1]) | (n < LEAF) | (len(x) - n < LEAF)] = np.inf
        i = int(np.argmin(gini)) if len(gini) else 0
        if len(gini) and np.isfinite(gini[i]) and (best is None or gini[i] < best[0] - 1e-12):
            best = (gini[i], f, float(x[i] + x[i + 1]) / 2)
    if best is None:
        return int(2 * ones > len(labels))
    _, f, cut = best
    low = rows[:, f] <= cut
    sides = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return sides[0] if sides[0] in (0, 1) and sides[0] == sides[1] else (f, cut, *sides)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_rows())


def classify(node, row: tuple[float, ...]) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


#: Words of the run that stands for a page without main text, where the page has links or furniture besides.
LEAST_RUN = 8


def mostly_links(b: Block) -> bool:
    return 2 * b.links > b.words


def chosen(page: list[Block], model) -> list[bool]:
    """Which blocks are main text: the tree's choice, what lies inside it, or else the page's best run.

    Between two main blocks text belongs to them, such as a table's cells, unless it is mostly links or some of it is furniture; in an
    article or main element a single linked block does too.  The best run is that of the most words without furniture or links.
    """
    main = [bool(classify(model, row)) for row in features(page)]
    if not any(main):
        plain = [not b.furniture and not mostly_links(b) for b in page]
        runs, start = [], 0
        for i in range(len(page) + 1):
            if i == len(page) or not plain[i]:
                runs.append((sum(b.words for b in page[start:i]), -start, i))
                start = i + 1
        words, start, end = max(runs)
        if words >= (1 if all(plain) else LEAST_RUN):
            main[-start:end] = [True] * (end + start)
        return main
    held = [i for i, m in enumerate(main) if m]
    for a, b in zip(held, held[1:]):
        between = page[a + 1 : b]
        if between and not any(x.furniture for x in between):
            alone = len(between) == 1 and between[0].inside > 0
            main[a + 1 : b] = [alone or not mostly_links(x) for x in between]
    return main


def main_text(page: str | None, model=None) -> str:
    """Main text of a page, its blocks joined by an empty line; empty for null."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, main in zip(found, chosen(found, tree() if model is None else model)) if main)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages, and such without main text, give an empty text; repeated rows each give a row; further
    columns are dropped; a very long page is read whole.
    """
    model = tree()  # grown once, on the driver

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(batch.column(2)[i].as_py(), model) for i in range(batch.num_rows)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    wanted = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return wanted.mapInArrow(batches, f"page_id {kind}, url string, text string, n_chars bigint")
