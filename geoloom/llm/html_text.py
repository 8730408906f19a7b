"""Main text of web pages by tag-path ratios.

Text nodes are aggregated by their root-to-leaf tag path: mean length and mean punctuation of a path's nodes, and the share
of its text outside links. The two ratios are smoothed over the page's sequence of nodes and fused into one value; the
container with the most value is the article. Another container is content if its value reaches a share of the
article's. In the article only a path's text outside links is held against that share: by length and punctuation its lists
and short lines would go. Its headings stay. Paths through elements or roles of menus, footers, forms and the like have no
value; each class or id that names such a thing divides the value, so a name on what holds the article changes nothing.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHARE = 0.2  # of the article's value that makes another container content
NAMED = 0.05  # what is left of a path's value for each element of it with one of NAMES
# Elements and names that mark what is not main text.
OUTSIDE = set("nav footer aside form script style noscript template head title button select option optgroup datalist textarea input iframe "
              "frame frameset noframes svg math canvas object embed applet audio video dialog menu fieldset legend label output meter progress".split())
NAMES = set("ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner banners "
            "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pager pagination toolbar topbar masthead header footer foot colophon "
            "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular teaser share sharing social follow "
            "comment comments commentlist reply replies respond discussion disqus notice notices cookie cookies consent gdpr alert popup modal overlay "
            "newsletter subscribe subscription signup login signin register search searchform form copyright legal disclaimer skip hidden".split())
LAYOUT = set("list lists item items wrapper wrap container box boxes block blocks section area inner outer link links bar buttons button btn body content text title "
             "label unit slot panel row col column left right top bottom main posts articles stories icon icons count meta module region zone".split())
NOT = set("has have with without no not page".split())  # such a name is the layout's
PROSE = set("discussion search form share sharing social follow related popular trending recommended register alert legal copyright disclaimer notice notices "
            "reply replies promotion header foot rail skip hidden".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub "
             "sup time tt u var wbr".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote ul ol dl figure figcaption table tbody thead tfoot tr td th caption center header hgroup address".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = LEAVES | set("div section article main header footer nav aside form hr fieldset details summary body".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Once a quote isn't closed this form takes over, which never looks further than to the next >.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()()()", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


def outside(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in OUTSIDE or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def named(tag: str, attributes: str) -> bool:
    """Whether a class or id says that the element is one of NAMES. It may be the layout's name ('has-sidebar'), so it is no reason to drop what is inside.

    Of a hyphenated name the last word counts that isn't a mere word of layout: 'comment-list' is comments, 'share-price' a price. Headings
    have no such name, paragraphs none by their id; an id of a section is often made of its heading's words, so those in PROSE don't count.
    """
    if not attributes or tag in ("html", "body") or tag in HEADINGS:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        kind = name.lower()
        if kind == "class" or kind == "id" and tag != "p":
            for token in next((v for v in values if v), "").split():
                parts = [w.lower() for w in _NAME.findall(token)]
                head = next((w for w in reversed(parts) if w not in LAYOUT), "")
                if head in NAMES and NOT.isdisjoint(parts) and not (kind == "id" and tag == "section" and head in PROSE):
                    return True
    return False


class Paths:
    """Tag paths as a tree of numbers; what is asked of a path is worked out once, from its parent. Path 0 is empty."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.parent, self.depth, self.stars, self.container, self.block, self.article, self.marked, self.heading = [0], [0], [0], [0], [0], [0], [False], [False]

    def child(self, parent: int, tag: str, star: bool) -> int:
        number = self.numbers.setdefault((parent, tag, star), len(self.parent))
        if number == len(self.parent):
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.stars.append(self.stars[parent] + star)
            self.container.append(self.container[parent] if tag in INLINE or tag in LEAVES else number)  # without the blocks of text at its end
            self.block.append(self.block[parent] if tag in INLINE else number)
            self.article.append(self.article[parent] or number * (tag == "article"))  # the outermost one
            self.marked.append(self.marked[parent] or tag in ("article", "main"))
            self.heading.append(self.heading[parent] or tag in HEADINGS)
        return number

    def below(self, top: int) -> list[bool]:
        """Of each path, whether it is `top` or goes on from it."""
        out = []
        for k, parent in enumerate(self.parent):
            out.append(k == top or k > 0 and out[parent])
        return out


def text_nodes(page: str):
    """(its paths, (block, path, out, linked, text) of each text node): out says that its path has no value, linked that it's in a link."""
    paths, nodes = Paths(), []
    stack: list[tuple[str, int, bool]] = []  # element, its path, whether it or an outer one is outside
    places: dict[str, list[int]] = defaultdict(list)  # of each element, where it is on the stack
    block, at = 0, 0
    last = lambda *tags: max((places[t][-1] for t in tags if places[t]), default=-1)

    def put(raw: str):
        if raw:
            header = bool(places["header"]) and not any(places[h] for h in HEADINGS)
            nodes.append((block, stack[-1][1] if stack else 0, bool(stack) and stack[-1][2] or header, bool(places["a"]), html.unescape(raw)))

    def cut(size: int):
        while len(stack) > size:
            places[stack.pop()[0]].pop()

    pattern, final = _TOKEN, page.rfind(">")
    # After the last > no tag ends, so nothing is searched for there; only a comment or declaration may go on to the page's end.
    while found := pattern.search(page, at, final + 1):
        put(page[at:found.start()])
        at = found.end() if found[0].endswith(">") else len(page)
        end, tag, attributes = (found[k] or found[k + 3] or "" for k in (1, 2, 3))
        if found[5]:  # a quote isn't closed: from here on tags end at their next >, so none is searched for twice
            pattern = _PLAIN
        tag = tag.lower()
        if not tag:
            continue
        if tag not in INLINE:
            block += 1
        if end:
            if places[tag]:
                cut(places[tag][-1])
            continue
        if tag in CLOSES_P and places["p"]:
            cut(last("p"))
        if tag in ("article", "main") and places["nav"]:
            cut(last("nav"))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and places[tag] and last("ul", "ol", "dl", "table") < last(tag):
            cut(last(tag))
        if tag in HEADINGS and stack and stack[-1][0] in HEADINGS:
            cut(len(stack) - 1)
        out = bool(stack) and stack[-1][2] or outside(tag, attributes, bool(places["article"] or places["main"]))
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        if tag in RAW:
            finish = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = finish.end() if finish else len(page)
            continue
        places[tag].append(len(stack))
        stack.append((tag, paths.child(stack[-1][1] if stack else 0, tag, named(tag, attributes)), out))
    rest = page[at:]
    put(rest[:rest.find("<!")] if "<!" in rest else rest)
    return paths, nodes


def smooth(values: np.ndarray) -> np.ndarray:
    """Means over three neighbours, the middle one counting double."""
    wide = np.concatenate((values[:1], values, values[-1:]))
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


def main_text(page: str | None) -> tuple[str, int]:
    """(main text, its blocks) of a page."""
    paths, every = text_nodes(page or "")
    nodes = [n for n in every if not n[2]]
    kept = [n for n in nodes if not n[4].isspace()]
    if not kept:
        return "", 0
    length = np.array([len(n[4].strip()) for n in kept], float)
    marks = np.array([len(_PUNCTUATION.findall(n[4])) for n in kept], float)
    plain = np.array([0.0 if n[3] else 1.0 for n in kept]) * length
    _, path = np.unique([n[1] for n in kept], return_inverse=True)
    count = np.bincount(path)
    mean = lambda v: (np.bincount(path, v) / count)[path]
    share = lambda k: NAMED ** paths.stars[k]
    value = smooth(mean(length)) * (1 + smooth(mean(marks))) * mean(plain) / np.maximum(mean(length), 1) * np.array([share(n[1]) for n in kept])

    total: dict[int, list[float]] = {}
    for n, v, chars in zip(kept, value, length):
        entry = total.setdefault(paths.container[n[1]], [0.0, 0.0])
        entry[0] += v * chars
        entry[1] += chars
    marked = {c for c in total if paths.marked[c]} or set(total)
    best = max((c for c in total if c in marked), key=lambda c: (total[c][0], -paths.depth[c]))
    best = paths.article[best] or best  # sections of an article belong together
    below = paths.below(best)
    top = max(total[c][0] / total[c][1] for c in total if below[c])
    content = {c for c, (v, chars) in total.items() if not below[c] and c in marked and v / chars >= SHARE * top}
    # In the article: the text outside links of each path of blocks, against that of the path with the most value.
    inside: dict[int, list[float]] = {}
    for n, v, chars, free in zip(kept, value, length, plain):
        if below[n[1]]:
            entry = inside.setdefault(paths.block[n[1]], [0.0, 0.0, 0.0])
            entry[0] += v * chars
            entry[1] += free
            entry[2] += chars
    worth = lambda k, block: share(k) * inside[block][1] / inside[block][2]
    lead = max((b for b in inside if not paths.heading[b]), key=lambda b: inside[b][0], default=None)
    least = SHARE * worth(lead, lead) if lead is not None else 0

    def chosen(k):
        block, container = paths.block[k], paths.container[k]
        if not below[container] or block not in inside:
            return container in content or below[container]
        return share(k) >= least if paths.heading[block] else worth(k, block) >= least

    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if chosen(n[1]):
            blocks.setdefault(n[0], []).append(n[4])
    lines = [x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x]
    return " ".join(lines), len(lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page (page_id, url, html): page_id, url, text, n_chars (code points) and n_blocks.

    A null or empty page, or one without main text, has an empty text. Nulls in page_id and url stay; repeated rows are
    worked on each; other columns are not read. Pages may be malformed: open elements are closed as browsers do.
    """
    def run(batches):
        for batch in batches:
            found = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()),
                 pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
