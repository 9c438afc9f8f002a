"""Main-text extraction by minimum cut.

A page becomes a list of text blocks, each with the chain of elements it lies
in. A logistic classifier, fitted on a bounded set of generated pages
(``html_examples``: EXAMPLES of them, whatever the input), turns a block's chain,
link density, length and punctuation into a probability; the negative logarithms
of both labels' probabilities are the block's capacities to the two terminals.
Neighbouring blocks and blocks of one parent element are tied by smoothness
edges on the same scale, whose capacities are those of the best token F1 on
generated pages that the classifier has not seen, and never 0. The maximum flow gives the
cheapest labelling, and the blocks on the source's side are the main text.

Defined results: a null or empty page, or one without content, gives an empty
text and 0 characters; text without any tag is content; an element left open
ends with its parent (script: with the page; style, textarea and title: at the next tag), and
what it holds is then read even if its kind is not, so a missing end of a
canvas or noscript loses no article; what an attribute hides (hidden,
aria-hidden=true, style display:none) is not read; white space of any kind
inside a block is one space; a page of any length is read whole; repeated rows
are extracted alike; an empty table gives no rows; a column named as the
result is replaced, all others are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwork.llm._chunks import slices
from gridwork.llm._common import in_batches

TOKEN = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>|[^>]*>)))""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
EACH = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"hidden|display", re.I)  # an element without either word is shown
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Fixed values of HTML: elements without content, with raw text, with other content than text, and within a line of text (of MathML too).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNREAD = frozenset("noscript template svg iframe object canvas select option datalist head annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd semantics".split())
#: Elements that a block's start, or the start of one of the named, ends.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option", "optgroup"}, "head": {"body"}}

#: Features of a block's chain: elements, and words of their class, id or role by group.
TAGS = "article main section p blockquote pre figcaption nav footer aside form menu dialog header button fieldset address ul ol table".split()
WORDS = {
    "content": "article content post story entry main body text".split(),
    "ads": "ad ads advert advertisement sponsor sponsored promo banner widget".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs sidebar complementary pagination pager toolbar search skip tags".split(),
    "head": "footer header masthead topbar copyright legal contentinfo".split(),
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert login signup newsletter subscribe".split(),
    "comment": "comment comments disqus reply replies respond discussion".split(),
    "social": "share social related recommended".split(),
}
GROUP_OF = {w: g for g, words in WORDS.items() for w in words}
#: Further features: heading, no element or word of the above, share of linked characters, length, end mark, and the constant.
FEATURES = [*TAGS, *WORDS, "heading", "bare", "links", "length", "mark", "one"]
PLACE = {f: i for i, f in enumerate(FEATURES)}
#: Features that speak for content; share of the page's text that an element around it has, and length of a block that may be prose.
SPEAKING_FOR = frozenset(PLACE[f] for f in ("article", "main", "section", "p", "blockquote", "pre", "figcaption", "content", "heading"))
NEARLY, PROSE = 0.85, 80
#: Elements that may hold the whole page or its article: a word of their class never counts against them.
WHOLE = frozenset("html body main article".split())
#: Generated pages (half to fit on, half to choose the edges' capacities on), and capacities to choose from.
EXAMPLES, CAPACITIES = 800, (0.25, 0.5, 1.0, 1.5, 2.0)


def words_of(attributes: str) -> list[str]:
    return [w.lower() for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(m[2] or m[3] or m[4] or "")]


def is_hidden(attributes: str) -> bool:
    """Whether an element says by an attribute of its own that it isn't shown."""
    if not HIDDEN.search(attributes):
        return False
    for m in EACH.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            return True
        if name == "style" and any("".join(x.split()) in ("display:none", "display:none!important") for x in value.split(";")):
            return True
    return False


def marks_of(tag: str, attributes: str) -> tuple[int, ...]:
    """Features that one element gives the blocks in it: its name, and of its words the first group that speaks against content, else content."""
    found = [PLACE[tag]] if tag in PLACE else []
    if "=" in attributes:
        groups = {GROUP_OF[w] for w in words_of(attributes) if w in GROUP_OF}
        against = sorted(groups - {"content"})
        if against and tag not in WHOLE:
            found.append(PLACE[against[0]])
        elif "content" in groups:
            found.append(PLACE["content"])
    return tuple(found)


def blocks_of(page: str) -> list[tuple[str, frozenset[int], float, int]]:
    """Blocks in page order: text, features of its chain, share of linked characters, number of its parent element."""
    found: list[tuple[str, tuple, float, int]] = []  # with the elements that say something, each with its number
    stack: list[tuple[str, tuple[int, ...], int, int, int]] = []  # open elements: name, features, number; blocks and link before it
    parts: list[str] = []
    linked, in_link, count, at, n = 0, 0, 0, 0, len(page)
    hidden_at = -1
    heading = PLACE["heading"]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and hidden_at < 0:
                marks = tuple((x[2], x[1]) for x in stack if x[1])
                parent = next((x[2] for x in reversed(stack) if x[0] not in BLOCKS), 0)
                found.append((text, marks, min(1.0, linked / len(text)), parent))
        linked = 0

    def close(k: int, take_back: bool) -> None:
        """Ends the open elements from place k on; with ``take_back`` what they hold is not read."""
        nonlocal hidden_at, in_link
        if take_back:
            del found[stack[k][3] :]
            in_link = stack[k][4]
        del stack[k:]
        if hidden_at >= len(stack):
            hidden_at = -1

    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            segment = page[at:end]
            if "&" in segment:
                segment = unescape(segment)
            parts.append(segment)
            if in_link:
                linked += len(segment.strip())
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
        elif m[1]:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k, name in UNREAD)
                    break
        elif name in RAW:
            flush()
            if not m[3].endswith("/>"):
                tail = _CLOSE[name].search(page, at)
                if tail:
                    at = tail.end()
                else:  # left open: a script takes the rest, others end at the next tag
                    after = TOKEN.search(page, at) if name != "script" else None
                    at = after.start() if after else n
        else:
            flush()
            if stack and stack[-1][0] in BLOCKS:
                close(len(stack) - 1, False)
            while stack and name in ENDED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1, stack[-1][0] in ("option", "head"))
                if name == "tr" or not stack:
                    continue
                break
            if name not in VOID and not m[3].endswith("/>"):
                count += 1
                if hidden_at < 0 and len(m[3]) > 6 and is_hidden(m[3]):
                    hidden_at = len(stack)
                marks = marks_of(name, m[3])
                stack.append((name, (*marks, heading) if name in BLOCKS and name != "p" else marks, count, len(found), in_link))
    flush()
    return _without_wrappers(found)


def _without_wrappers(found: list[tuple[str, tuple, float, int]]) -> list[tuple[str, frozenset[int], float, int]]:
    """Blocks with the features of their chains. What an element around nearly all text says against it is not counted, if there is prose in it:
    a form around the page, a nav without an end, or a wrapper whose class happens to name a share price is no sign of boilerplate."""
    total = sum(len(b[0]) for b in found)
    held: dict[int, int] = {}
    for text, chain, _, _ in found:
        for number, _ in chain:
            held[number] = held.get(number, 0) + len(text)
    prose = {number for text, chain, links, _ in found if len(text) >= PROSE and links < 0.3 and text[-1] in _END_MARKS for number, _ in chain}
    around = {number for number, size in held.items() if size >= NEARLY * total and number in prose}
    kept = lambda number, marks: (i for i in marks if number not in around or i in SPEAKING_FOR)
    return [(text, frozenset(i for number, marks in chain for i in kept(number, marks)), links, parent) for text, chain, links, parent in found]


_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_END_MARKS = ".!?…\"'”»:;。"


def features_of(block: tuple[str, frozenset[int], float, int]) -> list[tuple[int, float]]:
    """A block's features that are not 0."""
    text, marks, links, _ = block
    out = [(i, 1.0) for i in marks]
    if not marks:
        out.append((PLACE["bare"], 1.0))
    return [*out, (PLACE["links"], links), (PLACE["length"], min(1.0, len(text) / 200)), (PLACE["mark"], float(text[-1] in _END_MARKS)), (PLACE["one"], 1.0)]


def log_odds(block: tuple[str, frozenset[int], float, int], weights: list[float]) -> float:
    """The classifier's log-odds for content: the difference of the costs of the two labels."""
    return sum(weights[i] * x for i, x in features_of(block))


def fitted(examples: list[list[tuple[str, frozenset[int], float, int]]]) -> list[float]:
    """Weights of a logistic regression with an L2 penalty on labelled blocks, by Newton's method; a block's label is its text's first letter."""
    import numpy as np

    blocks = [b for page in examples for b in page]
    x = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(x, blocks):
        for i, v in features_of(b):
            row[i] = v
    y = np.array([b[0][0] == "c" for b in blocks], float)
    w = np.zeros(len(FEATURES))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def edges_of(blocks: list[tuple[str, frozenset[int], float, int]], next_to: float, same_parent: float) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i and next_to:
            edges.append((i - 1, i, next_to))
        j = last.get(block[3])
        if j is not None and same_parent:
            edges.append((j, i, same_parent))
        last[block[3]] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, by blocking flows over shortest paths.

    ``odds`` is a node's capacity from the source less that to the sink: what both
    have in common flows through in any case. Of all minimum cuts it is the one
    with the fewest nodes on the source's side.
    """
    n, tiny = len(odds), 1e-9
    excess = list(odds)
    near: list[list[int]] = [[] for _ in range(n)]  # places of arcs in head and left; an arc and its reverse are neighbours
    head: list[int] = []
    left: list[float] = []
    for a, b, c in edges:
        near[a].append(len(head))
        near[b].append(len(head) + 1)
        head += (b, a)
        left += (c, c)
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if excess[i] > tiny]
        for i in queue:
            level[i] = 0
        depth = -1  # of the nearest node that can still take something
        for i in queue:
            if 0 <= depth <= level[i]:
                break
            for e in near[i]:
                j = head[e]
                if left[e] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
                    if excess[j] < -tiny and depth < 0:
                        depth = level[j]
        if depth < 0:
            return [x >= 0 for x in level]
        arc = [0] * n
        for root in queue:
            if level[root]:
                break
            path: list[int] = []
            i = root
            while excess[root] > tiny:
                if excess[i] < -tiny and path:
                    flow = min(excess[root], -excess[i], *(left[e] for e in path))
                    excess[root] -= flow
                    excess[i] += flow
                    for e in path:
                        left[e] -= flow
                        left[e ^ 1] += flow
                    path.clear()
                    i = root
                    continue
                while arc[i] < len(near[i]):
                    e = near[i][arc[i]]
                    if left[e] > tiny and level[head[e]] == level[i] + 1 and level[head[e]] <= depth:
                        break
                    arc[i] += 1
                else:
                    if not path:
                        break
                    i = head[path.pop() ^ 1]
                    arc[i] += 1
                    continue
                path.append(e)
                i = head[e]


def tokens_f1(kept: list[tuple[list, list[bool]]]) -> float:
    """F1 of the words of blocks kept, against blocks whose text begins with c."""
    right = found = want = 0
    for blocks, side in kept:
        for b, keep in zip(blocks, side):
            size = b[0].count(" ") + 1
            found += size * keep
            want += size * (b[0][0] == "c")
            right += size * (keep and b[0][0] == "c")
    return 2 * right / max(1, found + want)


_MODEL: list[tuple[list[float], float, float]] = []


def model() -> tuple[list[float], float, float]:
    """Weights, and the capacities of edges between neighbours and between the nearest blocks of one parent; made once per process."""
    if not _MODEL:
        from gridwork.llm.html_examples import pages

        examples = [blocks_of(p) for p in pages(EXAMPLES, 5, WORDS)]
        weights = fitted(examples[: EXAMPLES // 2])
        rest = [(b, [log_odds(x, weights) for x in b]) for b in examples[EXAMPLES // 2 :]]
        best = max(((tokens_f1([(b, min_cut(o, edges_of(b, x, y))) for b, o in rest]), -x - y, x, y) for x in CAPACITIES for y in CAPACITIES))
        _MODEL.append((weights, best[2], best[3]))
    return _MODEL[0]


def extract(page: str | None, fit: tuple[list[float], float, float] | None = None) -> str:
    """The main text of one page."""
    blocks = blocks_of(page or "")
    weights, next_to, same_parent = fit or model()
    if not any(b[1] for b in blocks):  # no element says anything
        return " ".join(b[0] for b in blocks)
    side = min_cut([log_odds(b, weights) for b in blocks], edges_of(blocks, next_to, same_parent))
    return " ".join(b[0] for b, keep in zip(blocks, side) if keep)


def main_text(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """Every column of ``pages`` and ``to``: the main text of the whole page."""
    fit = model()
    pages = pages.drop(to) if to != html else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            found = [extract(x, fit) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, to])

    return in_batches(pages, run, schema)


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = main_text(pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
