"""Main text of web pages by minimum-cut labelling of their blocks.

A page is parsed into text blocks.  A logistic classifier prices both labels of each block; the
prices become capacities from the source (content) and to the sink (boilerplate).  Neighbouring
blocks and blocks close in the document tree are tied by smoothness edges.  A maximum flow
gives the minimum cut, and the blocks on the source side are the main text.

The classifier is trained on a bounded sample of pages (TRAIN_PAGES, those of least hash) and at most
TRAIN_BLOCKS blocks of each, spread over the whole page, whose blocks inside article or main elements count as content and those inside nav, aside, footer,
form and the like as boilerplate; half of its training rows have the element figures blanked,
so that it also prices pages without such elements.  A few fixed rows make it defined on any
sample.

Defined results: a null page is empty; a page without content has the empty text; repeated rows are
extracted one by one; broken markup is read as browsers do (open elements are closed by what
cannot stand in them).
"""
from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricesieve.llm.common import spread

TRAIN_PAGES = 300
TRAIN_BLOCKS = 100
#: Largest price of a label, and the smoothness of neighbours with the same and another parent.
MAX_PRICE = 12.0
SAME_PARENT, OTHER_PARENT = 1.0, 0.25

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section
summary table tbody td tfoot th thead title tr ul""".split())
#: Elements whose text is never shown as text.
UNSHOWN = frozenset("""head script style template noscript title textarea select option datalist button svg math iframe
object canvas audio video noframes""".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form header menu dialog search fieldset".split())
#: Words of class, id and role names.
BOILERPLATE_NAMES = re.compile(r"""(?:^|[-_\s])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|
popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|sidebar|side|menu|nav|navbar|
navigation|breadcrumbs?|footer|foot|header|masthead|comments?|commentlist|reply|replies|respond|disqus|widget|pagination|pager|
search|legal|copyright|toolbar|skip|contentinfo|complementary|dialog|form|hidden|print)(?:$|[-_\s])""", re.I | re.X)
CONTENT_NAMES = re.compile(r"(?:^|[-_\s])(?:article|articlebody|post|entry|story|content|main|body|text|prose)(?:$|[-_\s])", re.I)
#: An open element is closed by the start of these.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main section div body td th li aside nav footer header form".split())
PARTS = frozenset("ul ol dl li dd table tbody thead tfoot tr td th blockquote".split())
SPACE = re.compile(r"\s+")

FIGURES = ("content_inside", "boilerplate_inside", "content_any", "boilerplate_any", "log_words", "link_share",
           "sentence_marks", "commas", "long_words", "copyright", "heading", "paragraph", "list_item", "short", "bias")
N_ELEMENT = 4


class _Blocks(HTMLParser):
    """Collects (text, link characters, path) of the blocks in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int, int]] = []  # (tag, hint: 1 content, -1 boilerplate, 0; number)
        self.blocks: list[tuple[str, int, list[tuple[str, int, int]]]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.unshown = self.number = 0

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((text, self.linked, list(self.path)))
            self.parts, self.linked = [], 0

    def _hint(self, tag: str, attrs) -> int:
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        if tag in CONTENT_TAGS:
            return 1 if not names or not BOILERPLATE_NAMES.search(names) else -1
        if tag in ("body", "html"):
            return 0
        if tag == "header" and any(t in CONTENT_TAGS for t, _, _ in self.path):
            return 0
        if tag in BOILERPLATE_TAGS or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return -1
        if names:
            return -1 if BOILERPLATE_NAMES.search(names) else int(bool(CONTENT_NAMES.search(names)))
        return 0

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.path[at:]:
            self.unshown -= tag in UNSHOWN
            self.links -= tag == "a"
        del self.path[at:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCK:
            self.end_block()
            self._close("p", SCOPE)
            for open_tag, starters in CLOSED_BY.items():
                if tag in starters:
                    self._close(open_tag, frozenset(("ul", "ol", "dl", "table")))
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self._close("a", SCOPE)
        if tag in VOID:
            return
        if tag == "body":
            self._close("head", frozenset())
        self.number += 1
        self.path.append((tag, self._hint(tag, attrs), self.number))
        self.unshown += tag in UNSHOWN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stop: frozenset) -> None:
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                return self._pop(i)
            if self.path[i][0] in stop:
                return None

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK:
            self.end_block()
        elif tag == "br":
            self.parts.append(" ")
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i][0] == tag:
                return self._pop(i)
            if tag not in BLOCK and self.path[i][0] in SCOPE:
                return None

    def handle_data(self, data) -> None:
        if not self.unshown:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[tuple[str, int, list[tuple[str, int, int]]]]:
    """(text, characters inside links, path of (tag, hint, number)) of each text block."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    return parser.blocks


def figures_of(blocks) -> np.ndarray:
    """The classifier's figures of each block."""
    out = np.zeros((len(blocks), len(FIGURES)))
    for i, (text, linked, path) in enumerate(blocks):
        hints = [h for _, h, _ in path if h]
        nearest, tag = (hints[-1] if hints else 0), next((t for t, _, _ in reversed(path) if t in BLOCK), "")
        words = text.count(" ") + 1
        out[i] = (nearest > 0, nearest < 0, 1 in hints, -1 in hints, np.log1p(words), min(1.0, linked / max(1, len(text))),
                  min(3, sum(map(text.count, ".!?"))), min(3, text.count(",")), len(text) / words / 10,
                  "©" in text, tag[:1] == "h" and tag[1:].isdigit(), tag == "p", tag in ("li", "td", "dt", "dd"),
                  words < 4, 1)
    return out


#: Rows that every training set holds: (content_inside, boilerplate_inside, content_any,
#: boilerplate_any, log_words, link_share) and the label.
FIXED_ROWS = [((1, 0, 1, 0, 3, 0), 1), ((1, 0, 1, 0, 1, 0), 1), ((1, 0, 1, 1, 2, 0), 1), ((0, 1, 0, 1, 3, 0), 0),
              ((0, 1, 1, 1, 3, 0), 0), ((0, 1, 0, 1, 1, 1), 0), ((0, 0, 0, 0, 4, 0), 1), ((0, 0, 0, 0, 1, 1), 0),
              ((0, 0, 0, 0, 2.5, 0.9), 0)]


def train(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier; both classes weigh the same."""
    fixed = np.zeros((len(FIXED_ROWS), len(FIGURES)))
    for i, (values, _) in enumerate(FIXED_ROWS):
        fixed[i, :len(values)] = values
    fixed[:, -1] = 1
    blank = rows.copy()
    blank[:, :N_ELEMENT] = 0
    few = max(1, len(rows) // 20)
    x = np.vstack([rows, blank, np.repeat(fixed, few, axis=0)])
    y = np.concatenate([labels, labels, np.repeat([y for _, y in FIXED_ROWS], few)]).astype(float)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + 1e-4 * w)
    return w


def fit(pages: DataFrame) -> np.ndarray:
    """Train on the blocks of a bounded sample of pages."""
    sample = (pages.where("html IS NOT NULL").select(F.xxhash64("page_id").alias("h"), "page_id", "html")
              .orderBy("h", "page_id").limit(TRAIN_PAGES))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, labels = [], []
            for html in b.column("html").to_pylist():
                own = figures_of(blocks_of(html))
                own = own[spread(len(own), TRAIN_BLOCKS)]
                sure = own[:, 0] + own[:, 1] > 0
                rows.append(own[sure].astype("<f8").tobytes())
                labels.append(own[sure, 0].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.binary())], names=["x", "y"])

    found = sorted((bytes(r.x), bytes(r.y)) for r in sample.select("html").mapInArrow(run, "x binary, y binary").collect())
    return train(np.concatenate([np.frombuffer(x) for x, _ in found] or [np.empty(0)]).reshape(-1, len(FIGURES)),
                 np.concatenate([np.frombuffer(y) for _, y in found] or [np.empty(0)]))


def ties(blocks) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the one before it, and with the last block before it
    that has the same parent element."""
    out, last = [], {}
    for i, (_, _, path) in enumerate(blocks):
        # the parent of a block's own element, through lists and tables
        own = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] in BLOCK), 0)
        parent = next((path[k][2] for k in range(own - 1, -1, -1) if path[k][0] not in PARTS), 0)
        at = last.get(parent)
        if i:
            out.append((i - 1, i, SAME_PARENT if at == i - 1 else OTHER_PARENT))
        if at is not None and at != i - 1:
            out.append((at, i, SAME_PARENT))
        last[parent] = i
    return out


def minimum_cut(prices: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the prices paid and the edges cut.  ``prices``:
    what the label content is cheaper by.  Maximum flow by shortest augmenting levels
    (Dinic), without recursion."""
    n = len(prices)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, p in enumerate(prices):
        if p > 0:
            add(source, i, float(p), 0.0)
        else:
            add(i, sink, float(-p), 0.0)
    for a, b, w in edges:
        if w > 0:
            add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in near[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= tiny)
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while turn[at] < len(near[at]):
                e = near[at][turn[at]]
                if room[e] > tiny and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(near[at]):
                path.append(near[at][turn[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                at = to[path.pop() ^ 1]
                turn[at] += 1


def main_text(html: str | None, weights: np.ndarray) -> str:
    """Main text of one page: its content blocks, joined by newlines."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    prices = np.clip(figures_of(blocks) @ weights, -MAX_PRICE, MAX_PRICE)
    return "\n".join(b[0] for b, keep in zip(blocks, minimum_cut(prices, ties(blocks))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(h, shared.value) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
