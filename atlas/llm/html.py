"""HTML extraction by a recurrent block labeller: a numpy bidirectional LSTM reads a page's leaf blocks in order and labels each."""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_hash, give_back

# Elements without content, elements whose content is no text, elements that begin and end blocks, and what ends an open one.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg iframe select noframes".split())
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Names of elements, classes and ids that tell what a part of a page is; used to label training pages only.
REST = set("nav menu navbar navigation header masthead footer aside sidebar ad ads advert advertisement promo sponsored banner cookie cookies consent notice alert form comments comment reply disqus breadcrumb breadcrumbs share social related newsletter popup modal widget button dialog".split())
MAIN = set("article main content post entry story".split())

NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[a-z]+")
STOP, MARKS = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

PATH, WORDS, SIZES = 192, 32, 5
INPUTS, HIDDEN = PATH + WORDS + SIZES, 24
#: Pages that the labeller is trained on, by a hash of their html; their versions, passes over them, and pages of one step.
PAGES, VERSIONS, EPOCHS, BATCH = 240, 5, 12, 32
#: Nested elements of a training page at most.
DEEP = 200
#: Blocks that are read side by side: pages of like length go together, so many that this bound holds, or one longer page.
SIDE = 16_384


class Path:
    """An element on the way to a block and those around it; blocks share what they have in common. bits: the hashed names of all of them."""

    __slots__ = ("around", "element", "bits", "depth")

    def __init__(self, around: Path | None, element: tuple[str, ...]):
        self.around, self.element, self.depth = around, element, around.depth + 1 if around else 1
        self.bits = around.bits if around else 0
        for name in element:
            self.bits |= 1 << zlib.crc32(name.encode()) % (PATH - 64)

    def elements(self) -> list[tuple[str, ...]]:
        """Element names with their classes and ids, outermost first."""
        out, at = [], self
        while at:
            out.append(at.element)
            at = at.around
        return out[::-1]


def path_of(elements: list[tuple[str, ...]]) -> Path | None:
    out = None
    for element in elements:
        out = Path(out, element)
    return out


@dataclass
class Leaf:
    text: str
    path: Path | None
    linked: int = 0


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """begin, end, name, whether it ends an element, and attributes of each tag; of comments, declarations and raw elements with their content the name is empty.

    A tag ends at the first > outside quotes; where there is none, its < is text. What a < needs to know of the rest of the page is looked up
    in tables that are filled once, so a page of any kind is read in time proportional to its length.
    """
    marks = [m.start() for m in MARKS.finditer(page)]
    closing: list[int] = [-1] * (len(marks) + 1)  # for each mark the > that ends a tag whose attributes go on there, or -1
    later: dict[str, int] = {}  # number of the next mark of each kind
    for k in range(len(marks) - 1, -1, -1):
        kind = page[marks[k]]
        if kind == ">":
            closing[k] = marks[k]
        elif kind in later:
            closing[k] = closing[later[kind] + 1]
        later[kind] = k
    last, stop, at = page.rfind(">"), -1, 0
    while 0 <= (begin := page.find("<", at)) < last:
        at = begin + 1
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = len(page) if end < 0 else end + 3
            yield begin, end, "", False, ""
            at = end
            continue
        if page[at] in "!?":
            end = page.find(">", at) + 1
            yield begin, end, "", False, ""
            at = end
            continue
        ends = page[at] == "/"
        name = at + ends
        if not page[name : name + 1].isascii() or not page[name : name + 1].isalpha():
            continue
        if stop < name:
            found = STOP.search(page, name)
            stop = found.start() if found else len(page)
        k = bisect.bisect_left(marks, stop)
        end = closing[k] + 1
        if not end:
            continue
        tag, rest = page[name:stop].lower(), page[stop : end - 1]
        if not ends and tag in RAW:
            if tag != "svg" or not rest.endswith("/"):
                close = RAW_END[tag].search(page, end)
                end = close.end() if close else len(page)
            tag = ""
        yield begin, end, tag, ends, rest
        at = end


class _Stack:
    """Open elements, with the places of each name and of the blocks among them."""

    def __init__(self):
        self.held: list[Path] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def top(self) -> Path | None:
        return self.held[-1] if self.held else None

    def name(self) -> str:
        return self.held[-1].element[0] if self.held else ""

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, element: tuple[str, ...]) -> None:
        if element[0] in BLOCKS:
            self.blocks.append(len(self.held))
        self.places.setdefault(element[0], []).append(len(self.held))
        self.held.append(Path(self.top(), element))

    def cut(self, size: int) -> None:
        while len(self.held) > size:
            self.places[self.held.pop().element[0]].pop()
            if self.blocks and self.blocks[-1] == len(self.held):
                self.blocks.pop()


def leaves(page: str) -> list[Leaf]:
    """The page's blocks of text in order, character references decoded and white space folded. Raw elements and comments have no text."""
    out: list[Leaf] = []
    stack, parts, linked = _Stack(), [], 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Leaf(text, stack.top(), linked))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) if stack.last("a") >= 0 else 0

    at = 0
    for begin, end, tag, ends, rest in tags(page):
        add(page[at:begin])
        at = end
        if not tag:
            continue
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ends:
            i = stack.last(tag)  # an inline element's end reaches no further than the block around it
            if i >= 0 and (block or not stack.blocks or i > stack.blocks[-1]):
                stack.cut(i)
        else:
            if block and tag != "hr":
                stack.cut(stack.blocks[-1] + 1 if stack.blocks else 0)  # inline elements don't hold blocks
                if stack.name() == "p":
                    stack.cut(len(stack.held) - 1)
            if tag in CLOSES and stack.name() in CLOSES[tag]:
                stack.cut(len(stack.held) - 1)
            if tag not in VOID and not rest.endswith("/"):
                names = " ".join(a or b or c for a, b, c in NAMES.findall(rest)) if rest else ""
                stack.push((tag, *WORD.findall(names.lower())))
    add(page[at:])
    flush()
    return out


def features(page: list[Leaf]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, sizes."""
    out = np.zeros((len(page), INPUTS), np.float32)
    seen: dict[int, list[int]] = {}
    for i, leaf in enumerate(page):
        if leaf.path:
            if leaf.path.bits not in seen:
                seen[leaf.path.bits] = [k for k in range(PATH - 64) if leaf.path.bits >> k & 1]
            out[i, seen[leaf.path.bits]] = 1
            out[i, PATH - 64 + zlib.crc32(leaf.path.element[0].encode()) % 64] = 1
        words = leaf.text.lower().split()
        at = [PATH + zlib.crc32(w.encode()) % WORDS for w in words]
        bag = np.bincount(at, minlength=INPUTS)
        out[i] += bag / (bag @ bag) ** 0.5
        n = len(leaf.text)
        out[i, -SIZES:] = (np.log1p(n) / 8, min(1.0, leaf.linked / n), sum(leaf.text.count(c) for c in ".!?") / len(words), i / len(page), 1.0)
    return out


def hints(page: list[Leaf]) -> np.ndarray:
    """Training labels: 1 for blocks in a part that a name calls the main one and in none of the rest. Where no name tells, for blocks with sentences
    of which links make less than half."""
    names = [{n for e in (leaf.path.elements() if leaf.path else ()) for n in e if n not in ("body", "html")} for leaf in page]
    some = any(x & MAIN for x in names)
    prose = [leaf.linked * 2 < len(leaf.text) and (len(leaf.text) > 60 or leaf.text[-1] in ".!?:") for leaf in page]
    return np.array([not x & REST and (bool(x & MAIN) if some else fit) for x, fit in zip(names, prose)], np.float32)


# Other names for the parts of a page, for versions of training pages.
OTHER = {
    "article": [("article",), ("main",), ("div", "content"), ("div", "post"), ("div", "entry", "content"), ("section", "story"), ("div", "article", "body"), ("div", "main", "content")],
    "nav": [("nav",), ("div", "menu"), ("div", "navbar"), ("header",), ("div", "breadcrumb"), ("ul", "menu")],
    "footer": [("footer",), ("div", "footer"), ("div", "site", "footer")],
    "div": [("div", "ad"), ("aside", "sidebar"), ("div", "banner"), ("div", "cookie", "notice"), ("div", "promo"), ("aside",), ("div", "advert")],
}
EXTRA = [("div", "comments"), ("section", "comments"), ("aside", "sidebar"), ("form",), ("div", "cookie", "notice"), ("div", "newsletter"), ("header",), ("div", "related"), ("div", "share"), ("div", "alert"), ("div", "sidebar", "widget"), ("ul", "social")]


#: Containers of an article whose names tell nothing, and what its paragraphs can stand in. Versions of training pages use these, too, with the labels of the
#: page that they are made from: so lists, tables and plain divs are no sign of a menu, and names aren't the only sign of an article.
PLAIN = [("div",), ("div", "text"), ("section",), ("div", "wrap"), ("div", "row", "col"), ("td",), ("div", "span"), ("div", "page"), ("div", "inner", "block")]
HELD = [[("ul",), ("li",)], [("ul",), ("li",)], [("ol",), ("li",)], [("div",)], [("div",)], [("div",), ("p",)], [("section",), ("p",)], [("blockquote",), ("p",)], [("table",), ("tr",), ("td",)], [("dl",), ("dd",)], [("pre",)], [("figure",), ("figcaption",)], [("h2",)]]


def version(page: list[Leaf], told: np.ndarray, others: list[Leaf], random: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """The page with its parts renamed, runs of the article's blocks in other elements (cut to items where these make a list), and with parts of other pages,
    and lists of links, put in as what doesn't belong to an article. told: the labels, which blocks keep."""
    names = {k: v[random.integers(len(v))] for k, v in OTHER.items()}
    if random.random() < 0.5:
        word = ("div", "".join(chr(97 + int(c)) for c in random.integers(0, 26, 6)))
        names["article"] = [*PLAIN, word, word][random.integers(len(PLAIN) + 2)]
    out: list[Leaf] = []
    y: list[float] = []
    run, held = 0, None
    for leaf, mine in zip(page, told):
        elements = [names[e[0]] if e[0] in names and (e[0] != "div" or len(e) > 1) else e for e in (leaf.path.elements() if leaf.path else ())]
        if mine and not run and random.random() < 0.15:
            run, held = int(random.integers(1, 5)), HELD[random.integers(len(HELD))]
        texts = [leaf.text]
        if mine and run and len(elements) > 1:
            run -= 1
            elements = [*elements[:-1], *held]
            if held[-1][0] in ("li", "dd", "td", "h2", "figcaption"):
                words = leaf.text.split()
                cuts = np.sort(random.integers(1, max(2, len(words)), random.integers(0, 5)))
                texts = [" ".join(w) for w in np.split(np.array(words, object), cuts) if len(w)] or texts
        elif not mine:
            run = 0
        for text in texts:
            out.append(Leaf(text, path_of(elements), leaf.linked))
            y.append(float(mine))
    for _ in range(int(random.integers(0, 4))):
        edges = [0, len(out)] + [i for i in range(1, len(out)) if y[i] != y[i - 1] or not y[i]]
        at = edges[random.integers(len(edges))]
        if random.random() < 0.35:  # a menu in elements without a name
            inner = [[("div",), ("ul",), ("li",)], [("ul",), ("li",)], [("div",)], [("div",), ("p",)]][random.integers(4)]
            words = [w for i in random.integers(0, len(others), 3) for w in others[i].text.split()[:3]][: random.integers(2, 9)]
            put = [Leaf(w, path_of([("html",), ("body",), *inner]), len(w)) for w in words]
        else:
            kind = EXTRA[random.integers(len(EXTRA))]
            inner = [[("p",)], [("div",), ("p",)], [("ul",), ("li",)], []][random.integers(4)]
            put = [Leaf(x.text, path_of([("html",), ("body",), kind, *inner]), 0) for x in (others[i] for i in random.integers(0, len(others), random.integers(1, 4)))]
        out[at:at] = put
        y[at:at] = [0.0] * len(put)
    return out, np.array(y, np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one for each direction, and a logistic output. Arrays are time, pages, values."""

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["w" + d] = random.normal(0, 0.1, (INPUTS + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["out"], self.p["bias"] = random.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def _lstm(self, x, mask, d, keep=True):
        steps, n = mask.shape
        w, h, c, kept = self.p["w" + d], np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), []
        given = x @ w[:INPUTS] + self.p["c" + d]
        outs = np.zeros((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            z = given[t] + h @ w[INPUTS:]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            fresh = f * c + i * g
            tc = np.tanh(fresh)
            m = mask[t][:, None]
            if keep:
                kept.append((h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, fresh, c)
            outs[t] = h
        return outs, kept

    def _back(self, x, kept, d, grad):
        w = self.p["w" + d]
        dw, db = np.zeros_like(w), np.zeros(4 * HIDDEN)
        dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t in range(len(kept) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = kept[t]
            dh = dh + grad[t]
            mine = dh * m
            dcell = dc * m + mine * o * (1 - tc**2)
            dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), mine * tc * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
            dw[:INPUTS] += x[t].T @ dz
            dw[INPUTS:] += h.T @ dz
            db += dz.sum(axis=0)
            dh, dc = dz @ w[INPUTS:].T + dh * ~m, dcell * f + dc * ~m
        return dw, db

    def states(self, x, mask, keep=True):
        forward, kf = self._lstm(x, mask, "f", keep)
        backward, kb = self._lstm(x[::-1], mask[::-1], "b", keep)
        return np.concatenate([forward, backward[::-1]], axis=2), kf, kb

    def probabilities(self, x, mask):
        both, _, _ = self.states(x, mask, keep=False)
        return _sigmoid(both @ self.p["out"] + self.p["bias"])

    def gradients(self, x, mask, y):
        both, kf, kb = self.states(x, mask)
        miss = (_sigmoid(both @ self.p["out"] + self.p["bias"]) - y) * mask / mask.sum()
        grad = miss[:, :, None] * self.p["out"]
        out = {"out": np.einsum("tn,tnh->h", miss, both), "bias": np.array([miss.sum()])}
        out["wf"], out["cf"] = self._back(x, kf, "f", grad[:, :, :HIDDEN])
        out["wb"], out["cb"] = self._back(x[::-1], kb, "b", grad[::-1, :, HIDDEN:])
        return out


def packed(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((max(map(len, pages)), len(pages), INPUTS), np.float32), np.zeros((max(map(len, pages)), len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def grouped(lengths: list[int], most: int) -> list[list[int]]:
    """Numbers of pages, those of like length together: at most `most`, and at most SIDE blocks or one longer page."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * lengths[i] <= SIDE:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def train(pages: list[str], seed: int = 3) -> Labeller:
    """A labeller fitted on the pages, whole, and their versions; hints() gives the labels. Pages of more than DEEP nested elements don't train. No
    pages: an untrained one."""
    random, model = np.random.default_rng(seed), Labeller(seed)
    parsed = [x for x in (leaves(p) for p in pages) if x and all(y.path is None or y.path.depth <= DEEP for y in x)]
    others = [x for p in parsed for x in p]
    told = []
    for p in parsed:
        labels = hints(p)
        for v in range(VERSIONS):
            mine, y = (p, labels) if v == 0 else version(p, labels, others, random)
            told.append((features(mine), y))
    m, v, step = {k: np.zeros_like(a) for k, a in model.p.items()}, {k: np.zeros_like(a) for k, a in model.p.items()}, 0
    for _ in range(EPOCHS):
        order = random.permutation(len(told)).tolist()  # pages of like length in another order each time
        batches = grouped([len(told[i][0]) for i in order], BATCH)
        for k in random.permutation(len(batches)):
            some = [told[order[i]] for i in batches[k]]
            x, mask = packed([a for a, _ in some])
            y = np.zeros(mask.shape)
            for k, (_, b) in enumerate(some):
                y[: len(b), k] = b
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.p[k] -= (0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Labeller, pages: list[np.ndarray]) -> list[np.ndarray]:
    """Which blocks of each page belong to the main text. Every page is read whole, from both ends."""
    out = [np.zeros(len(p), bool) for p in pages]
    for some in grouped([len(p) for p in pages], 256):
        x, mask = packed([pages[k] for k in some])
        if len(x):
            p = model.probabilities(x, mask)
            for j, k in enumerate(some):
                out[k][:] = p[: len(out[k]), j] >= 0.5
    return out


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [leaves(h or "") for h in part.column("html").to_pylist()]
                kept = label(model.value, [features(p) for p in pages])
                texts = ["\n".join(x.text for x, k in zip(p, keep) if k) for p, keep in zip(pages, kept)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
            give_back()

    return run


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars; one row per row of pages.

    text: the blocks that the labeller keeps, in page order, one line each; empty if there is none. The labeller is trained on
    PAGES pages at most, of under 1 MB of html, chosen by a hash of their html (a bounded sample of pages, with labels from the names of elements,
    classes and ids); every page is then read whole, however long, and every block is classified from its tag path, its words and all blocks around
    it. Null html is empty; null ids and urls stay; repeated rows repeat their result; columns other than the three that are named are left out,
    whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    body = pages[html]
    sample = [r[0] for r in by_hash(pages.where(body.isNotNull() & (F.length(body) < 1 << 20)).select(body.alias("page")), "page", PAGES).collect()]
    model = spark.sparkContext.broadcast(train(sample))
    return pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("html")).mapInArrow(_extract(model), "page_id long, url string, text string, n_chars long")
