"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the runs of text between block-level tags, each with
the path of open elements above it. Paths are linked from element to element with running
sums of their vectors, so deep nesting costs no more than the tags there are. A block is read as two vectors, the mean of
trained vectors of its hashed path parts (tags, classes, ids and their words) and the mean
of those of its hashed words, and a few numbers (lengths, share of links, signs,
capitals). A bidirectional LSTM in numpy runs over the blocks of the page, so that the
label of each block, main text or not, depends on the whole page. ``train_blocks``
makes the weights from generated pages.

Defined results: a null or empty page, and one without main text, gives an empty
text; broken markup is read as far as it goes, with unclosed elements closed by what
closes their parents; a slash at the end of a tag closes it only inside svg and math;
references are decoded in each run of text between two tags; blocks of any length and number are read whole; repeated
rows and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import io
import re
import zlib
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm._scratch import ship
from loomgraph.llm._worker import lean

PATH_BUCKETS, WORD_BUCKETS, WIDTH = 2048, 4096, 16
NUMBERS = 7
HIDDEN = 16

#: Elements inside a line of text; all other elements end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp".split())
#: Content that is never text.
DROPPED = frozenset("script style".split())
#: An opening tag closes an open element of these kinds, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table select tbody thead tfoot".split())
#: Elements that can stand inside a paragraph; any other opening tag of a block ends it.
_IN_PARAGRAPH = INLINE | frozenset("button label input select option textarea script style noscript iframe object svg".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-zA-Z]+")


#: Elements in which a slash closes a tag.
FOREIGN = ("svg", "math")


class Element:
    """An open element: its tag with names, and the element above it. ``sum`` holds the vectors of all parts from the root."""

    __slots__ = ("above", "count", "name", "sum")

    def __init__(self, name: str, above: Element | None):
        self.name, self.above, self.sum, self.count = name, above, None, 0


class Block:
    __slots__ = ("links", "node", "text")

    def __init__(self, node: Element | None, text: str, links: int):
        self.node, self.text, self.links = node, text, links

    @property
    def path(self) -> tuple[str, ...]:
        """Names of all elements above the text, the outermost first."""
        out, node = [], self.node
        while node is not None:
            out.append(node.name)
            node = node.above
        return tuple(reversed(out))


class _Open:
    """The stack of open elements, with the places of each tag on it."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, name: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.nodes.append(Element(name, self.top()))
        self.tags.append(tag)

    def top(self) -> Element | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, *tags: str) -> int:
        """Place of the innermost element of these tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def block(self) -> int:
        """Place of the innermost element that isn't inline."""
        return self.blocks[-1] if self.blocks else -1


def _names(tag: str, attributes: str) -> str:
    """A tag with its classes, ids and role, as ``tag.class#id``."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        mark = {"class": ".", "id": "#"}.get(m[1].lower(), "@")
        found += [mark + v for v in html.unescape(m[2] or m[3] or m[4] or "").lower().split()]
    return tag + "".join(found)


def parse(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with white space inside turned into one space."""
    blocks: list[Block] = []
    stack = _Open()
    parts: list[str] = []
    link_chars, node, begun = 0, None, False
    page = page or ""
    lowered = None
    at = 0

    def flush() -> None:
        nonlocal link_chars, node, begun
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            blocks.append(Block(node, text, link_chars))
        parts.clear()
        link_chars, node, begun = 0, None, False

    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            text = m[0]
            if text[0] == "<" and len(text) > 1:
                continue
            if not begun and not text.isspace():
                node, begun = stack.top(), True
            parts.append(html.unescape(text))
            if stack.places.get("a"):
                link_chars += len(text)
            continue
        tag = tag.lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
            continue
        if closing:
            k = stack.last(tag)
            if k >= 0 and (tag not in INLINE or k > stack.block()):
                stack.cut(k)
            continue
        if tag not in _IN_PARAGRAPH and (k := stack.block()) >= 0 and stack.tags[k] == "p":
            stack.cut(k)
        if tag in CLOSES and (k := stack.last(*CLOSES[tag])) > stack.last(*STOPS):
            stack.cut(k)
        if tag in RAW:
            if lowered is None:
                lowered = page.lower()
                if len(lowered) != n:  # a few letters change length; ASCII is all that tags need
                    lowered = page.translate({c: c + 32 for c in range(65, 91)})
            end = lowered.find("</" + tag, at)
            content = page[at : end if end >= 0 else n]
            at = n if end < 0 else page.find(">", end) + 1 or n
            if tag not in DROPPED and content.strip():
                node = Element(_names(tag, attributes), stack.top())
                parts.append(html.unescape(content))
                flush()
            continue
        if tag not in VOID and not (attributes.endswith("/") and (tag in FOREIGN or stack.last(*FOREIGN) >= 0)):
            stack.push(tag, _names(tag, attributes))
    flush()
    return blocks


def _bucket(x: str, size: int) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % size


def _element_words(name: str) -> list[str]:
    return sorted({name.split(".")[0].split("#")[0].split("@")[0], name, *_PART.findall(name)})


def path_buckets(path: tuple[str, ...]) -> list[int]:
    """Buckets of all parts of a path; the two elements next to the text count apart too."""
    out = []
    for depth, element in enumerate(reversed(path)):
        words = _element_words(element)
        out += [_bucket(w, PATH_BUCKETS) for w in words]
        if depth < 2:
            out += [_bucket(f"{depth}:{w}", PATH_BUCKETS) for w in words]
    return out or [_bucket("", PATH_BUCKETS)]


def word_buckets(text: str) -> list[int]:
    return [_bucket(w, WORD_BUCKETS) for w in text.lower().split()]


def numbers(block: Block, place: float) -> list[float]:
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    signs = text.count(".") + text.count(",")
    capitals = sum(1 for c in text if c.isupper()) if size < 2000 else len(re.findall("[A-Z]", text))
    return [np.log1p(words) / 4, np.log1p(size) / 6, min(1.0, block.links / size), min(1.0, signs / words), capitals / size, place, 1.0 if text[-1] in ".!?" else 0.0]


class Labeller:
    """The network: weights by name, vectors of blocks, and chances of being main text."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        #: Of an element's name: number of its words, sum of their vectors, and these as the first and the second element next to a text.
        self.names: dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def load(cls) -> Labeller:
        data = files("loomgraph.llm").joinpath("blocks.npz").read_bytes()
        with np.load(io.BytesIO(data)) as found:
            return cls(dict(found))

    def _named(self, name: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        known = self.names.get(name)
        if known is None:
            words, table = _element_words(name), self.w["path"]
            sums = [table[[_bucket(mark + w, PATH_BUCKETS) for w in words]].sum(axis=0, dtype=np.float64) for mark in ("", "0:", "1:")]
            if len(self.names) > 20_000:
                self.names.clear()
            self.names[name] = known = (len(words), *sums)
        return known

    def path_vector(self, node: Element | None) -> np.ndarray:
        """Mean of the vectors of :func:`path_buckets`, from running sums."""
        if node is None:
            return self.w["path"][path_buckets(())].mean(axis=0)
        new, at = [], node
        while at is not None and at.sum is None:
            new.append(at)
            at = at.above
        for e in reversed(new):
            size, own, *_ = self._named(e.name)
            e.sum, e.count = (own, size) if e.above is None else (e.above.sum + own, e.above.count + size)
        size, _, first, _ = self._named(node.name)
        total, count = node.sum + first, node.count + size
        if node.above is not None:
            size, _, _, second = self._named(node.above.name)
            total, count = total + second, count + size
        return total / count

    def vectors(self, blocks: list[Block]) -> np.ndarray:
        """One row for each block: path vector, word vector, numbers."""
        out = np.empty((len(blocks), 2 * WIDTH + NUMBERS), np.float32)
        words = [word_buckets(b.text) for b in blocks]
        last, known = None, None
        for i, b in enumerate(blocks):
            if known is None or b.node is not last:
                last, known = b.node, self.path_vector(b.node)
            out[i, :WIDTH] = known
            out[i, 2 * WIDTH :] = numbers(b, i / len(blocks))
        many = np.array([len(x) for x in words])
        at, table = 0, self.w["word"]
        while at < len(blocks):  # pieces of bounded size; a longer block stands alone
            to = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), 1 << 16)))
            flat = table[np.array([w for x in words[at:to] for w in x], np.int64)]
            starts = np.cumsum(many[at:to]) - many[at:to]
            out[at:to, WIDTH : 2 * WIDTH] = np.add.reduceat(flat, starts, axis=0) / many[at:to, None]
            at = to
        return out

    def chances(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page (rows of vectors) the chance of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 64 and len(pages[order[to]]) * (to - at + 1) <= 20_000:
                to += 1
            group = order[at:to]
            sizes = np.array([len(pages[i]) for i in group])
            x = np.zeros((sizes.max(), len(group), 2 * WIDTH + NUMBERS), np.float32)
            for k, i in enumerate(group):
                x[: sizes[k], k] = pages[i]
            mask = np.arange(len(x))[:, None] < sizes
            p = forward(self.w, x, mask)
            for k, i in enumerate(group):
                out[i] = p[: sizes[k], k]
            at = to
        return out

    def texts(self, pages: list[str | None]) -> list[str]:
        """The main text of each page: blocks joined by one space."""
        blocks = [parse(p) for p in pages]
        vectors = [self.vectors(own) if own else np.zeros((0, 2 * WIDTH + NUMBERS), np.float32) for own in blocks]
        return [" ".join(b.text for b, p in zip(own, chance) if p >= 0.5) for own, chance in zip(blocks, self.chances(vectors))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states over time (first axis); where ``mask`` is off the state stays as it is."""
    steps, batch, _ = x.shape
    h, c = np.zeros((batch, HIDDEN), x.dtype), np.zeros((batch, HIDDEN), x.dtype)
    out = np.empty((steps, batch, HIDDEN), x.dtype)
    fed = x @ w + b
    for t in range(steps):
        z = fed[t] + h @ u
        gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[t][:, None]
        c2 = f * c + i * new
        h2 = o * np.tanh(c2)
        if keep is not None:
            keep.append((h, c, c2, i, f, o, new))
        h, c = np.where(m, h2, h), np.where(m, c2, c)
        out[t] = h
    return out


def forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Chances (time, page) from vectors (time, page, size)."""
    ahead = run_lstm(x, mask, w["wf"], w["uf"], w["bf"])
    back = run_lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"])[::-1]
    return sigmoid(np.concatenate([ahead, back, x], axis=2) @ w["v"] + w["c"])[:, :, 0]


_LABELLERS: list[Labeller] = []


def labeller() -> Labeller:
    """One network for each worker process."""
    if not _LABELLERS:
        _LABELLERS.append(Labeller.load())
    return _LABELLERS[0]


def main_text(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """Columns ``keep`` of ``pages``, text (main text) and n_chars (its code points)."""
    ship(pages.sparkSession)
    schema = T.StructType([*(pages.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        net = labeller()
        for b in batches:
            texts, run_of, size = [], [], 0
            for p in b.column(len(keep)):
                run_of.append(p.as_py())
                size += len(run_of[-1] or "")
                if size > 1 << 20:
                    texts += net.texts(run_of)
                    run_of, size = [], 0
            texts += net.texts(run_of)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, page).mapInArrow(lean(run), schema)
