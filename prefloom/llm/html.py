"""Main text of HTML pages: a bidirectional LSTM labels the leaf blocks of each page.

A page is read tag by tag into leaf blocks: stretches of text between block-level tags, each with the path of open tags above
it. A block's vector holds its path (tags, words of class, id and role) and its words, both hashed, and a few measures (length,
share of linked text, place in the page). The recurrent labeller reads the blocks of the whole page in both directions and
gives each the probability of being main text, so a block is judged by its neighbours as well as by itself.

The labeller is trained on pages of the corpus that say themselves where their article is (article or main element):
a bounded sample of ``Setup.sample`` pages by a hash of their key. Each is shown as it is and re-dressed: the same paragraphs in other
wrappers, among menus, notices, adverts, forms, sidebars, footers and reader comments, whose texts come from other pages, so
that neither one name nor one order decides. Without such pages the templates alone are learned.

Text: character references are decoded, white space within a block becomes one space, blocks in page order are joined by an empty line. Scripts,
styles, templates, form controls, comments and the head are no text. Cases: a null page is empty; a page without blocks has the empty
text; unclosed and stray tags are tolerated; pages of any length are read whole; null keys and repeated rows are read like others;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import map_batches

# What the elements of HTML are
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript textarea title select svg iframe object canvas math audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: an opening tag ends these open ones (up to the nearest of the second set)
ENDS = {
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset({"dl"})),
    "dd": (frozenset("dt dd".split()), frozenset({"dl"})),
    "tr": (frozenset("tr td th".split()), frozenset({"table"})),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
}
_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""",
    re.DOTALL,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z]+")

PATH_SIZE, WORD_SIZE, MEASURES = 128, 64, 8
INPUT = PATH_SIZE + WORD_SIZE + MEASURES


@dataclass(frozen=True)
class Setup:
    """Pages learned from, dressings of each, hidden units per direction, passes, learning rate, seed and the probability from which
    a block is main text. What one page may give to the learning is bounded as well: blocks of its article that are dressed anew, characters of a text used as
    a stray one, blocks of the page as it is and as it is dressed. Pages that are labelled are read whole, ``chunk`` blocks of a long one at a time."""

    sample: int = 240
    dressings: int = 6
    hidden: int = 24
    passes: int = 4
    rate: float = 0.01
    seed: int = 11
    threshold: float = 0.5
    article_blocks: int = 40
    stray_chars: int = 600
    page_blocks: int = 80
    dressed_blocks: int = 120
    chunk: int = 8_192


class Path:
    """Open tags above a block as a node of a tree of paths: what a tag adds is kept with it, so pages that share paths share nodes, and
    a path costs the same however deep it is."""

    __slots__ = ("parent", "names", "depth", "marks", "ends", "children", "counts", "made")

    def __init__(self, parent: Path | None, names: tuple[str, ...]) -> None:
        self.parent, self.names = parent, names
        self.depth = len(names) + (parent.depth if parent else 0)
        own, above = WATCHED.intersection(names), parent.marks if parent else frozenset()
        self.marks = above | own if own - above else above
        self.ends = ((parent.ends if parent else ()) + names[-2:])[-2:]
        self.children: dict[tuple[str, ...], Path] = {}
        self.counts: np.ndarray | None = None
        self.made: np.ndarray | None = None

    def below(self, names: tuple[str, ...]) -> Path:
        child = self.children.get(names)
        if child is None:
            child = self.children[names] = Path(self, names)
            _Tree.nodes += 1
        return child

    def __len__(self) -> int:
        return self.depth

    def __contains__(self, name: str) -> bool:
        return name in self.marks

    def vector(self) -> np.ndarray:
        """Counts by bucket, up to two; the last two names are counted once more under names of their own."""
        chain, node = [], self
        while node is not None and node.counts is None:
            chain.append(node)
            node = node.parent
        before = np.zeros(PATH_SIZE, np.uint8) if node is None else node.counts
        for node in reversed(chain):
            own = np.bincount([_hash(p) % PATH_SIZE for p in node.names], minlength=PATH_SIZE)
            node.counts = before = np.minimum(before + own, 2).astype(np.uint8)
        if self.made is None:
            last = np.bincount([_hash(f"^{p}") % PATH_SIZE for p in self.ends], minlength=PATH_SIZE)
            self.made = np.minimum(self.counts + last, 2).astype(np.uint8)
        return self.made


class _Tree:
    """The tree of paths of this process; a page that finds it large begins a new one."""

    nodes = 0
    root: Path | None = None

    @classmethod
    def start(cls) -> Path:
        if cls.root is None or cls.nodes >= 20_000:
            cls.root, cls.nodes = Path(None, ()), 0
        return cls.root


@dataclass
class Block:
    text: str
    path: Path
    linked: int = 0


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an open tag adds to the path: its name and the words of its class, id and role."""
    out = [tag]
    if attributes:
        for m in _NAMED.finditer(attributes):
            value = m.group(1) or m.group(2) or m.group(3) or ""
            for w in _PARTS.findall(value):
                out += [f".{w.lower()}", f".{w[:5].lower()}*"]  # the beginning stands for the other forms of a word
    return tuple(out)


class _Stack:
    """Open tags, with the places of each tag, so that no search passes over the tags above it."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = [_Tree.start()]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def open(self, tag: str, names: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(self.paths[-1].below(names))

    def top(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def top_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def cut(self, k: int) -> None:
        """Close everything from place ``k`` on."""
        while len(self.tags) > k:
            self.at[self.tags.pop()].pop()
            self.paths.pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = _Stack()
    parts: list[str] = []
    linked = 0
    low: str | None = None
    unclosed: set[str] = set()  # elements without an end tag in the rest of the page

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.paths[-1], min(linked, len(text))))
            parts, linked = [], 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            raw = page[at:stop]
            parts.append(references.unescape(raw) if "&" in raw else raw)
            if stack.at.get("a"):
                linked += len(raw.strip())
        if m is None:
            break
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag == "br":
                parts.append(" ")
                continue
            k = stack.top((tag,))
            if tag in BLOCKS:
                close()
                if k >= 0:
                    stack.cut(k)
            elif k > stack.top_block():
                stack.cut(k)
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in UNSEEN:
            if attributes.endswith("/") and tag not in ("script", "style", "title", "textarea"):
                continue
            if low is None:
                low = page.lower() if len(page.lower()) == size else page
            if tag == "head":
                continue
            end = -1 if tag in unclosed else low.find(f"</{tag}", at)
            # an element without its end tag hides the rest of the page only if browsers read it as raw text
            if end >= 0:
                gt = page.find(">", end)
                at = size if gt < 0 else gt + 1
            elif tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
                at = size
            else:
                unclosed.add(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
            if tag in ENDS:
                k = stack.top(ENDS[tag][0])
                if k > stack.top(ENDS[tag][1]):
                    stack.cut(k)
            elif tag not in ("body", "html"):
                k = stack.top(("p",))
                if k >= 0 and k == stack.top_block():
                    stack.cut(k)
        stack.open(tag, _names(tag, attributes))
    close()
    return out


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """Bucket of each word; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = bucket = _hash(word) % WORD_SIZE
        return bucket


_words = _Words()


def vectors(pages: Sequence[list[Block]], first: int = 0, of: int | None = None) -> np.ndarray:
    """One row per block of all pages. One page may be given in part: its blocks from ``first`` on, of ``of`` in all."""
    n = sum(map(len, pages))
    x = np.zeros((n, INPUT), np.float32)
    if not n:
        return x
    words_at: list[int] = []
    counts, measures, paths = [], [], []
    for blocks in pages:
        total = of or len(blocks)
        for k, b in enumerate(blocks, first):
            text = b.text
            paths.append(b.path.vector())
            words = text.lower().split()
            counts.append(len(words))
            words_at.extend(map(_words.__getitem__, words))
            size, stops = len(text), text.count(".") + text.count(",")
            measures.append((size, b.linked / size, len(words), stops / (len(words) + 1), k / total, total, text[-1] in ".!?…", len(b.path) / 20))
    m = np.array(measures, np.float32)
    m[:, 0] = np.log1p(m[:, 0]) / 5
    m[:, 2] = np.log1p(m[:, 2]) / 4
    m[:, 3] = np.minimum(1, 5 * m[:, 3])
    m[:, 5] = np.log1p(m[:, 5]) / 5
    x[:, PATH_SIZE + WORD_SIZE :] = m
    x[:, :PATH_SIZE] = paths
    at = np.repeat(np.arange(n), counts) * WORD_SIZE + np.array(words_at, np.int64)
    w = np.bincount(at, minlength=n * WORD_SIZE).reshape(n, WORD_SIZE).astype(np.float32)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = w / np.sqrt(np.maximum((w**2).sum(1, keepdims=True), 1))
    return x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output, in NumPy. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"wx{side}"] = (rng.normal(size=(INPUT, 4 * hidden)) / np.sqrt(INPUT)).astype(np.float32)
            self.p[f"wh{side}"] = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            self.p[f"b{side}"] = bias
        self.p["wo"] = (rng.normal(size=(2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, side: str, trace: bool, start: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """Hidden states of sequences laid out as time x page x input, and the state and cell behind them, from which a sequence goes on."""
        t, n, _ = x.shape
        h = self.hidden
        gates = (x.reshape(t * n, -1) @ self.p[f"wx{side}"] + self.p[f"b{side}"]).reshape(t, n, 4 * h)
        out = np.zeros((t, n, h), np.float32)
        state, cell = start or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        kept = []
        wh = self.p[f"wh{side}"]
        for k in range(t):
            g = gates[k] + state @ wh
            s = _sigmoid(g[:, : 3 * h])
            c = np.tanh(g[:, 3 * h :])
            before = cell
            cell = s[:, h : 2 * h] * cell + s[:, :h] * c
            squashed = np.tanh(cell)
            if trace:
                kept.append((s, c, before, squashed, state))
            state = s[:, 2 * h :] * squashed
            out[k] = state
        return out, kept, (state, cell)

    @staticmethod
    def _turn(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each sequence backwards, padding left behind."""
        t = np.arange(x.shape[0])[:, None]
        at = np.where(t < sizes[None, :], sizes[None, :] - 1 - t, t)
        return np.take_along_axis(x, at[:, :, None], axis=0)

    def forward(self, x: np.ndarray, sizes: np.ndarray, trace: bool = False) -> tuple[np.ndarray, tuple]:
        f, kept_f, _ = self._pass(x, "f", trace)
        back = self._turn(x, sizes)
        b, kept_b, _ = self._pass(back, "b", trace)
        h = np.concatenate([f, self._turn(b, sizes)], axis=2)
        return _sigmoid((h @ self.p["wo"])[:, :, 0] + self.p["bo"]), (h, kept_f, kept_b, back)

    def gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over the blocks."""
        p, (h, kept_f, kept_b, back) = self.forward(x, sizes, True)
        mask = np.arange(x.shape[0])[:, None] < sizes[None, :]
        d = ((p - y) * mask / mask.sum()).astype(np.float32)
        grads = {"wo": (h * d[:, :, None]).sum((0, 1))[:, None], "bo": d.sum(keepdims=True)[0]}
        dh = d[:, :, None] * self.p["wo"][:, 0]
        n = self.hidden
        for side, seq, kept, out in (("f", x, kept_f, dh[:, :, :n]), ("b", back, kept_b, self._turn(dh[:, :, n:], sizes))):
            steps = np.zeros((*x.shape[:2], 4 * n), np.float32)
            ds, dc = np.zeros((x.shape[1], n), np.float32), np.zeros((x.shape[1], n), np.float32)
            wh = self.p[f"wh{side}"]
            gwh = np.zeros_like(wh)
            for k in range(x.shape[0] - 1, -1, -1):
                s, c, before, squashed, state = kept[k]
                ds = ds + out[k]
                i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
                dc = dc + ds * o * (1 - squashed**2)
                g = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - c**2)], axis=1)
                steps[k] = g
                gwh += state.T @ g
                ds, dc = g @ wh.T, dc * f
            flat = steps.reshape(-1, 4 * n)
            grads |= {f"wx{side}": seq.reshape(-1, INPUT).T @ flat, f"wh{side}": gwh, f"b{side}": flat.sum(0)}
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int, rate: float, seed: int) -> None:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        batches = [order[k : k + 16] for k in range(0, len(order), 16)]
        step = 0
        for turn in range(passes):
            for b in rng.permutation(len(batches)):
                x, sizes, y = _pad([pages[k][0] for k in batches[b]], [pages[k][1] for k in batches[b]])
                step += 1
                now = rate * (1 - 0.8 * turn / max(passes - 1, 1))
                for k, g in self.gradient(x, sizes, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label_long(self, blocks: list[Block], chunk: int) -> np.ndarray:
        """:meth:`label` for one page, ``chunk`` blocks at a time: each direction goes through the page once and hands its state on."""
        total, h = len(blocks), self.hidden
        logits = np.full(total, self.p["bo"][0], np.float32)
        for side, weights in (("f", self.p["wo"][:h]), ("b", self.p["wo"][h:])):
            turn = 1 if side == "f" else -1
            state = None
            for s in list(range(0, total, chunk))[::turn]:
                x = vectors([blocks[s : s + chunk]], s, total)[::turn, None, :]
                out, _, state = self._pass(x, side, False, state)
                logits[s : s + chunk] += (out[:, 0] @ weights)[::turn, 0]
        return _sigmoid(logits)

    def label(self, pages: list[list[Block]], chunk: int = Setup.chunk) -> list[np.ndarray]:
        """Probability of each block of each page; pages of similar length go together, padding is bounded. A page of more than ``chunk`` blocks goes by itself."""
        if any(len(b) > chunk for b in pages):
            others = iter(self.label([b for b in pages if len(b) <= chunk], chunk))
            return [self.label_long(b, chunk) if len(b) > chunk else next(others) for b in pages]
        x = vectors(pages)
        edge = np.concatenate(([0], np.cumsum([len(b) for b in pages])))
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = 1
            while at + n < len(order) and n < 128 and (n + 1) * len(pages[order[at + n]]) <= 16_384:
                n += 1
            some = order[at : at + n]
            batch, sizes, _ = _pad([x[edge[k] : edge[k + 1]] for k in some], None)
            p, _ = self.forward(batch, sizes)
            for j, k in enumerate(some):
                out[k] = p[: sizes[j], j]
            at += n
        return out


def _pad(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in xs])
    x = np.zeros((sizes.max(), len(xs), INPUT), np.float32)
    y = np.zeros((sizes.max(), len(xs)), np.float32)
    for k, v in enumerate(xs):
        x[: len(v), k] = v
        if ys is not None:
            y[: len(v), k] = ys[k]
    return x, sizes, y


#: path parts that say of themselves that they hold the article, or something else
INSIDE = frozenset({"article", "main"})
OUTSIDE = frozenset("nav aside footer form button dialog .ad .ads .advert .comments .comment .sidebar .menu .cookie .notice".split())
WATCHED = INSIDE | OUTSIDE | {"h1"}


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks of the article, where the page says so by its elements; else null."""
    if not any(INSIDE & b.path.marks for b in blocks):
        return None
    return np.array([bool(INSIDE & b.path.marks) and not OUTSIDE & b.path.marks for b in blocks], np.float32)


_WRAPPERS = (
    "article", "main", "article class=post", "section class=story", "div id=content", "div class=content", "div class=entry-content",
    "div class=post-body", "div class=article-body", "div itemprop=articleBody", "div class=main-text", "div role=main", "td class=content", "div", "section", "div class={word}",
)
_BARS = ("nav", "div class=menu", "div id=navigation", "ul class=nav", "div role=navigation", "div class=navbar", "div class=breadcrumb", "div class=tabs", "header class=site-header", "div")
_NOTES = ("div class=ad", "div class=advert", "div class=banner", "aside class=promo", "div class=sponsored", "div id=ads", "div class=cookie-notice", "div class=notice", "div class=alert", "div class=popup", "div role=alert", "div class=consent", "div class=advertisement", "div class=ad-slot", "section class=newsletter", "ins class=adsbygoogle", "div class=subscribe")
_SIDES = ("aside", "div class=sidebar", "div id=sidebar", "aside class=widget", "div class=related", "section class=recommended", "div class=side", "div class=widget", "div class=trending", "div class=tags")
_FEET = ("footer", "div id=footer", "div class=footer", "div class=copyright", "div class=legal", "footer class=site-footer", "div class=bottom")
_TALK = ("section class=comments", "div id=comments", "div class=comment-list", "ol class=commentlist", "div class=discussion", "section id=reader-comments", "div class=replies", "div class=responses")
_TOPS = ("header", "div id=header", "div class=header", "header class=masthead", "div class=site-title", "div class=topbar", "div role=banner")


def dress(paragraphs: list[tuple[str, str]], stray: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page around the given (tag, text) blocks, with other blocks from ``stray`` texts, and which of its blocks are main text."""
    page: list[str] = []
    truth: list[bool] = []
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    some = lambda: references.escape(stray[rng.integers(len(stray))])
    few = lambda: " ".join(some().split()[: rng.integers(1, 9)]) or "x"

    def wrap(kinds: Sequence[str], inner: str) -> str:
        kind = kinds[rng.integers(len(kinds))].replace("{word}", word())
        tag, _, attribute = kind.partition(" ")
        name, _, value = attribute.partition("=")
        return f"<{tag}{f' {name}="{value}"' if name else ''}>{inner}</{tag}>"

    def add(kinds: Sequence[str], items: list[str]) -> None:
        page.append(wrap(kinds, "".join(items)))
        truth.extend([False] * len(items))

    links = lambda n: [f'<li><a href="/{word()}">{few()}</a></li>' for _ in range(n)]
    plain = lambda n: [f"<p>{some()}</p>" for _ in range(n)]
    if rng.random() < 0.5:
        add(_TOPS, [f"<div>{few()}</div>" for _ in range(rng.integers(1, 4))])
    if rng.random() < 0.8:
        add(_BARS, links(rng.integers(2, 9)))
    if rng.random() < 0.5:
        add(_NOTES, plain(rng.integers(1, 3)))
    if rng.random() < 0.3:
        add(("form class=search", "form", "form id=login"), [f"<label>{few()}</label><p>{some()}</p>"])
        truth.append(False)  # label text and paragraph are two blocks
    if rng.random() < 0.3:
        add(_SIDES, links(rng.integers(2, 6)))
    inner: list[str] = []
    marks: list[bool] = []
    for tag, text in paragraphs:
        inner.append(f"<{tag}>{references.escape(text)}</{tag}>")
        marks.append(True)
        if rng.random() < 0.12:
            inner.append(wrap(_NOTES, f"<p>{some()}</p>"))
            marks.append(False)
        if rng.random() < 0.05:
            k = rng.integers(2, 5)
            inner += [f"<li>{some()}</li>" for _ in range(k)]
            marks += [True] * int(k)
        if rng.random() < 0.05:
            inner.append(wrap(("blockquote", "h2", "h3", "pre", "figcaption"), some()))
            marks.append(True)
    body = wrap(_WRAPPERS, "".join(inner))
    if rng.random() < 0.3:
        body = wrap(("div class=page", "div id=wrapper", "div class=container", "main", "div"), body)
    page.append(body)
    truth += marks
    if rng.random() < 0.3:
        add(("div class=share", "div class=social", "div class=author-box", "div class=pagination"), links(rng.integers(2, 5)))
    if rng.random() < 0.5:
        add(_TALK, [f'<div class="comment"><p>{some()}</p></div>' if rng.random() < 0.7 else f"<li><p>{some()}</p></li>" for _ in range(rng.integers(1, 6))])
    if rng.random() < 0.4:
        add(_SIDES, links(rng.integers(2, 6)) if rng.random() < 0.6 else plain(rng.integers(1, 4)))
    if rng.random() < 0.4:
        add(_NOTES, plain(1))
    if rng.random() < 0.85:
        add(_FEET, [f"<p>&copy; {few()}</p>"] if rng.random() < 0.5 else [f"<div>{some()}</div>" for _ in range(rng.integers(1, 4))])
    return f"<html><body>{''.join(page)}</body></html>", truth


def fit(pages: list[str], setup: Setup = Setup()) -> Labeller:
    """Train on the pages that mark their article themselves, as they are and re-dressed."""
    rng = np.random.default_rng(setup.seed)
    parsed = [b for b in map(blocks_of, pages) if b]
    own = [(b, y) for b in parsed if (y := own_labels(b)) is not None]
    stray = [b.text[: setup.stray_chars] for blocks in parsed for b in blocks] or ["Lorem ipsum dolor sit amet."]
    articles = [[("h1" if "h1" in b.path else "p", b.text) for b, k in zip(blocks, y, strict=True) if k][: setup.article_blocks] for blocks, y in own]
    articles = [a for a in articles if a] or [[("h1", stray[0]), *[("p", s) for s in stray[:6]]]]
    seen: list[tuple[list[Block], np.ndarray]] = [(b[: setup.page_blocks], y[: setup.page_blocks]) for b, y in own]
    for article in articles:
        for _ in range(setup.dressings if len(articles) > 20 else 200 // len(articles)):
            page, truth = dress(article, stray, rng)
            blocks = blocks_of(page)
            if len(blocks) == len(truth):
                seen.append((blocks[: setup.dressed_blocks], np.array(truth[: setup.dressed_blocks], np.float32)))
    model = Labeller(setup.hidden, setup.seed)
    model.train([(vectors([b]), y) for b, y in seen], setup.passes, setup.rate, setup.seed)
    return model


def sample_pages(df: DataFrame, key: str, html: str, size: int) -> list[str]:
    """At most ``size`` pages, chosen by a hash of their key; the filter leaves about that many, so few rows move."""
    n = df.count()
    h = F.pmod(F.xxhash64(key), F.lit(max(n, 1)))
    rows = df.filter((h < 2 * size) & F.col(html).isNotNull()).select(html, h.alias("h"), F.col(key).alias("k"))
    return [r[0] for r in rows.orderBy("h", "k").limit(size).collect()]


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", setup: Setup = Setup()) -> DataFrame:
    """``key, url, text, n_chars, n_blocks, n_kept`` for every page."""
    model = fit(sample_pages(df, key, html, setup.sample), setup)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, every, kept = [], [], []
        pages: list[list[Block]] = []

        def settle() -> None:
            for blocks, p in zip(pages, model.label(pages, setup.chunk), strict=True):
                main = [b.text for b, v in zip(blocks, p, strict=True) if v >= setup.threshold]
                texts.append("\n\n".join(main))
                every.append(len(blocks))
                kept.append(len(main))
            pages.clear()

        held = 0
        for page in batch.column(html):
            pages.append(blocks_of(page.as_py() or ""))
            held += len(pages[-1])
            if held >= 8_192 or len(pages) >= 512:
                settle()
                held = 0
        settle()
        columns = [batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(every, pa.int64()), pa.array(kept, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars", "n_blocks", "n_kept"])

    return map_batches(df.select(key, url, html), work, f"`{key}` {fields[key]}, `{url}` {fields[url]}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")


__all__ = ["Block", "Labeller", "Setup", "blocks_of", "dress", "extract", "fit", "own_labels", "sample_pages", "vectors"]
