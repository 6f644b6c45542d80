"""Main text of web pages by a recurrent labeller of text blocks.

A page is read into leaf blocks: runs of text between the borders of block elements, each with
the tags, classes and ids above it. A block's vector holds its hashed tag path, its hashed words
and a few figures (length, share of link text, place in the page). A bidirectional LSTM in
numpy reads the vectors of a page in order and labels every block with the whole page as its
context. Blocks labelled as main text are joined in page order.

There are no labelled pages, so the model learns from rules: blocks in navigation, notices,
adverts, forms, comments and the like are no main text, blocks in an article are, and where
markup says neither, long blocks with few links are. Each training page is also used in
varied forms: containers renamed to others of their kind, paragraphs repeated inside containers
of other kinds. In a part of the training pages the tag paths are hidden, so that words,
figures and context are learned as well. The model is trained on a bounded sample of pages (``SAMPLE``, the first ``TRAIN_BLOCKS`` blocks of each);
every page is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without text of the page, elements within a block, void elements.
SILENT = frozenset("script style noscript template title head svg math iframe object select textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values for the rules: what is no main text, what is.
OTHER_TAGS = frozenset("nav header footer aside form button menu dialog fieldset".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies footer header "
    "disqus login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related "
    "replies reply share sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MAIN_TAGS = frozenset(["article", "main"])
MAIN_NAMES = frozenset("article articlebody content entry main post story".split())
#: A name that begins or ends so tells a state of the page (has-sidebar, header-fixed).
STATE_FIRST = frozenset("has hide is no not show with without".split())
STATE_LAST = frozenset("active closed collapsed disabled enabled expanded fixed hidden open sticky visible".split())
#: Start tags that end an open paragraph (or item) before them.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table ul".split()
)

#: Open elements that a start tag ends, and those beyond which it ends none.
_LISTS = frozenset("article aside body footer header main menu nav ol section table td th ul".split())
_TABLE = frozenset(["table"])
ENDS = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dd", "dt"]), _LISTS | {"dl"}),
    "dd": (frozenset(["dd", "dt"]), _LISTS | {"dl"}),
    "option": (frozenset(["option"]), _LISTS),
    "td": (frozenset(["td", "th"]), _TABLE),
    "th": (frozenset(["td", "th"]), _TABLE),
    "tr": (frozenset(["td", "th", "tr"]), _TABLE),
    "tbody": (frozenset("tbody td tfoot th thead tr".split()), _TABLE),
    "thead": (frozenset("tbody td tfoot th thead tr".split()), _TABLE),
    "tfoot": (frozenset("tbody td tfoot th thead tr".split()), _TABLE),
}

#: The last two figures of a path say whether it holds containers of either kind.
PATH_SIZE, WORD_SIZE, FIGURES = 26, 12, 6
INPUT, HIDDEN = PATH_SIZE + WORD_SIZE + FIGURES, 16
PATH_BUCKETS, WORD_BUCKETS = 1024, 4096
SAMPLE, TRAIN_BLOCKS, VARIANTS = 1_000, 150, 4
STEPS, BATCH, HIDE = 500, 48, 0.15
SEED = 7
#: Pages are labelled together up to so many (padded) blocks; longer ones alone, so many at a time.
CELLS = 4096

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


@lru_cache(maxsize=65_536)
def names_of(value: str) -> tuple[str, ...]:
    """Names in a class or id, each as its words joined by hyphens: ``commentThread`` is ``comment-thread``."""
    names = ("-".join(_WORD.findall(name)).lower() for name in value.split())
    return tuple(dict.fromkeys(n for n in names if n))


@lru_cache(maxsize=65_536)
def container_words(part: tuple[str, tuple[str, ...]]) -> frozenset[str]:
    """Words that the names of an element say of what it holds.

    Names of the whole page (on html and body) and names that tell a state say nothing of that.
    """
    tag, names = part
    if tag in ("html", "body"):
        return frozenset()
    split = [n.split("-") for n in names]
    return frozenset(w for words in split if words[0] not in STATE_FIRST and words[-1] not in STATE_LAST for w in words)


@lru_cache(maxsize=65_536)
def evidence(part: tuple[str, tuple[str, ...]]) -> tuple[bool, bool]:
    """Does the element look like a container of other text, of main text? Tags and whole names tell."""
    tag, _ = part
    words = container_words(part)
    other = tag in OTHER_TAGS or (tag != "main" and not OTHER_NAMES.isdisjoint(words))
    return other, tag in MAIN_TAGS or not MAIN_NAMES.isdisjoint(words)


class PageBlocks(HTMLParser):
    """Blocks of one page: (path, text, number of characters in links).

    A path holds the different open elements (tag and names) as they were opened, and last the innermost
    one, so that elements nested to any depth without new names make no longer paths.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, tuple[str, ...]]] = []
        self.different: dict[tuple, int] = {}
        self.open: Counter[str] = Counter()
        self.outer: list[int] = []  # places of the open elements that are not inline
        self.now: tuple | None = None
        self.blocks: list[tuple[tuple, str, int]] = []
        self.parts: list[str] = []
        self.linked = self.silent = 0

    def read(self, html: str) -> list[tuple[tuple, str, int]]:
        self.feed(_CUT_TAG.sub("", html))
        self.close()
        self.flush()
        return self.blocks

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                if self.now is None:
                    self.now = tuple(self.different)
                    if self.path and self.path[-1] != self.now[-1]:
                        self.now += (self.path[-1],)
                self.blocks.append((self.now, text, self.linked))
            self.parts = []
        self.linked = 0

    def _push(self, tag: str, attrs: list) -> None:
        names = [n for key, value in attrs if key in ("class", "id", "role") and value for n in names_of(value)]
        part = (tag, tuple(dict.fromkeys(names)))
        if tag not in INLINE:
            self.outer.append(len(self.path))
        self.path.append(part)
        self.different[part] = self.different.get(part, 0) + 1
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.now = None

    def _pop(self) -> None:
        part = self.path.pop()
        tag = part[0]
        if tag not in INLINE:
            self.outer.pop()
        if self.different[part] == 1:
            del self.different[part]
        else:
            self.different[part] -= 1
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.now = None

    def _cut(self, k: int) -> None:
        """The k-th open element and those in it end."""
        while len(self.path) > k:
            self._pop()

    def _end_before(self, tag: str) -> None:
        """End the elements that a start tag ends without end tags of theirs."""
        if tag in ENDS_PARAGRAPH and self.outer and self.path[self.outer[-1]][0] == "p":
            self._cut(self.outer[-1])
        if tag in ENDS:
            ended, until = ENDS[tag]
            if any(self.open[t] for t in ended):
                cut = None
                for k in reversed(self.outer):
                    name = self.path[k][0]
                    if name in until:
                        break
                    if name in ended:
                        cut = k
                if cut is not None:
                    self._cut(cut)
        elif tag == "body":
            while self.silent:
                self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
            self._end_before(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self._push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.open[tag]:
            return
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][0] == tag:
                self._cut(k)
                return
            if tag in INLINE and self.path[k][0] not in INLINE:
                return  # an inline end tag does not close blocks

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data)


def read_blocks(html: str | None) -> list[tuple[tuple, str, int]]:
    """Blocks of a page; a null or empty page has none."""
    return PageBlocks().read(html) if html else []


def rule(path: tuple, text: str, linked: int) -> float:
    """Training label of a block: 1 main text, 0 other."""
    inside = held = False
    for part in path:
        tag, _ = part
        other, main = evidence(part)
        # a header within an article holds its title
        if other and not (inside and tag == "header" and OTHER_NAMES.isdisjoint(container_words(part))):
            return 0.0
        inside, held = inside or tag in MAIN_TAGS, held or main
    if held:
        return 1.0
    return float(len(text.split()) >= 10 and linked < 0.3 * len(text))


def varied(blocks: list[tuple[tuple, str, int]], r: np.random.Generator) -> list[tuple[tuple, str, int]]:
    """The page with its containers renamed, and some paragraphs put into other containers."""
    main = [(t, ()) for t in sorted(MAIN_TAGS)] + [("div", (n,)) for n in sorted(MAIN_NAMES)]
    other = [(t, ()) for t in sorted(OTHER_TAGS)] + [(t, (n,)) for n in sorted(OTHER_NAMES) for t in ("div", "section")]
    as_main = main[r.integers(len(main))] if r.random() < 0.8 else ("div", ())
    renamed: dict[tuple, tuple] = {}

    def rename(part: tuple) -> tuple:
        is_other, is_main = evidence(part)
        if is_main:
            return as_main
        if is_other:
            return renamed.setdefault(part, other[r.integers(len(other))])
        return part

    out = [(tuple(rename(p) for p in path), text, linked) for path, text, linked in blocks]
    long = [b for b in blocks if len(b[1].split()) > 8]
    for _ in range(int(r.integers(0, 4)) if long else 0):
        inside = other[r.integers(len(other))]
        start = int(r.choice([0, len(out), r.integers(len(out) + 1)]))
        around = out[start - 1][0] if start and r.random() < 0.5 else (("html", ()), ("body", ()))
        for _ in range(int(r.integers(1, 4))):
            _, text, linked = long[r.integers(len(long))]
            words = text.split()
            cut = " ".join(words[: int(r.integers(5, 60))])
            path = (*around, inside, ("p", ())) if r.random() < 0.7 else (*around, inside)
            out.insert(start, (path, cut, min(linked, len(cut))))
    return out


def _table(buckets: int, size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, size))


class Vectors:
    """Vectors of the blocks of a page."""

    REMEMBERED = 200_000

    def __init__(self) -> None:
        self.paths = _table(PATH_BUCKETS, PATH_SIZE - 2, SEED)
        self.words = _table(WORD_BUCKETS, WORD_SIZE, SEED + 1)
        self.path_of: dict[tuple, np.ndarray] = {}
        self.bucket_of: dict[str, int] = {}

    def path(self, path: tuple) -> np.ndarray:
        made = self.path_of.get(path)
        if made is None:
            if len(self.path_of) > self.REMEMBERED // 20:
                self.path_of.clear()
            keys = {f"<{tag}" for tag, _ in path} | {f".{w}" for part in path for w in container_words(part)}
            keys |= {f"last {tag}" for tag, _ in path[-1:]}
            at = [zlib.crc32(k.encode()) % PATH_BUCKETS for k in sorted(keys)]
            hashed = self.paths[at].sum(axis=0) / max(1, len(at)) ** 0.5 / 2
            other, main = (any(e) for e in zip(*map(evidence, path))) if path else (False, False)
            made = self.path_of[path] = np.append(hashed, [3.0 * other, 3.0 * main])
        return made

    def __call__(self, blocks: list[tuple[tuple, str, int]], start: int = 0, end: int | None = None) -> np.ndarray:
        """Of the blocks from ``start`` to ``end`` of the page's."""
        n, end = len(blocks), len(blocks) if end is None else end
        out = np.zeros((end - start, INPUT))
        if len(self.bucket_of) > self.REMEMBERED:
            self.bucket_of.clear()
        known = self.bucket_of
        for k in range(start, end):
            path, text, linked = blocks[k]
            words = text.lower().split()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS
            row = out[k - start]
            row[:PATH_SIZE] = self.path(path)
            row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = self.words[[known[w] for w in words]].sum(axis=0) / len(words) ** 0.5 / 2
            row[-FIGURES:] = (
                np.log1p(len(words)) / 3, min(1.0, linked / len(text)), k / n,
                1 / (k + 1), min(len(path), 20) / 10, text[-1] in ".!?",
            )
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output per block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None) -> None:
        if weights is None:
            r = np.random.default_rng(SEED)
            weights = {}
            for d in "fb":
                weights[f"w{d}"] = r.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) / (INPUT + HIDDEN) ** 0.5
                weights[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
            weights["o"] = r.standard_normal(2 * HIDDEN + 1) / HIDDEN**0.5
        self.w = weights

    def _run(
        self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None, state: list | None = None
    ) -> np.ndarray:
        """States over time; x is (pages, blocks, INPUT). Padding carries the state on.

        ``state`` (h, c), where given, is begun from and set to what it is in the end.
        """
        w, c0 = self.w[f"w{d}"], self.w[f"c{d}"]
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        out = np.zeros((n, steps, HIDDEN))
        fixed = x @ w[:INPUT] + c0
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = fixed[:, t] + h @ w[INPUT:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, th, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], axis=2)
        return _sigmoid(states @ self.w["o"][:-1] + self.w["o"][-1])

    def long_page(self, vectors: Callable[[int, int], np.ndarray], n: int, size: int = CELLS) -> np.ndarray:
        """Probabilities of one page of ``n`` blocks, of which ``vectors(start, end)`` are made ``size`` at a time."""
        behind, out = np.zeros((n, HIDDEN)), np.zeros(n)
        spans = [(k, min(n, k + size)) for k in range(0, n, size)]
        state = [np.zeros((1, HIDDEN)), np.zeros((1, HIDDEN))]
        for start, end in reversed(spans):
            x = vectors(start, end)[None]
            behind[start:end] = self._run(x, np.ones(x.shape[:2], bool), "b", state=state)[0]
        state = [np.zeros((1, HIDDEN)), np.zeros((1, HIDDEN))]
        for start, end in spans:
            x = vectors(start, end)[None]
            ahead = self._run(x, np.ones(x.shape[:2], bool), "f", state=state)[0]
            states = np.concatenate([ahead, behind[start:end]], axis=1)
            out[start:end] = _sigmoid(states @ self.w["o"][:-1] + self.w["o"][-1])
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over blocks, by back-propagation through time."""
        kept = {d: [] for d in "fb"}
        states = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(states @ self.w["o"][:-1] + self.w["o"][-1])
        error = np.where(mask, p - y, 0.0) / max(1, mask.sum())
        grads = {"o": np.append(np.einsum("nt,nth->h", error, states), error.sum())}
        for k, d in enumerate("fb"):
            w = self.w[f"w{d}"]
            gw, gc = np.zeros_like(w), np.zeros(4 * HIDDEN)
            from_out = error[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, g, th, m in reversed(kept[d]):
                dh = dh + from_out[:, t]
                dnew = np.where(m, dc + dh * o * (1 - th**2), 0.0)
                do = np.where(m, dh * th, 0.0) * o * (1 - o)
                dz = np.hstack([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do, dnew * i * (1 - g**2)])
                gw[:INPUT] += x[:, t].T @ dz
                gw[INPUT:] += h.T @ dz
                gc += dz.sum(axis=0)
                dh = np.where(m, 0.0, dh) + dz @ w[INPUT:].T
                dc = np.where(m, dnew * f, dc)
            grads[f"w{d}"], grads[f"c{d}"] = gw, gc
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max((len(p) for p in pages), default=0)
    x, mask = np.zeros((len(pages), steps, INPUT)), np.zeros((len(pages), steps), bool)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Labeller:
    """Adam on batches of pages; some pages have their tag paths hidden."""
    model, r = Labeller(), np.random.default_rng(SEED + 2)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    for step in range(1, steps + 1):
        chosen = [pages[k] for k in r.integers(0, len(pages), min(BATCH, len(pages)))]
        x, mask = padded([p for p, _ in chosen])
        x[r.random(len(x)) < HIDE, :, :PATH_SIZE] = 0.0
        y = np.zeros(mask.shape)
        y[mask] = np.concatenate([labels for _, labels in chosen])
        for k, g in model.gradients(x, mask, y).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.w[k] = model.w[k] - 0.02 * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


_TRAINING = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType())),
     T.StructField("y", T.ArrayType(T.FloatType()))]
)


def learn(pages: DataFrame, limit: int = SAMPLE) -> Labeller | None:
    """The labeller of at most ``limit`` pages (smallest by a fixed hash); None without blocks."""
    ids = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                blocks = read_blocks(html)[:TRAIN_BLOCKS]
                r = np.random.default_rng([SEED, (page_id or 0) & 0x7FFFFFFF])
                for blocks in [blocks, *(varied(blocks, r) for _ in range(VARIANTS))] if blocks else []:
                    x = vectors(blocks).astype(np.float32).ravel()
                    y = np.array([rule(*b) for b in blocks], np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([page_id], pa.int64()), pa.array([x], pa.list_(pa.float32())), pa.array([y], pa.list_(pa.float32()))],
                        _TRAINING.names,
                    )

    rows = sample.mapInArrow(run, _TRAINING).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["page_id"] is None, r["page_id"], r["x"]))
    if not rows:
        return None
    return train([(np.array(r["x"], float).reshape(-1, INPUT), np.array(r["y"], float)) for r in rows])


def main_texts(htmls: list[str | None], model: Labeller, vectors: Vectors) -> list[str]:
    """Main texts of pages; pages of about the same number of blocks are labelled together.

    Pages of more than ``CELLS`` blocks are labelled alone and in parts, so what is held for
    a block of them is its text and one state.
    """
    out = [""] * len(htmls)

    def settle(k: int, blocks: list, p: np.ndarray) -> None:
        out[k] = "\n".join(b[1] for b, main in zip(blocks, p >= 0.5) if main)

    read: dict[int, list] = {}
    for k, html in enumerate(htmls):
        blocks = read_blocks(html)
        if len(blocks) > CELLS:
            settle(k, blocks, model.long_page(lambda start, end: vectors(blocks, start, end), len(blocks)))
        elif blocks:
            read[k] = blocks
    group: list[int] = []
    for k in [*sorted(read, key=lambda k: len(read[k])), None]:
        if group and (k is None or len(group) == 32 or (len(group) + 1) * len(read[k]) > CELLS):
            x, mask = padded([vectors(read[g]) for g in group])
            for g, p in zip(group, model.probabilities(x, mask)):
                settle(g, read.pop(g), p)
            group = []
        group.append(k)
    return out


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null, empty or textless page has the empty text. Rows repeat as they do in ``pages``.
    """
    model = model or learn(pages) or Labeller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(part.column("html").to_pylist(), model, vectors)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
