"""HTML main-text extraction: a bidirectional LSTM labels the leaf blocks of a page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.common import binaries, hash_sample

#: Rows whose blocks the labeller is trained on, at most, and the composed pages added per row.
SAMPLE, COMPOSED = 300, 3
#: Longer pages are not drawn for the sample.
LONGEST_SAMPLED = 40_000
#: Blocks of one page that training reads at once; longer pages are read in pieces, in training only.
TRAINING_LENGTH = 48
PATH, LAST, WORDS, DENSE = 96, 32, 48, 6
WIDTH = PATH + LAST + WORDS + DENSE
HIDDEN = 20
EPOCHS, RATE, BATCH = 8, 0.01, 48
#: Cells (pages times blocks) of one padded batch.
CELLS = 16_384

# HTML element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul button label".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea template iframe svg".split())
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPES = frozenset("ul ol dl table select menu".split())

#: Quotes enclose an attribute's value only right after an equals sign; elsewhere they are characters like any other.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)""", re.S
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TARGET = re.compile(r"data-target=(\d)")
PART = re.compile(r"[a-zA-Z]+")


@dataclass
class Page:
    """Leaf blocks in page order: texts, features and, in training, targets."""

    texts: list[str] = field(default_factory=list)
    paths: list[np.ndarray] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    linked: list[float] = field(default_factory=list)
    targets: list[int] = field(default_factory=list)

    def features(self) -> np.ndarray:
        n = len(self.texts)
        x = np.zeros((n, WIDTH), np.float32)
        if not n:
            return x
        x[:, :PATH] = np.minimum(np.array(self.paths), 2)
        x[np.arange(n), PATH + np.array(self.last)] = 1
        words = [t.lower().encode().split() for t in self.texts]
        counts = np.array([len(w) for w in words])
        hashes = np.fromiter((crc32(w) for ws in words for w in ws), np.int64, int(counts.sum()))
        cells = np.repeat(np.arange(n), counts) * WORDS + hashes % WORDS
        signs = np.where(hashes >> 16 & 1, 1.0, -1.0)
        bag = np.bincount(cells, signs, n * WORDS).reshape(n, WORDS)
        x[:, PATH + LAST : PATH + LAST + WORDS] = bag / np.maximum(np.sqrt((bag * bag).sum(axis=1)), 1)[:, None]
        size = np.array([len(t) for t in self.texts])
        ends = np.array([t[-1] in ".!?:;…\"'" for t in self.texts])
        dense = (np.log1p(size) / 6, np.log1p(counts) / 5, np.array(self.linked), ends, np.arange(n) / n, np.full(n, min(n, 100) / 100))
        x[:, PATH + LAST + WORDS :] = np.stack(dense, axis=1)
        return x


def parse(source: str) -> Page:
    """Leaf blocks of a page: runs of text between block-level tags, with character references decoded.

    Scripts, styles and other raw elements are skipped to their end tag, comments to theirs. Inline tags do not
    end a block; a line break is white space. Missing and stray end tags are repaired as browsers do for paragraphs, list
    items and table cells. A tag, comment or reference that the end of the page cuts off is tolerated.
    """
    page = Page()
    stack: list[tuple[str, np.ndarray, int]] = [("", np.zeros(PATH, np.float32), 0)]
    pieces: list[str] = []
    links, in_link, in_title = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not in_title:
                page.texts.append(text)
                page.paths.append(stack[-1][1])
                page.last.append(crc32(stack[-1][0].encode()) % LAST)
                page.linked.append(min(1.0, links / len(text)))
                page.targets.append(stack[-1][2])
            pieces.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if in_link:
                links += len(text)

    at, end = 0, len(source)
    while at < end:
        found = TAG.search(source, at)
        if not found:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in RAW_TAGS:
            if not found[1] and not found[3].endswith("/"):
                close = re.compile(rf"</{name}\s*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
            pieces.append(" ")
        elif found[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in BLOCK_TAGS:
                flush()
                in_title = 0 if name == "title" else in_title
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        in_link = 0
                        break
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK_TAGS:
            flush()
            if name not in VOID_TAGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in SIBLINGS.get(name, ()) or stack[depth][0] == CLOSED_BY_BLOCK:
                        del stack[depth:]
                    elif stack[depth][0] in LIST_SCOPES or name not in SIBLINGS:
                        break
                in_title = int(name == "title")
                path = stack[-1][1].copy()
                path[crc32(name.encode()) % PATH] += 1
                for names in NAMES.findall(found[3]):
                    for part in PART.findall("".join(names).lower()):
                        path[crc32(b"." + part.encode()) % PATH] += 1
                target = TARGET.search(found[3])
                stack.append((name, path, int(target[1]) if target else stack[-1][2]))
        elif name == "a":
            in_link += 1
    flush()
    return page


# Words that composed training pages name their parts with.
CONTENT = ("article", "main", "div class=content", "div id=main-content", 'div class="post-body"', "section class=article", 'div class="entry-content"', "div class=story", "article class=post", 'div class="article-text"')
MENUS = ("nav", "div class=menu", "ul class=navigation", "div id=nav", 'div class="breadcrumb"', "div role=navigation")
HEADERS = ("header", "div class=header", "div id=masthead", 'div class="site-header"', "div role=banner")
FOOTERS = ("footer", "div class=footer", "div id=footer", 'div class="copyright"', "div role=contentinfo")
SIDES = ("aside", "div class=sidebar", "div id=sidebar", 'div class="related"', "section class=related", "div class=widget", 'div class="popular"')
ADVERTS = ("div class=ad", "div class=advert", 'div class="ads"', "div class=sponsored", "div class=promo", "aside class=ad", 'div class="ad-banner"', "section class=advertisement", "p class=ad")
NOTICES = ("div class=cookie", 'div class="cookie-notice"', "div id=consent", "div class=notice", "div class=popup", "section class=banner", "div role=alert", 'div class="notice"')
FORMS = ("form", "form class=newsletter", "div class=subscribe", "form id=search", "form class=login")
COMMENTS = ("section class=comments", "div id=comments", "div class=comment", 'div class="user-comments"', "section id=responses", "ol class=commentlist", 'div class="replies"')


def compose(rng: np.random.Generator, prose: list[str], other: list[str]) -> str:
    """A page of known targets: prose in a content element, and prose of other pages in everything around it."""
    pick = lambda some: some[rng.integers(len(some))]
    said = lambda: pick(other)

    def part(kind: str, target: int, body: str) -> str:
        name = kind.split()[0]
        return f"<{kind} data-target={target}>{body}</{name}>"

    def some(low: int, high: int, wrap: str) -> str:
        return "".join(wrap.format(said()) for _ in range(rng.integers(low, high)))

    def around(kinds: tuple[str, ...]) -> str:
        kind = pick(kinds)
        if kinds is MENUS or rng.random() < 0.2:
            short = "".join(f"<li><a href=/{k}>{' '.join(said().split()[: rng.integers(1, 4)])}</a></li>" for k in range(rng.integers(2, 9)))
            return part(kind, 0, short if kind.startswith(("ul", "ol")) else f"<ul>{short}</ul>")
        if kinds is FORMS:
            return part(kind, 0, f"<label>{said()[:40]}</label><input name=q><button>{said()[:20]}</button><p>{said()}</p>")
        if kinds is COMMENTS:
            inner = "div class=comment" if rng.random() < 0.5 else "div"
            return part(kind, 0, "".join(f"<{inner}><h4>{said()[:20]}</h4><p>{said()}</p></div>" for _ in range(rng.integers(1, 5))))
        wraps = ("{0}", "<p>{0}</p>", "<h3>{0}</h3>", "<p>{0} <a href=/>{0}</a></p>", "<div>{0}</div>")
        return part(kind, 0, some(1, 4, pick(wraps)))

    inside: list[str] = []
    for k, text in enumerate(prose):
        wrap = "h1" if k == 0 and rng.random() < 0.7 else pick(("p", "p", "p", "p", "p", "h2", "blockquote", "div", "li", "pre"))
        start = "<b>" if rng.random() < 0.1 else ""
        stop = "" if wrap == "p" and rng.random() < 0.2 else f"</{wrap}>"
        inside.append(f"<{wrap}>{start}{html.escape(text)}{'<br>' if start else ''}{stop}")
        if rng.random() < 0.08:
            inside.append(around(pick((ADVERTS, SIDES, FORMS, NOTICES))))
    if rng.random() < 0.15:
        inside.append(around(COMMENTS))
    before = [around(k) for k in (NOTICES, HEADERS, MENUS, ADVERTS, SIDES, FORMS) if rng.random() < 0.4]
    after = [around(k) for k in (SIDES, ADVERTS, COMMENTS, FORMS, NOTICES, FOOTERS, MENUS) if rng.random() < 0.4]
    body = "".join(before) + part(pick(CONTENT), 1, "".join(inside)) + "".join(after)
    if rng.random() < 0.4:
        body = f"<div class={pick(('page', 'wrapper', 'container', 'layout'))}>{body}</div>"
    return f"<html><body>{body}</body></html>"


MARKS = re.compile(r"<(article|main|nav|aside|header|footer|form|section|div)\b", re.I)
AROUND = re.compile(r"menu|nav|footer|header|sidebar|\bad\b|advert|banner|notice|cookie|comment|promo|related|share", re.I)


def weakly_labelled(source: str) -> Page:
    """A page whose own ``article`` or ``main`` element gives the targets."""

    def mark(found: re.Match) -> str:
        name, rest = found[1].lower(), source[found.end() : found.end() + 200].split(">")[0]
        if name in ("article", "main"):
            return f"{found[0]} data-target=1"
        return found[0] if name in ("section", "div") and not AROUND.search(rest) else f"{found[0]} data-target=0"

    return parse(MARKS.sub(mark, source))


class Labeller:
    """A bidirectional LSTM with a logistic output per block, in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(HIDDEN)
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, scale, 2 * HIDDEN).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{way}"] = rng.normal(0, scale, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"b{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over (time, pages, features); padding leaves the state at zero."""
        pages = x.shape[1]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, trace = np.zeros((len(x), pages, HIDDEN), np.float32), []
        gates = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = gates[t] + h @ self.p[f"h{way}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -30, 30))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            was_h, was_c, m = h, c, mask[t][:, None]
            c = (f * c + i * g) * m
            th = np.tanh(c)
            h = o * th * m
            out[t] = h
            if keep:
                trace.append((t, i, f, o, g, was_h, was_c, th, m))
        return out, trace

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, way, False)[0] for way in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {way: self._run(x, mask, way, True) for way in "fb"}
        both = np.concatenate([runs[way][0] for way in "fb"], axis=2)
        wrong = (1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"]))) - y) * mask / mask.sum()
        grads = {"out": np.einsum("tp,tph->h", wrong, both), "bias": wrong.sum(keepdims=True).reshape(1)}
        for k, way in enumerate("fb"):
            d_out = wrong[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            d_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_hidden = np.zeros_like(self.p[f"h{way}"])
            dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            for t, i, f, o, g, was_h, was_c, th, m in reversed(runs[way][1]):
                dh = (dh + d_out[t]) * m
                dc = (dc + dh * o * (1 - th * th)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * was_c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                d_gates[t] = dz
                d_hidden += was_h.T @ dz
                dh, dc = dz @ self.p[f"h{way}"].T, dc * f
            grads[f"h{way}"] = d_hidden
            grads[f"x{way}"] = np.einsum("tpw,tpg->wg", x, d_gates, optimize=True)
            grads[f"b{way}"] = d_gates.sum(axis=(0, 1))
        return grads

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> Labeller:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        pages = sorted(pages, key=lambda p: len(p[1]))
        batches = [pages[at : at + BATCH] for at in range(0, len(pages), BATCH)]
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 10
            for number in rng.permutation(len(batches)):
                x, mask = padded([p[0] for p in batches[number]])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, target) in enumerate(batches[number]):
                    y[: len(target), k] = target
                step += 1
                for k, g in self._gradients(x, mask, y).items():
                    norm = np.sqrt((g * g).sum())
                    g = g / max(1.0, norm)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        found: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted(range(len(pages)), key=lambda k: len(pages[k].texts))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(pages[order[stop]].texts) <= CELLS:
                stop += 1
            which = order[at:stop]
            x, mask = padded([pages[k].features() for k in which])
            good = self.scores(x, mask) > 0
            for column, k in enumerate(which):
                found[k] = good[: len(pages[k].texts), column]
            at = stop
        return found


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as (time, pages, features) and the mask of what is no padding."""
    length = max(map(len, rows))
    x, mask = np.zeros((length, len(rows), WIDTH), np.float32), np.zeros((length, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, 1
    return x, mask


def learn(pages: DataFrame, seed: int = 11) -> Labeller:
    """A labeller trained on a bounded sample: at most ``SAMPLE`` rows, the first by hash, that hold an article or main element.

    Each row serves as it is, its own elements giving the targets, and as prose for composed pages in which menus, headers,
    notices, adverts, forms, sidebars, comments and footers of many names surround the content, filled with other rows' prose.
    """
    usable = F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") < LONGEST_SAMPLED)
    # Of the usable rows only, so that a table with few of them trains as well as one with many.
    some = hash_sample(pages.where(usable), 2 * SAMPLE, "page_id", "url")
    rows = some.orderBy(F.xxhash64("page_id", "url"), "html").select("html").limit(SAMPLE).collect()
    rng = np.random.default_rng(seed)
    real = [weakly_labelled(r["html"]) for r in rows]
    prose = [[t for t, y in zip(p.texts, p.targets) if y] for p in real]
    other = [t for p in prose for t in p] or [
        "A page without any prose.", "Sign in to read more.", "An article in plain words, with some length to it.",
    ]
    plain = [[other[k] for k in rng.integers(len(other), size=rng.integers(1, 20))] for _ in range(max(0, 60 - len(prose)))]
    composed = [parse(compose(rng, p[:30] or other[:1], other)) for p in prose + plain for _ in range(COMPOSED)]
    pieces = []
    for page in real + composed:
        x, y = page.features(), np.array(page.targets, np.float32)
        pieces += [(x[at : at + TRAINING_LENGTH], y[at : at + TRAINING_LENGTH]) for at in range(0, len(y), TRAINING_LENGTH)]
    return Labeller().train(pieces)


def _extracted(labeller: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [parse((h or b"").decode("utf-8", "replace")) for h in binaries(batch.column("html"))]
            texts = ["\n".join(t for t, good in zip(p.texts, keep) if good) for p, keep in zip(pages, labeller.label(pages))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of each row of ``pages(page_id, url, html)``.

    Leaf blocks are labelled together, each from its own tag path, class names and words and from the whole page on
    both sides. Blocks labelled main text are joined by line feeds in page order; white space inside a block is one blank.

    A null or empty html, and one without text, gives an empty text and ``n_chars`` 0. Rows with a null page_id or url
    are treated like any other, repeated rows are all returned, pages of any length are read whole. An empty table gives
    an empty result. Other columns are ignored.
    """
    model = labeller or learn(pages)
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extracted(model), schema)
