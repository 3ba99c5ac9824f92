"""Main text of web pages: a bidirectional LSTM labels every block with the whole page as context.

A page is cut into blocks, the runs of text between block-level tags. A block is described by its tag path (tag
names with their classes, ids and roles, hashed by how near they are), its hashed words and a few
measures (length, links, place). The LSTM reads the sequence in both directions and gives each block the
probability of being main text. It is trained here, in numpy, on a bounded sample of pages whose markup tells
the answer (an article or main element, without what is a menu, notice, form, ... inside it). Sample
pages are varied: the telling tags are replaced by plain ones, and foreign blocks are put in.

Defined results: null or empty html, and a page without main text, give an empty text; an untrained model (no
usable page) goes by the markup, and where that has no article or main element takes all but foreign blocks; scripts, styles, comments and the head are never text; a line break is
white space; unclosed and stray tags are allowed; repeated pages give equal results. Nothing is cut off.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_texts

#: How tags act on blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style head template noscript textarea iframe object svg title".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript template".split())
FOREIGN_TAGS = frozenset("nav aside footer header form menu select button dialog label option".split())
FOREIGN_NAMES = frozenset(
    "ad ads advert advertisement adverts banner sponsored promo promotion nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar side widget related recommended footer header masthead comment comments discussion replies respond disqus cookie cookies consent notice notification alert popup modal newsletter subscribe signup form login share sharing social search pagination pager copyright legal contentinfo complementary".split()
)
#: A quote opens a value only behind "="; other values end at white space or ">". A quote that nothing closes opens none.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^<>=]|=)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 96, 48, 8, 16
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
#: Bounds of the training sample: pages, blocks of a page that are used, and characters of a page.
SAMPLE_PAGES, TRAIN_BLOCKS, TRAIN_CHARS = 600, 80, 200_000
EPOCHS, RATE, THRESHOLD = 10, 0.01, 0.5


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, frozenset], ...]
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    words: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            found.append(Block(text, tuple(t for t in stack if t[0] in BLOCK_TAGS), linked))
        words.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        match = TOKEN.search(page, at)
        chunk = page[at : match.start()] if match else page[at:]
        if chunk and not any(t[0] in HIDDEN_TAGS for t in stack):
            words.append(chunk)
            if any(t[0] == "a" for t in stack):
                linked += len(chunk)
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        tag = match[2].lower()
        if match[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None or tag not in BLOCK_TAGS and any(t[0] in BLOCK_TAGS for t in stack[depth:]):
                continue  # stray, or an inline end tag outside its block
            if tag in BLOCK_TAGS or any(t[0] in BLOCK_TAGS for t in stack[depth:]):
                close()
            del stack[depth:]
            continue
        if tag in BLOCK_TAGS:
            close()
            _imply_ends(stack, tag)
        elif tag == "br":
            words.append(" ")
        if tag in EMPTY_TAGS or match[3].endswith("/") and (tag == "svg" or any(t[0] == "svg" for t in stack)):
            continue  # nothing inside; only foreign elements close themselves
        if tag == "body":  # an unclosed head
            stack[:] = [t for t in stack if t[0] not in HIDDEN_TAGS]
        stack.append((tag, _names(match[3])))
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = stop.start() if stop else end
    close()
    return found


def _imply_ends(stack: list, tag: str) -> None:
    """A block ends an open paragraph and inline tags in it; an item ends the item before it."""
    ended = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
    bounds = ("ul", "ol", "dl", "table", "select") if ended else ()
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name in bounds or name in ("object", "foreignobject") or name in BLOCK_TAGS and name != "p" and name not in ended:
            return
        if name == "p" or name in ended:
            del stack[i:]
            return


def _names(attributes: str) -> frozenset:
    """Words of class, id and role; ``hidden`` if the element is."""
    words = set()
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name in ("class", "id", "role"):
            words.update(re.split(r"[\s_-]+", value.strip("\"'").lower()))
        elif name in ("hidden", "aria-hidden") and value.strip("\"'").lower() != "false" or name == "style" and NO_DISPLAY.search(value):
            words.add("hidden")
    return frozenset(words - {""})


def by_markup(block: Block) -> bool:
    """Main text by the tags alone: inside an article or main element, and in nothing foreign there."""
    start = next((i for i, (t, _) in enumerate(block.path) if t in ("article", "main")), None)
    return start is not None and not foreign(block.path[start:])


def foreign(path: tuple[tuple[str, frozenset], ...]) -> bool:
    """A menu, notice, form, ... or hidden."""
    return any(t in FOREIGN_TAGS or names & FOREIGN_NAMES or "hidden" in names for t, names in path)


def unlearned(page: list[Block]) -> list[Block]:
    """Main text without a model: by the markup, or on a page with no article or main element all that is not foreign."""
    told = any(t in ("article", "main") for b in page for t, _ in b.path)
    return [b for b in page if (by_markup(b) if told else not foreign(b.path))]


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def features(page: list[Block]) -> np.ndarray:
    """One row per block: tag path, words, measures."""
    out = np.zeros((len(page), DIMS), dtype=np.float32)
    known: dict = {}
    for i, block in enumerate(page):
        if block.path not in known:
            row = np.zeros(PATH_DIMS, dtype=np.float32)
            for near, (tag, names) in enumerate(reversed(block.path)):
                weight = 1.0 if near == 0 else 0.7
                row[bucket(f"{tag}:{min(near, 1)}", PATH_DIMS)] += weight
                for name in names:
                    row[bucket(f"#{'foreign' if name in FOREIGN_NAMES else name}", PATH_DIMS)] += weight
            known[block.path] = np.minimum(row, 2)
        out[i, :PATH_DIMS] = known[block.path]
        words = block.text.lower().split()
        hashed = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_DIMS for w in words]
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(hashed, minlength=WORD_DIMS) / max(1, len(words)) ** 0.5
        out[i, -MEASURES:] = (
            np.log1p(len(words)) / 4,
            min(1.0, block.linked / max(1, len(block.text))),
            block.text[-1] in ".!?…\"”",
            sum(block.text.count(c) for c in ".,;") / max(1, len(words)),
            "©" in block.text or "|" in block.text,
            i / len(page),
            1.0 if i == 0 else 0.0,
            1.0,
        )
    return out


PARTS = ("in_f", "re_f", "in_b", "re_b", "out")


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent) and of the output; gates are i, f, o, g."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Labeller:
        random = np.random.default_rng(seed)
        shapes = ((DIMS, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN)) * 2 + ((2 * HIDDEN + 1, 1),)
        return Labeller({n: (random.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for n, s in zip(PARTS, shapes, strict=True)})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, mask: np.ndarray, w_in: np.ndarray, w_re: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages x blocks x HIDDEN) of one direction; masked steps leave the state as it is."""
    n, length, _ = x.shape
    ready = x @ w_in
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    states = np.zeros((n, length, HIDDEN), np.float32)
    for t in range(length):
        z = ready[:, t] + h @ w_re
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        m = mask[:, t, None]
        c_next = np.where(m, f * c + i * new, c)
        h_next = np.where(m, o * np.tanh(c_next), h)
        if keep is not None:
            keep.append((h, c, c_next, i, f, o, new, m))
        h, c = h_next, c_next
        states[:, t] = h
    return states


def _back(x: np.ndarray, slope: np.ndarray, kept: list, w_re: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a direction's weights from those of its hidden states."""
    n, length, _ = x.shape
    d_ready = np.zeros((n, length, 4 * HIDDEN), np.float32)
    d_re = np.zeros_like(w_re)
    d_h, d_c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(length - 1, -1, -1):
        h, c, c_next, i, f, o, new, m = kept[t]
        d_h = d_h + slope[:, t]
        through_h, through_c = np.where(m, 0, d_h), np.where(m, 0, d_c)
        bent = np.tanh(c_next)
        d_h, d_cell = np.where(m, d_h, 0), np.where(m, d_c, 0)
        d_cell = d_cell + d_h * o * (1 - bent**2)
        d_z = np.concatenate([d_cell * new * i * (1 - i), d_cell * c * f * (1 - f), d_h * bent * o * (1 - o), d_cell * i * (1 - new**2)], axis=1)
        d_ready[:, t] = d_z
        d_re += h.T @ d_z
        d_h, d_c = d_z @ w_re.T + through_h, d_cell * f + through_c
    return x.reshape(-1, DIMS).T @ d_ready.reshape(-1, 4 * HIDDEN), d_re


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), length, DIMS), np.float32), np.zeros((len(pages), length), bool)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, True
    return x, mask


def probabilities(pages: list[np.ndarray], model: Labeller) -> list[np.ndarray]:
    """For every page, the probability of each block; pages of like length run together."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        take = max(1, min(256, 20_000 // len(pages[order[min(at + 255, len(order) - 1)]])))
        some = order[at : at + take]
        at += take
        x, mask = _padded([pages[i] for i in some])
        p = _forward(x, mask, model.weights)[0]
        for row, i in enumerate(some):
            out[i] = p[row, : len(pages[i])]
    return out


def _forward(x, mask, w, keep=None):
    ahead = _run(x, mask, w["in_f"], w["re_f"], keep[0] if keep else None)
    behind = _run(x[:, ::-1], mask[:, ::-1], w["in_b"], w["re_b"], keep[1] if keep else None)[:, ::-1]
    both = np.concatenate([ahead, behind, np.ones((*mask.shape, 1), np.float32)], axis=2)
    return _sigmoid(both @ w["out"])[..., 0], both


def fit(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Cross-entropy by Adam over batches of pages; examples are (features, labels)."""
    model, random = Labeller.fresh(seed), np.random.default_rng(seed)
    w = model.weights
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        # pages of like length together, in a random order of batches
        order = sorted(random.permutation(len(examples)), key=lambda i: len(examples[i][1]))
        for start in random.permutation(range(0, len(order), 32)):
            some = [examples[i] for i in order[start : start + 32]]
            x, mask = _padded([e[0] for e in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, labels) in enumerate(some):
                y[i, : len(labels)] = labels
            kept: tuple[list, list] = ([], [])
            p, both = _forward(x, mask, w, kept)
            error = (np.where(mask, p - y, 0)[..., None] / max(1, mask.sum())).astype(np.float32)
            slopes = {"out": both.reshape(-1, 2 * HIDDEN + 1).T @ error.reshape(-1, 1)}
            d_both = error @ w["out"].T
            slopes["in_f"], slopes["re_f"] = _back(x, d_both[..., :HIDDEN], kept[0], w["re_f"])
            slopes["in_b"], slopes["re_b"] = _back(x[:, ::-1], d_both[:, ::-1, HIDDEN : 2 * HIDDEN], kept[1], w["re_b"])
            step += 1
            for k in PARTS:
                mean[k] += 0.1 * (slopes[k] - mean[k])
                square[k] += 0.001 * (slopes[k] ** 2 - square[k])
                w[k] -= (RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def varied(page: list[Block], answers: list[bool], random: np.random.Generator) -> tuple[list[Block], list[bool]]:
    """A training page with its telling tags made plain at times, and foreign blocks of other forms put in."""
    tag = str(random.choice(["article", "article", "main", "div", "div", "section"]))
    names = [frozenset({str(random.choice(["content", "post", "entry", "story", "body", "text", "main"]))}), frozenset()][int(random.random() < 0.5)]
    made = [Block(b.text, tuple((tag, names if tag in ("div", "section") else n) if t in ("article", "main") else (t, n) for t, n in b.path), b.linked) for b in page]
    base = next((b.path for b, a in zip(made, answers, strict=True) if a), ())
    outer = next((base[:i] for i, (t, n) in enumerate(base) if t in ("article", "main") or n and n == names), base[:-1])
    for i, block in enumerate(made):  # other forms of text inside the main part
        if answers[i] and random.random() < 0.2:
            form = tuple((str(t), frozenset()) for t in str(random.choice(["h1", "h2", "h3", "blockquote", "blockquote p", "ul li", "ol li", "pre", "figure figcaption", "div", "div p", "section p", "section h2", "table tr td"])).split())
            made[i] = Block(block.text, block.path[:-1] + form, block.linked)
    out, told = list(made), list(answers)
    texts = [b.text for b in page]
    kinds = ["aside", "header", "footer", "form", "nav", "comments", "notice", "sidebar", "related", "cookie", "newsletter", "share", "ad", "promo", "menu"]
    for _ in range(int(random.integers(0, 7))):
        kind = str(random.choice(kinds))
        element = (kind, frozenset()) if kind in FOREIGN_TAGS else (str(random.choice(["div", "section", "ul"])), frozenset({kind}))
        path = (*(base[:-1] if random.random() < 0.4 else outer), element)
        path += ((str(random.choice(["p", "li", "div", "h3", "span"])), frozenset()),) if random.random() < 0.7 else ()
        path = tuple(t for t in path if t[0] in BLOCK_TAGS)
        text = str(random.choice(texts))
        text = text if random.random() < 0.5 else " ".join(text.split()[: int(random.integers(1, 12))])
        count = int(random.integers(1, 4))
        place = int(random.integers(0, len(out) + 1))
        out[place:place] = [Block(text, path, len(text) if random.random() < 0.4 else 0)] * count
        told[place:place] = [False] * count
    return out, told


def train(pages: DataFrame, html: str = "html", key: str = "page_id", sample_pages: int = SAMPLE_PAGES, seed: int = 7) -> Labeller | None:
    """Fit on about ``sample_pages`` pages whose markup tells; drawn by a hash of the key."""
    rows = pages.where(F.col(html).rlike("(?i)<(article|main)")).select(F.col(html).cast("string").alias("_html"), F.xxhash64(F.col(key).cast("string"), F.lit("pages")).alias("_draw"))
    total = rows.count()
    share = min(1.0, 1.5 * sample_pages / max(total, 1))
    drawn = rows.where(F.shiftrightunsigned("_draw", 34) < F.lit(int(share * 2**30))).where(F.length("_html") < TRAIN_CHARS).orderBy("_draw").limit(sample_pages)
    random, examples = np.random.default_rng(seed), []
    for row in sorted(drawn.collect(), key=lambda r: r["_draw"]):
        page = blocks(row["_html"])[:TRAIN_BLOCKS]
        answers = [bool(by_markup(b)) for b in page]
        if any(answers):
            for out, told in ((page, answers), *(varied(page, answers, random) for _ in range(2))):
                examples.append((features(out), np.array(told, dtype=np.float32)))
    return fit(examples, seed=seed) if examples else None


def main_texts(pages: list[str], model: Labeller | None) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    if model is None:
        return ["\n\n".join(b.text for b in unlearned(page)) for page in cut]
    labels = probabilities([features(p) for p in cut], model)
    return ["\n\n".join(b.text for b, p in zip(page, given, strict=True) if p > THRESHOLD) for page, given in zip(cut, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: carried columns, ``text`` and ``n_chars``."""

    def work(found, _):
        texts = main_texts(found, model)
        return [texts, [len(t) for t in texts]]

    return map_texts(pages, html, {c: c for c in carry}, [("text", "string", pa.string()), ("n_chars", "long", pa.int64())], work)
