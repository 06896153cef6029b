"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order. Each block is a vector of its tag path (hashed names, classes and ids of the open
elements), its hashed words and a few numbers; a bidirectional LSTM in numpy reads the whole page and decides for every block
whether it belongs to the article. It learns from a bounded sample of pages whose blocks are labelled by the meaning of their
elements; the sample is varied with other containers and with foreign blocks (notices, forms, comments), so that it also
knows elements that these pages lack."""
from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import Slice, table

#: Pages that are learnt from, about, chosen by a hash of the id.
TRAIN_PAGES = 200
PATHS, WORDS = 512, 1024
PATH_SIZE, WORD_SIZE, NUMBERS, HIDDEN = 12, 6, 4, 12
BATCH, CELLS = 64, 40_000
EPOCHS, RATE = 16, 0.02
#: Characters of html that are labelled together.
PIECE_CHARS = 4_000_000

# Element names by what they are, from the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style noscript template iframe object svg math canvas textarea select option".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
FOREIGN = frozenset("nav header footer aside form button dialog menu head title script style noscript template iframe object "
                    "svg math canvas textarea select option label input fieldset legend".split())
ARTICLE = frozenset("article main".split())
# Words of classes and ids that name what is not article text, and what is.
FOREIGN_WORDS = frozenset("ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies "
                          "consent gdpr notice alert popup modal overlay sidebar side menu nav navigation navbar breadcrumb "
                          "breadcrumbs toolbar share sharing social related recommended more header masthead footer comment "
                          "comments reply replies respond disqus subscribe newsletter signup login search form widget pager "
                          "pagination tags copyright legal".split())
ARTICLE_WORDS = frozenset("article content main post entry story body text".split())

_RAW = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:svg|math)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?<=/)>"
                  r"|<(script|style|noscript|template|iframe|svg|math|textarea|select)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
# As in the standard, a quote opens a value only directly behind an equals sign; elsewhere it is a character of a name or value.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _element(name: str, attributes: str) -> str:
    """Name of an element with the words of its class, id and role."""
    if "=" not in attributes:
        return name
    words = [w for m in _NAMES.finditer(attributes) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()) if w]
    return ".".join([name, *words])


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page with their text, references decoded and white space folded. Markup, comments, scripts and styles
    are no text; unclosed elements end where the standard ends them, or with the page; blocks without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = in_link = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal parts, linked, in_link
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, path, linked))
        parts, linked, in_link = [], 0, 0

    def pop_to(names) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return

    page = _RAW.sub(" ", page or "")
    last = 0
    for m in _TAG.finditer(page):
        if m.start() > last:
            chunk = page[last:m.start()]
            parts.append(chunk)
            if in_link:
                linked += len(chunk)
        last = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            elif name == "br" or name == "img":
                parts.append(" ")
            continue
        flush()
        if m[1]:
            if any(name == s[0] for s in stack):
                pop_to((name,))
        else:
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            elif name in SAME_CLOSES and stack and stack[-1][0] in SAME_CLOSES[name]:
                stack.pop()
            if name not in VOID and not m[3].endswith("/"):
                stack.append((name, _element(name, m[3])))
        path = tuple(s[1] for s in stack)
    if last < len(page):
        parts.append(page[last:])
    flush()
    return out


def meaning(block: Block) -> bool:
    """Whether the elements around a block say that it is article text: the labels the network learns from."""
    inside = False
    for element in block.path:
        name, *words = element.split(".")
        if name in FOREIGN or name in HIDDEN_TEXT or FOREIGN_WORDS.intersection(words):
            return False
        inside |= name in ARTICLE or bool(ARTICLE_WORDS.intersection(words))
    return inside


def _hash(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % buckets


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_features(path: tuple[str, ...]) -> np.ndarray:
    """Buckets of a tag path: each element's name and words, the last element, and the pair of the last two."""
    if path not in _paths:
        if len(_paths) > 100_000:
            _paths.clear()
        names = [e.split(".") for e in path]
        found = [f"{'last' if k == len(names) - 1 else 'in'} {n[0]}" for k, n in enumerate(names)]
        found += [f"in {n[0]}" for n in names[-1:]] + [f"word {w}" for n in names for w in n[1:]]
        if len(names) > 1:
            found.append(f"pair {names[-2][0]} {names[-1][0]}")
        _paths[path] = np.array([_hash(f, PATHS) for f in found] or [_hash("none", PATHS)])
    return _paths[path]


@dataclass
class Features:
    """Of many blocks: path buckets and word buckets with their first positions, numbers, and blocks per page."""
    path: np.ndarray
    path_first: np.ndarray
    word: np.ndarray
    word_first: np.ndarray
    numbers: np.ndarray
    sizes: list[int]


def features(pages: list[list[Block]]) -> Features:
    blocks = [b for page in pages for b in page]
    data = [b.text.encode("utf-8", "surrogatepass") for b in blocks]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    words = Slice(0, np.frombuffer(b"".join(data), np.uint8), offsets).words(lower=True)
    paths = [path_features(b.path) for b in blocks]
    numbers = np.zeros((len(blocks), NUMBERS), np.float32)
    if blocks:
        size = np.array([len(b.text) for b in blocks], float)
        numbers[:, 0] = np.log1p(size) / 8
        numbers[:, 1] = np.minimum(np.array([b.linked for b in blocks]) / np.maximum(size, 1), 1)
        numbers[:, 2] = np.log1p([len(b.path) for b in blocks])
        numbers[:, 3] = [b.text[-1:] in ".!?" for b in blocks]
    return Features(np.concatenate(paths) if paths else np.zeros(0, int), np.r_[0, np.cumsum([len(p) for p in paths])].astype(int),
                    (words.code >> np.uint64(54)).astype(int), words.first, numbers, [len(p) for p in pages])


def _sums(weights: np.ndarray, bucket: np.ndarray, first: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Rows of ``weights`` added up per block, times the block's ``share``."""
    total = np.zeros((len(bucket) + 1, weights.shape[1]), np.float64)
    np.cumsum(weights[bucket], axis=0, out=total[1:])
    return ((total[first[1:]] - total[first[:-1]]) * share[:, None]).astype(np.float32)


def _inputs(model: dict, path: np.ndarray, path_first: np.ndarray, word: np.ndarray, word_first: np.ndarray,
            numbers: np.ndarray, word_share: np.ndarray) -> np.ndarray:
    """Vectors of blocks: path elements add up, so that one foreign element counts the same at any depth; words average."""
    return np.concatenate([_sums(model["path"], path, path_first, np.ones(len(numbers), np.float32)),
                           _sums(model["word"], word, word_first, word_share), numbers], 1)


def _word_share(n: np.ndarray) -> np.ndarray:
    return (1 / np.maximum(n, 1)).astype(np.float32)


def fresh_model() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    n = PATH_SIZE + WORD_SIZE + NUMBERS
    model = {"path": rng.normal(0, 0.3, (PATHS, PATH_SIZE)), "word": rng.normal(0, 0.02, (WORDS, WORD_SIZE)),
             "out": rng.normal(0, 0.3, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
    for side in ("f", "b"):
        model["w" + side] = rng.normal(0, 1 / np.sqrt(n + HIDDEN), (n + HIDDEN, 4 * HIDDEN))
        model["c" + side] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, c0: np.ndarray, keep: bool):
    """Hidden states of a batch (pages, steps, inputs); steps outside a page leave the state alone."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((n, steps, HIDDEN), np.float32), []
    inner = x @ w[:-HIDDEN] + c0
    for t in range(steps):
        z = inner[:, t] + h @ w[-HIDDEN:]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[:, t, None]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
        out[:, t] = h
    return out, tape


def _lstm_back(x: np.ndarray, w: np.ndarray, tape: list, d_out: np.ndarray):
    """Gradients of weights, offsets and inputs."""
    dw, dc0, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.zeros_like(x)
    dh = np.zeros((len(x), HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    for t in range(len(tape) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + d_out[:, t]
        own, rest = np.where(m, dh, 0), np.where(m, 0, dh)
        d_new = np.where(m, dc, 0) + own * o * (1 - tc * tc)
        dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * tc * o * (1 - o),
                             d_new * i * (1 - g * g)], 1)
        dw[:-HIDDEN] += x[:, t].T @ dz
        dw[-HIDDEN:] += h.T @ dz
        dc0 += dz.sum(0)
        dx[:, t] = dz @ w[:-HIDDEN].T
        dh = rest + dz @ w[-HIDDEN:].T
        dc = np.where(m, d_new * f, dc)
    return dw, dc0, dx


def _batch(inputs: np.ndarray, sizes: list[int]):
    """Inputs of some pages one after another, as (pages, steps, inputs) with a mask, the same with each page in reverse, and
    the reversed order of steps."""
    steps = max(sizes)
    x = np.zeros((len(sizes), steps, inputs.shape[1]), np.float32)
    mask = np.arange(steps) < np.array(sizes)[:, None]
    x[mask] = inputs
    flip = np.where(mask, np.array(sizes)[:, None] - 1 - np.arange(steps), np.arange(steps))
    return x, mask, np.take_along_axis(x, flip[:, :, None], 1), flip


def probabilities(model: dict, f: Features) -> np.ndarray:
    """Probability of every block to be article text. Pages of similar length are read together."""
    inputs = _inputs(model, f.path, f.path_first, f.word, f.word_first, f.numbers, _word_share(np.diff(f.word_first)))
    out = np.zeros(len(inputs))
    first = np.r_[0, np.cumsum(f.sizes)].astype(int)
    order = [p for p in sorted(range(len(f.sizes)), key=lambda p: f.sizes[p]) if f.sizes[p]]
    k = 0
    while k < len(order):
        n = 1  # the longest page of a batch says how long all are: a long page is alone
        while n < BATCH and k + n < len(order) and (n + 1) * f.sizes[order[k + n]] <= CELLS:
            n += 1
        pages = order[k:k + n]
        k += n
        sizes = [f.sizes[p] for p in pages]
        x, mask, back, flip = _batch(np.concatenate([inputs[first[p]:first[p + 1]] for p in pages]), sizes)
        forward, _ = _lstm(x, mask, model["wf"], model["cf"], False)
        reverse, _ = _lstm(back, mask, model["wb"], model["cb"], False)
        both = np.concatenate([forward, np.take_along_axis(reverse, flip[:, :, None], 1)], 2)
        p = _sigmoid((both @ model["out"])[:, :, 0] + model["bias"])
        for row, page in enumerate(pages):
            out[first[page]:first[page] + f.sizes[page]] = p[row, :f.sizes[page]]
    return out


def varied(pages: list[list[Block]], seed: int = 3) -> list[list[Block]]:
    """Each page as it is, and twice more with another container of the article and with foreign blocks at random places."""
    rng = np.random.default_rng(seed)
    containers = ["article", "main", "div.content", "div.post.body", "section.article", "div.entry.content", "div.main.content",
                  "article.post", "div.story"]
    foreign = [("aside", "p"), ("div.sidebar", "ul", "li"), ("header", "div"), ("header", "nav", "ul", "li"), ("form", "p"),
               ("form.search", "div"), ("div.cookie.notice", "p"), ("div.consent.banner",), ("div.ad",), ("div.advert", "p"),
               ("section.comments", "div.comment", "p"), ("div.comments", "ol", "li"), ("footer", "p"), ("footer", "ul", "li"),
               ("div.related", "ul", "li"), ("div.share",), ("div.newsletter", "p"), ("nav", "ol", "li"), ("dialog", "p"),
               ("div.promo",), ("div.sidebar", "p"), ("div.sidebar", "div", "p"), ("div.ad", "p"), ("header", "p"), ("header", "h1"),
               ("div", "nav", "ul", "li"), ("div.footer", "p"), ("div.header", "h1"), ("div.breadcrumbs", "ul", "li"), ("div.menu", "li"), ("div.popup", "div"), ("div.login", "form", "p")]
    within = [("aside", "p"), ("div.ad",), ("div.comments", "p"), ("section.comments", "div", "p"), ("form", "p"),
              ("div.related", "li"), ("footer", "p"), ("header", "p"), ("div.share",), ("div.notice", "p"), ("nav", "li"),
              ("nav", "ul", "li"), ("div.sidebar", "ul", "li"), ("div.sidebar", "p"), ("div.ad", "p")]
    kinds = [("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("h2",), ("h3",), ("pre",), ("table", "tr", "td"), ("div", "p"),
             ("section", "p"), ("section", "h2"), ("dl", "dd"), ("figure", "figcaption"), ("div",), ("table", "tbody", "tr", "td")]
    texts = [b.text for page in pages for b in page] or [""]
    out = list(pages)
    for page in [*pages, *pages]:
        box = containers[rng.integers(len(containers))]
        new = []
        for b in page:
            path = tuple(box if e.split(".")[0] in ARTICLE else e for e in b.path)
            if path[-1:] == ("p",) and rng.random() < 0.3:
                path = (*path[:-1], *kinds[rng.integers(len(kinds))])
            new.append(Block(b.text, path, b.linked))
        for _ in range(rng.integers(1, 9)):
            text = texts[rng.integers(len(texts))]
            at = int(rng.integers(len(new) + 1))
            if rng.random() < 0.4:
                path = ("html", "body", box, *within[rng.integers(len(within))])
            else:
                path = ("html", "body", *foreign[rng.integers(len(foreign))])
            new.insert(at, Block(text, path, len(text) if rng.random() < 0.3 else 0))
        out.append(new)
    return out


def fit(pages: list[list[Block]]) -> dict[str, np.ndarray]:
    """A network trained on the blocks of some pages; without blocks it stays as it starts."""
    pages = [p for p in varied(pages) if p]
    model = fresh_model()
    if not pages:
        return model
    f = features(pages)
    label = np.array([meaning(b) for page in pages for b in page], np.float32)
    first = np.r_[0, np.cumsum(f.sizes)].astype(int)
    rng = np.random.default_rng(9)
    mean, square = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        shuffled = sorted(rng.permutation(len(pages)).tolist(), key=lambda p: f.sizes[p] + rng.random() * 5)
        groups = [shuffled[k:k + 16] for k in range(0, len(shuffled), 16)]
        for g in rng.permutation(len(groups)).tolist():
            chosen = groups[g]
            own = np.concatenate([np.arange(first[p], first[p + 1]) for p in chosen])
            path_at = _ranges(f.path_first, own)
            word_at = _ranges(f.word_first, own)
            n_path, n_word = np.diff(f.path_first)[own], np.diff(f.word_first)[own]
            # half of the blocks are read without their words, so that the network does not lean on them
            share = _word_share(n_word) * (rng.random(len(own)) < 0.5)
            live = _inputs(model, f.path[path_at], np.r_[0, np.cumsum(n_path)], f.word[word_at], np.r_[0, np.cumsum(n_word)],
                           f.numbers[own], share.astype(np.float32))
            x, mask, back, flip = _batch(live, [f.sizes[p] for p in chosen])
            forward, tape_f = _lstm(x, mask, model["wf"], model["cf"], True)
            reverse, tape_b = _lstm(back, mask, model["wb"], model["cb"], True)
            both = np.concatenate([forward, np.take_along_axis(reverse, flip[:, :, None], 1)], 2)
            p = _sigmoid((both @ model["out"])[:, :, 0] + model["bias"])
            want = np.zeros_like(p)
            want[mask] = label[own]
            dz = np.where(mask, p - want, 0).astype(np.float32) / mask.sum() * 8
            grads = {"out": np.einsum("pth,pt->h", both, dz)[:, None], "bias": dz.sum(keepdims=True)[0]}
            d_both = dz[:, :, None] * model["out"][:, 0]
            d_back = np.take_along_axis(d_both[:, :, HIDDEN:], flip[:, :, None], 1)
            grads["wf"], grads["cf"], dxf = _lstm_back(x, model["wf"], tape_f, d_both[:, :, :HIDDEN])
            grads["wb"], grads["cb"], dxb = _lstm_back(back, model["wb"], tape_b, d_back)
            dx = (dxf + np.take_along_axis(dxb, flip[:, :, None], 1))[mask]
            for name, bucket, n, part in (("path", f.path[path_at], n_path, dx[:, :PATH_SIZE]),
                                          ("word", f.word[word_at], n_word,
                                           dx[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] * share[:, None])):
                grads[name] = np.zeros_like(model[name])
                np.add.at(grads[name], bucket, np.repeat(part, n, axis=0))
            grads["word"] += 1e-4 * model["word"]
            step += 1
            for k, grad in grads.items():
                mean[k] += 0.1 * (grad - mean[k])
                square[k] += 0.01 * (grad * grad - square[k])
                model[k] -= (rate * mean[k] / (1 - 0.9 ** step)
                             / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32).reshape(model[k].shape)
    return model


def _ranges(first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Positions first[i]..first[i + 1] of all ``own``, one after another."""
    n = first[own + 1] - first[own]
    return np.repeat(first[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _fit_group(group: pa.Table) -> pa.Table:
    rows = sorted(x for x in group.column("html").to_pylist() if x)
    model = fit([blocks_of(x) for x in rows])
    return pa.table({"name": list(model), "shape": pa.array([list(v.shape) for v in model.values()], pa.list_(pa.int32())),
                     "data": pa.array([v.astype(np.float32).tobytes() for v in model.values()], pa.binary())})


def train(pages: DataFrame, *, key: str = "page_id", html_column: str = "html", rows: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """A network learnt from about ``rows`` pages, in one task."""
    known = pages.select(F.col(key).alias("key"), F.col(html_column).alias("html")).filter(F.col("html").isNotNull())
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * (rows / n)))
    found = known.select("html", F.lit(0).alias("all")).groupBy("all").applyInArrow(
        _fit_group, "name string, shape array<int>, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in found} or fresh_model()


def extract(pages: DataFrame, model: dict[str, np.ndarray], *, key: str = "page_id", url: str = "url",
            html_column: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of ``pages``: the article's blocks in page order, joined by line feeds.

    A null or empty page, or one without article blocks, has an empty text. Null keys and urls are carried, repeated rows
    answered one by one, other columns not read, pages read whole."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, i = batch.column("html").to_pylist(), [], 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and (j == i or size + len(rows[j] or "") <= PIECE_CHARS):
                    size += len(rows[j] or "")
                    j += 1
                cut = [blocks_of(x) for x in rows[i:j]]
                kept = probabilities(shared.value, features(cut)) >= 0.5 if any(cut) else []
                at = 0
                for page in cut:
                    texts.append("\n".join(b.text for b, keep in zip(page, kept[at:at + len(page)]) if keep))
                    at += len(page)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    source = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                          F.col(html_column).alias("html"))
    out = source.mapInArrow(run, "key long, url string, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
