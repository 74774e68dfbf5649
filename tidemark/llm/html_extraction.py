"""Main text of web pages by a recurrent labeller of blocks.

A page becomes a sequence of leaf blocks. A bidirectional LSTM in numpy reads, for each block,
its tag path (with class and id words), hashed word vectors and a few counts, and labels every
block main text or not with the whole page as context. It is trained on a bounded sample of
pages whose blocks are labelled by their mark-up, with boilerplate of other kinds strewn in, so
that it learns more layouts than the sample has.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import least_hashes, map_texts, table
from .word_arrays import NOT_SPACE, Words

#: Hashed inputs for path and words, hidden units a direction, pages of the training sample, rounds over it, pages of a batch.
PATH, WORDS, COUNTS, HIDDEN, SAMPLE_PAGES, ROUNDS, BATCH = 256, 32, 4, 16, 400, 8, 16
WIDTH = PATH + WORDS + COUNTS
#: Blocks, padding included, that the network sees at once; longer pages are read in slices, with states carried over.
CELLS = 1 << 14
#: Names of a tag path that are kept, from its outer and its inner end, so that deep pages stay linear.
OUTER, INNER = 8, 56

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template svg annotation iframe head title textarea select".split())
TO_THE_END = set("script style noscript title textarea".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img canvas object math menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = set("li dt dd tr td th option thead tbody tfoot".split())
SCOPES = set("html body table td th div article section main aside nav header footer form ul ol dl blockquote button".split())
SIDE = set("nav header footer aside form menu button dialog".split())
MAIN = set("article main".split())
SIDE_WORDS = re.compile(r"^(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|widget\w*|footer|header|masthead|copyright|comment\w*|reply|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|tags?)$")
MAIN_WORDS = re.compile(r"^(article\w*|main|content|entry|post|story|body|text)$")

TOKEN = re.compile(
    r"""<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>?"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)|<""")
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[^\W_]+")


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) of every leaf block that has text, in page order.

    Path elements are tag names, each followed by its class, id and role words as `.word`.
    Character references are decoded once, white space becomes one space, a line break counts
    as white space. Elements that are left open end with what holds them, as browsers do it.
    Of a path of more than OUTER + INNER elements the middle is left out.
    """
    page, out = page if isinstance(page, str) else "", []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = [0]

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            held = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            out.append((tuple(x for name, words in held if name not in INLINE for x in (name, *words)), text, linked[0]))
        parts.clear()
        linked[0] = 0

    def close(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if not all(name in INLINE for name, _ in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def text(value: str) -> None:
        if value:
            parts.append(value)
            if any(name == "a" for name, _ in stack):
                linked[0] += len(value)

    at = 0
    while True:
        mark = page.find("<", at)
        text(page[at:mark] if mark >= 0 else page[at:])
        if mark < 0:
            break
        found = TOKEN.match(page, mark)
        at, tag = found.end(), (found["tag"] or "").lower()
        if not tag:
            if found[0] == "<":
                text("<")
            continue
        if found["end"]:
            if tag == "br":
                text(" ")
            else:
                close({tag}, set() if tag in SCOPES else SCOPES - {tag})
            continue
        if tag in SKIPPED and tag != "head":
            if not found["attrs"].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                if tag not in INLINE:
                    flush()
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                # of what is left open only these hide the rest of the page
                at = end.end() if end else len(page) if tag in TO_THE_END else at
            continue
        if tag in ("br", "img", "wbr"):
            text(" " if tag != "wbr" else "")
            continue
        if tag not in INLINE:
            close(CLOSED_BY_BLOCK, SCOPES)
            if tag in CLOSED_BY_SAME:
                close({tag} | ({"td", "th"} if tag in ("td", "th", "tr") else {"dt", "dd"} if tag in ("dt", "dd") else set()), {"table", "ul", "ol", "dl", "select"})
            flush()
        if tag in VOID:
            continue
        words = tuple("." + w for m in ATTR.finditer(found["attrs"]) for w in NAME.findall((m[1] or m[2] or m[3] or "").lower()))
        stack.append((tag, words))
    flush()
    return [(path, value, link) for path, value, link in out if "head" not in path or "body" in path]


def markup_label(path: tuple[str, ...]) -> int:
    """1 where mark-up says main text: what innermost says main or side decides; else paragraphs and headings are main."""
    for x in reversed(path):
        word = x[1:] if x[0] == "." else ""
        if x in SIDE or word and SIDE_WORDS.match(word):
            return 0
        if x in MAIN or word and MAIN_WORDS.match(word):
            # a notice around an article does not unmake it, a menu inside it does
            return 1
    return int(bool({"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "dd"} & set(path[-1:])))


@functools.lru_cache(maxsize=1 << 17)
def _slot(value: str, size: int) -> int:
    return zlib.crc32(value.encode()) % size


def vectors(page: list[tuple[tuple[str, ...], str, int]], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One input row for each block of a page, or of a slice of it."""
    own = page[start:stop] if start or stop is not None else page
    x = np.zeros((len(own), WIDTH), dtype=np.float32)
    for i, (path, text, linked) in enumerate(own):
        for name in set(path):
            x[i, _slot(name, PATH)] = 1
        if path:
            last = next((n for n in reversed(path) if n[0] != "."), "")
            x[i, _slot("last:" + last, PATH)] = 1
        x[i, -COUNTS:] = 0, linked / max(1, len(text)), (start + i) / len(page), text[-1] in ".!?:;\"'"
    if own:
        words = Words([text.encode().lower() for _, text, _ in own], NOT_SPACE)
        slots = (words.hashes() >> np.uint64(33)).astype(np.int64) % WORDS
        x[:, PATH:PATH + WORDS] = np.bincount(words.text * WORDS + slots, minlength=len(own) * WORDS).reshape(-1, WORDS) / words.count[:, None]
        x[:, -COUNTS] = np.log1p(words.count) / 5
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = weights or {
            **{f"x{d}": rng.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32) for d in "fb"},
            **{f"h{d}": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32) for d in "fb"},
            **{f"c{d}": np.repeat(np.array([0, 1, 0, 0], dtype=np.float32), HIDDEN) for d in "fb"},
            "o": rng.normal(0, 0.15, 2 * HIDDEN).astype(np.float32), "oc": np.zeros(1, dtype=np.float32)}

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN:(k + 1) * HIDDEN], -30, 30))) for k in range(3))
        return i, f, o, np.tanh(z[:, 3 * HIDDEN:])

    def _one_way(self, x: np.ndarray, mask: np.ndarray, d: str, state: tuple | None = None, keep: bool = False) -> tuple[np.ndarray, list, tuple]:
        """Outputs of a direction, what a backward pass needs (if kept), and the state at the end."""
        n, steps = x.shape[0], x.shape[1]
        h, c = state or (np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32))
        out, kept, fed = np.zeros((n, steps, HIDDEN), dtype=np.float32), [], x @ self.w["x" + d] + self.w["c" + d]
        for t in range(steps) if d == "f" else reversed(range(steps)):
            m = mask[:, t:t + 1]
            i, f, o, g = self._gates(fed[:, t] + h @ self.w["h" + d])
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, th))
            h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out, kept, (h, c)

    def _main(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.concatenate([ahead, back], axis=-1) @ self.w["o"] + self.w["oc"], -30, 30)))

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities of main text, (pages, blocks)."""
        return self._main(self._one_way(x, mask, "f")[0], self._one_way(x, mask, "b")[0])

    def page_scores(self, page: list, cells: int = CELLS) -> np.ndarray:
        """The same for one page of any length: slices forwards, whose outputs are kept, then slices backwards."""
        n, ahead, p = len(page), np.zeros((len(page), HIDDEN), dtype=np.float32), np.zeros(len(page), dtype=np.float32)
        slices, state = [(a, min(n, a + cells)) for a in range(0, n, cells)], None
        for a, b in slices:
            out, _, state = self._one_way(vectors(page, a, b)[None], np.ones((1, b - a), dtype=np.float32), "f", state)
            ahead[a:b] = out[0]
        state = None
        for a, b in reversed(slices):
            out, _, state = self._one_way(vectors(page, a, b)[None], np.ones((1, b - a), dtype=np.float32), "b", state)
            p[a:b] = self._main(ahead[a:b], out[0])
        return p

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        ways = {d: self._one_way(x, mask, d, keep=True) for d in "fb"}
        both = np.concatenate([ways[d][0] for d in "fb"], axis=2)
        p = self._main(ways["f"][0], ways["b"][0])
        slope = (p - y) * mask / mask.sum()
        grads = {"o": np.einsum("nt,ntk->k", slope, both), "oc": np.array([slope.sum()], dtype=np.float32)}
        for k, d in enumerate("fb"):
            above = slope[:, :, None] * self.w["o"][k * HIDDEN:(k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            dw, dh, dc = np.zeros_like(self.w["h" + d]), 0, 0
            for t, h, c, i, f, o, g, th in reversed(ways[d][1]):
                m = mask[:, t:t + 1]
                dh = dh + above[:, t]
                own_h, own_c = m * dh, m * dc
                own_c = own_c + own_h * o * (1 - th * th)
                dz = np.concatenate([own_c * g * i * (1 - i), own_c * c * f * (1 - f), own_h * th * o * (1 - o), own_c * i * (1 - g * g)], axis=1)
                dz_all[:, t] = dz
                dw += h.T @ dz
                dh = dz @ self.w["h" + d].T + (1 - m) * dh
                dc = own_c * f + (1 - m) * dc
            grads["h" + d], grads["x" + d], grads["c" + d] = dw, np.einsum("ntw,ntk->wk", x, dz_all, optimize=True), dz_all.sum(axis=(0, 1))
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, *(len(p) for p in pages))
    x, mask = np.zeros((len(pages), steps, WIDTH), dtype=np.float32), np.zeros((len(pages), steps), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, :len(p)], mask[i, :len(p)] = p, 1
    return x, mask


def batched(pages: list[list], batch: int, cells: int = CELLS) -> Iterator[list[int]]:
    """Numbers of pages of about equal length, at most `batch` of them and `cells` blocks with padding; a longer page comes alone."""
    held: list[int] = []
    for i in sorted(range(len(pages)), key=lambda i: len(pages[i])):
        if held and (len(held) == batch or (len(held) + 1) * len(pages[i]) > cells):
            yield held
            held = []
        if pages[i]:
            held.append(i)
    if held:
        yield held


#: Layouts of boilerplate that training strews into pages: path elements and whether the words are links.
STREWN = [(("aside",), 0), (("div", ".sidebar"), 1), (("div", ".cookie", ".notice"), 0), (("div", ".advert"), 0), (("form",), 0), (("form", "p"), 0), (("section", ".comments", "p"), 0),
          (("div", ".comment", "p"), 0), (("ul", ".menu", "li"), 1), (("header",), 1), (("header", "h1"), 0), (("div", ".related", "li"), 1), (("div", ".newsletter", "p"), 0), (("aside", "p"), 0),
          (("div", ".banner"), 0), (("footer", "p"), 0), (("nav", "li"), 1), (("div", ".share", "li"), 1), (("div", ".breadcrumb"), 1), (("ol", ".comments", "li", "p"), 0)]


def strewn(page: list, rng: np.random.Generator) -> tuple[list, list[int]]:
    """A page for training with its labels: some boilerplate of other layouts, main elements sometimes renamed."""
    labels = [markup_label(path) for path, _, _ in page]
    words = [w for _, text, _ in page for w in text.split()] or ["text"]
    swap = {"article": [("article",), ("main",), ("div", ".content"), ("main", "article"), ("div", ".entry"), ("section", ".post")][rng.integers(6)]} if rng.random() < 0.5 else {}
    out = [(tuple(y for x in path for y in swap.get(x, (x,))), text, linked) for path, text, linked in page]
    if rng.random() < 0.5:  # main text in other elements than paragraphs
        leaf = [("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("h2",), ("div",), ("section", "p"), ("dl", "dd")]
        out = [((*path[:-1], *leaf[rng.integers(len(leaf))]) if y and path[-1:] == ("p",) and rng.random() < 0.5 else path, text, linked) for (path, text, linked), y in zip(out, labels)]
    for _ in range(int(rng.integers(0, 7))):
        path, link = STREWN[rng.integers(len(STREWN))]
        text = " ".join(words[int(j)] for j in rng.integers(len(words), size=int(rng.integers(1, 30))))
        at = int(rng.integers(len(out) + 1))
        inside = out[at - 1][0][:-1] if at and rng.random() < 0.5 and len(out[at - 1][0]) > 1 else ("html", "body")
        out.insert(at, ((*inside, *path), text, len(text) * link))
        labels.insert(at, 0)
    return out, labels


def fit(pages: list[str], seed: int = 7) -> Labeller | None:
    """A labeller trained on pages; blocks of main text and others count as they come. None without a block.

    Pages of more than CELLS / BATCH blocks are learned from in parts of that length.
    """
    rng, net, most = np.random.default_rng(seed), Labeller(), CELLS // BATCH
    parsed = [p[i:i + most] for p in map(blocks, pages) for i in range(0, len(p), most)]
    if not parsed:
        return None
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    step = 0
    for _ in range(ROUNDS):
        order = rng.permutation(len(parsed))
        for i in range(0, len(order), BATCH):
            made = [strewn(parsed[j], rng) for j in order[i:i + BATCH]]
            x, mask = padded([vectors(p) for p, _ in made])
            y = np.zeros_like(mask)
            for j, (_, own) in enumerate(made):
                y[j, :len(own)] = own
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                net.w[k] = (net.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page: str = "html") -> dict[str, np.ndarray]:
    """Weights from the sample_pages different pages with the smallest hashes; one task fits on them.

    Copies of a page count once, null pages not at all; other columns are ignored. Empty without
    a page that has a block, as in an empty table.
    """
    sample = least_hashes(pages, page, sample_pages).select("text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = fit(sorted(p for frame in frames for p in frame["text"]))
        for name, w in net.w.items() if net else ():
            yield pd.DataFrame({"name": [name], "shape": [list(w.shape)], "w": [w.astype("<f4").tobytes()]})

    rows = sample.repartition(1).mapInPandas(run, "name string, shape array<int>, w binary").collect()
    return {r["name"]: np.frombuffer(r["w"], "<f4").reshape(r["shape"]) for r in rows}


def extract(pages: DataFrame, weights: dict[str, np.ndarray], key: str = "page_id", page: str = "html", batch: int = 32) -> DataFrame:
    """(key, text, n_chars) and the other columns of pages, without the page itself.

    text holds the blocks labelled main, in page order, joined by an empty line; it is empty for
    null and empty pages and pages without main text. Pages are read whole, long ones in slices
    with states carried over. Columns named text or n_chars are replaced. Rows repeat as in
    pages; no rows give no rows. A page with blocks needs weights: without them the job fails.
    """
    others = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    schema = pages.select(*[F.col(f"`{c}`") for c in others], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Labeller(weights) if weights else None
        for frame in frames:
            texts, held, size = [], [], 0

            def label(held: list) -> list[str]:
                found = [""] * len(held)
                for own in batched(held, batch):
                    if net is None:
                        raise ValueError("pages with blocks need trained weights")
                    if len(held[own[-1]]) > CELLS:
                        scored = [net.page_scores(held[own[0]])]
                    else:
                        scored = net.scores(*padded([vectors(held[j]) for j in own]))
                    for j, p in zip(own, scored):
                        found[j] = "\n\n".join(text for (_, text, _), score in zip(held[j], p) if score >= 0.5)
                return found

            for value in frame[page]:
                held.append(blocks(value))
                size += len(held[-1])
                if size > 2 * CELLS:
                    texts, held, size = texts + label(held), [], 0
            texts += label(held)
            yield frame[others].assign(text=texts, n_chars=[len(t) for t in texts])

    return map_texts(pages.select(*[F.col(f"`{c}`") for c in others], F.col(page)), run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")
