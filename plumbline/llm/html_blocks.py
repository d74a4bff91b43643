"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its text blocks. Each block is a vector: the tags, classes, ids and roles of its path
hashed into PATH_DIM entries, its words hashed into WORD_DIM, and a few measures. A bidirectional LSTM in numpy reads the
whole sequence and labels every block as article or not, so a block is judged in the context of the document.

The labeller is trained on the driver on a bounded sample: SAMPLE_PAGES pages with the smallest page_id hashes, the same
with furniture of other kinds put in, and invented pages. The labels of pages with a named article come from a teacher who
looks at a single block's path (article-like containers against menus, notices, adverts, forms, comments and so on); a sample
page in which the teacher finds no article teaches nothing. Invented pages whose article stands in a container of any name,
in none, or below furniture words of wrappers, with furniture that no name gives away and in scripts without spaces too, are
labelled by where the text was placed.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship
from plumbline.llm.textnum import U, words

SAMPLE_PAGES = 150
TRAIN_BLOCKS = 80  # of a training page; pages to be labelled are read whole
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 192, 16, 6, 24
EPOCHS, BATCH, RATE, SEED = 8, 25, 0.02, 5

# Fixed values of HTML: elements without an end tag, without text of their own, and those that stay inside a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "title", "svg", "iframe", "object", "textarea", "select", "canvas"}
RAW = {"script", "style"}  # run to the end of the page if they are not closed; of the others only the tag is dropped then
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    # formulas, whose text stays in the line
    "math", "semantics", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded",
    "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none",
}
#: A start tag of the key ends an open element of the values, if no element of the third kind lies between.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# What the teacher goes by.
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
FURNITURE_WORDS = (
    "nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement banner promo sponsored sponsor cookie cookies "
    "consent gdpr notice alert popup modal overlay newsletter subscribe signup login share social comment comments disqus reply replies respond "
    "related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright legal skip search form teaser tags"
).split()
ARTICLE_TAGS = {"article", "main"}
ARTICLE_WORDS = "article content main post entry story body text".split()
_TELLING = {*FURNITURE_WORDS, *ARTICLE_WORDS}  # any other name says nothing and would share entries with these

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?/][^>]*>",
    re.S,
)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
#: Scripts that put no spaces between words: Thai to Khmer, and all from the East Asian ones on.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """A path element's features: its tag, and the telling words in its class, id, role and itemprop."""
    if tag in ("html", "body"):  # theirs describe the whole page, not a block
        return (f"<{tag}>",)
    named = [w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _SPLIT.split(m[2] or m[3] or m[4] or "") if w]
    return (f"<{tag}>", *[w for w in named if w in _TELLING])


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...], int]]:
    """A page's text blocks in order: text, the features of its path, and the characters inside links."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[tuple[str, tuple[str, ...], int]] = []
    pieces: list[str] = []
    path: tuple[str, ...] | None = None
    linked = links = 0

    def end_block() -> None:
        nonlocal path, linked
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip(" ")
            if text:
                out.append((text, path or (), linked))
            pieces.clear()
        path, linked = None, 0

    def text_piece(raw: str) -> None:
        nonlocal path, linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if path is None and _SPACE.sub("", text):
            path = tuple(m for _, marks in stack for m in marks)
        if links:
            linked += len(text)

    at, absent = 0, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text_piece(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in SILENT and not m[1]:
            if tag == "title":  # the other silent elements stand within a line
                end_block()
            if m[3].endswith("/") and tag == "svg":
                continue
            end = None if tag in absent else _END[tag].search(page, at)
            if end:
                at = end.end()
            else:
                absent.add(tag)
                at = len(page) if tag in RAW else at
            continue
        if tag in SILENT:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag not in INLINE:
                closes, stops = IMPLIED.get(tag, ({"p"}, {"div", "article", "section", "main", "td", "li", "body", "aside", "blockquote"}))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        del stack[k:]
                        break
                    if stack[k][0] in stops:
                        break
            if tag not in VOID and not m[3].endswith("/"):
                stack.append((tag, _marks(tag, m[3])))
        if tag == "a":
            links = sum(t == "a" for t, _ in stack)
        elif links:
            links = sum(t == "a" for t, _ in stack)
    if at < len(page):
        text_piece(page[at:])
    end_block()
    return out


@lru_cache(maxsize=65536)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for mark in path:
        for seed in range(3):  # a name seldom shares more than one of its entries with a name of furniture
            h = xxhash.xxh64_intdigest(mark, seed)
            v[h % PATH_DIM] += 1.0 if h >> 63 else -1.0
    return np.clip(v, -2, 2)


def vectors(blocks: list[tuple[str, tuple[str, ...], int]]) -> np.ndarray:
    """One row per block."""
    raw = [b[0].encode("utf-8", "surrogatepass") for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    hashes, at = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    block = np.repeat(np.arange(len(blocks)), np.diff(at))
    sign = np.where(hashes >> U(63), 1.0, -1.0)
    bag = np.bincount(block * WORD_DIM + (hashes % U(WORD_DIM)).astype(np.int64), weights=sign, minlength=len(blocks) * WORD_DIM)
    unspaced = np.array([len(_UNSPACED.findall(b[0])) if not b[0].isascii() else 0 for b in blocks])
    counts = np.maximum(np.diff(at) + unspaced / 2, 1)  # about two characters make a word there
    bag = np.clip(bag.reshape(len(blocks), WORD_DIM) / np.sqrt(counts)[:, None] * 0.3, -1, 1)
    size = np.array([len(b[0]) for b in blocks], float)
    share = np.array([b[2] for b in blocks]) / np.maximum(size, 1)
    place = np.arange(len(blocks)) / max(len(blocks) - 1, 1)
    measures = np.stack([np.log1p(size) / 5, np.log1p(counts) / 4, np.minimum(share, 1), place, 1 - place, np.ones(len(blocks))], 1)
    return np.concatenate([np.stack([_path_vector(b[1]) for b in blocks]), bag, measures], 1).astype(np.float32)


def teacher(path: tuple[str, ...]) -> bool:
    """Is a block with this path part of the article?"""
    outer = max((i for i, m in enumerate(path) if m == "<main>"), default=0)  # a page has one main part: what is around it says nothing
    path = path[outer:]
    own: set[int] = set()  # the names of <article> and <main> themselves
    for i, m in enumerate(path):
        if m[0] != "<" and (i - 1 in own or path[i - 1] in ("<article>", "<main>")):
            own.add(i)
    tags = {m[1:-1] for m in path if m[0] == "<"}
    named = {m for i, m in enumerate(path) if m[0] != "<" and i not in own}
    if tags & FURNITURE_TAGS or named & set(FURNITURE_WORDS):
        return False
    return bool(tags & ARTICLE_TAGS or named & set(ARTICLE_WORDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


Weights = dict[str, np.ndarray]


def _direction(x: np.ndarray, mask: np.ndarray, w: Weights, d: str, keep: bool = False):
    """Hidden states of one direction over pages x blocks x features; padded steps pass the state on."""
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, saved = np.empty((n, steps, HIDDEN), np.float32), []
    fed = x @ w[f"x{d}"] + w[f"b{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = fed[:, t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        live = mask[:, t, None]
        c_new = f * c + i * g
        squashed = np.tanh(c_new)
        if keep:
            saved.append((t, h, c, i, f, o, g, squashed, live))
        c = np.where(live, c_new, c)
        h = np.where(live, o * squashed, h)
        out[:, t] = h
    return out, saved


def _direction_back(grad: np.ndarray, x: np.ndarray, saved: list, w: Weights, d: str, into: Weights) -> None:
    n = x.shape[0]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t, h, c, i, f, o, g, squashed, live in reversed(saved):
        dh = dh + grad[:, t]
        own, pass_h, pass_c = dh * live, dh * ~live, dc * ~live
        dcn = dc * live + own * o * (1 - squashed**2)
        z = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), own * squashed * o * (1 - o), dcn * i * (1 - g**2)], 1)
        into[f"x{d}"] += x[:, t].T @ z
        into[f"h{d}"] += h.T @ z
        into[f"b{d}"] += z.sum(0)
        dh, dc = z @ w[f"h{d}"].T + pass_h, dcn * f + pass_c


def _logits(x: np.ndarray, mask: np.ndarray, w: Weights) -> np.ndarray:
    forward, backward = _direction(x, mask, w, "f")[0], _direction(x, mask, w, "r")[0]
    return np.concatenate([forward, backward], 2) @ w["out"] + w["bias"]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in parts)
    x = np.zeros((len(parts), steps, parts[0].shape[1]), np.float32)
    mask = np.zeros((len(parts), steps), bool)
    for k, p in enumerate(parts):
        x[k, : len(p)], mask[k, : len(p)] = p, True
    return x, mask


def train(pages: list[str]) -> Weights:
    """Weights of the labeller, fitted to the teacher's labels by Adam; the same for the same pages."""
    draw = random.Random(SEED)
    real = pages[:SAMPLE_PAGES]
    sources = real + [_furnished(p, draw) for p in real] + [_furnished(_invented(draw), draw) for _ in range(SAMPLE_PAGES * 4)]
    data = []
    for page in sources:
        blocks = blocks_of(page)[:TRAIN_BLOCKS]
        marks = [teacher(b[1]) for b in blocks]
        if any(marks):
            data.append((vectors(blocks), np.array(marks, np.float32)))
    for _ in range(SAMPLE_PAGES * 8):
        placed = blocks_of(_placed(draw))[:TRAIN_BLOCKS]
        data.append((vectors([(t.replace(_HERE, ""), *rest) for t, *rest in placed]), np.array([_HERE in b[0] for b in placed], np.float32)))
    rng, size = np.random.default_rng(SEED), PATH_DIM + WORD_DIM + MEASURES
    w: Weights = {}
    for d in "fr":
        w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN)).astype(np.float32)
        w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w[f"b{d}"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    w["out"], w["bias"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 8)
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        for b in rng.permutation(len(batches)):
            x, mask = _padded([data[k][0] for k in batches[b]])
            y, _ = _padded([data[k][1][:, None] for k in batches[b]])
            forward, kept_f = _direction(x, mask, w, "f", True)
            backward, kept_r = _direction(x, mask, w, "r", True)
            both = np.concatenate([forward, backward], 2)
            off = ((_sigmoid(both @ w["out"] + w["bias"]) - y[..., 0]) * mask / mask.sum()).astype(np.float32)
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"], grad["bias"] = np.einsum("nth,nt->h", both, off), off.sum(keepdims=True)[0]
            back = off[..., None] * w["out"]
            _direction_back(back[..., :HIDDEN], x, kept_f, w, "f", grad)
            _direction_back(back[..., HIDDEN:], x, kept_r, w, "r", grad)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def label(pages: list[list[tuple[str, tuple[str, ...], int]]], w: Weights) -> list[np.ndarray]:
    """For every page, which of its blocks belong to the article. Pages of like lengths are run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * len(pages[order[b]]) <= 8192 and len(pages[order[b]]) <= 2 * len(pages[order[a]]) + 8:
            b += 1
        x, mask = _padded([vectors(pages[k]) for k in order[a:b]])
        good = _logits(x, mask, w) > 0
        for row, k in enumerate(order[a:b]):
            out[k] = good[row, : len(pages[k])]
        a = b
    return out


_SYLLABLES = "an be co de en for ge ha in ka lo mi no or pa que ra si te un ver wa".split()
#: First and last letters of scripts that invented pages are written in, and what stands between their words.
_SCRIPTS = [(0x4E00, 0x9F00, ""), (0x3041, 0x3096, ""), (0x0E01, 0x0E2E, ""), (0xAC00, 0xD7A0, " "), (0x0430, 0x044F, " "), (0x05D0, 0x05EA, " "), (0x0627, 0x064A, " "), (0x0905, 0x0939, " ")]


def _words(draw: random.Random, least: int, most: int) -> str:
    n = draw.randint(least, most)
    script = getattr(draw, "script", None)
    if script:
        first, last, space = script
        return space.join("".join(chr(draw.randint(first, last)) for _ in range(draw.randint(2, 5) if space else 2)) for _ in range(n))
    return " ".join("".join(draw.choices(_SYLLABLES, k=draw.randint(1, 3))) for _ in range(n))


def _wrapped(draw: random.Random, text: str) -> str:
    return draw.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li><a href='#'>{}</a></li></ul>", "<span>{}</span>", "<h3>{}</h3>", "<p><b>{}</b></p>"]).format(text)


def _furniture(draw: random.Random) -> str:
    """One piece of page furniture."""
    inner = "".join(_wrapped(draw, _words(draw, 1, draw.choice([4, 12, 60]))) for _ in range(draw.randint(1, 4)))
    if draw.random() < 0.35:
        tag = draw.choice(sorted(FURNITURE_TAGS))
        return f"<{tag}>{inner}</{tag}>"
    name = draw.choice(FURNITURE_WORDS)
    name = draw.choice(["{}", "{}", "site-{}", "{}-box", "page_{}"]).format(name)
    tag, attribute = draw.choice(["div", "div", "section", "p", "ul", "aside"]), draw.choice(["class", "class", "id"])
    return f'<{tag} {attribute}="{name}">{inner}</{tag}>'


def _unnamed(draw: random.Random, kind: int | None = None) -> str:
    """Furniture that no name gives away: menus in any container or table, boxes of short lines, a lone line."""
    tag, attribute = draw.choice(["div", "div", "section", "span", "p", "td"]), draw.choice(["id", "class"])
    opened = draw.choice([f"<{tag}>", f"<{tag} {attribute}='{_name(draw)}'>"])
    items = [_words(draw, 1, 2) for _ in range(draw.randint(3, 8))]
    linked = [f"<a href='/{k}'>{t}</a>" for k, t in enumerate(items)]
    kind = draw.randrange(6) if kind is None else kind
    if kind == 0:
        return opened + draw.choice([" | ", " \u00b7 ", " / ", " - "]).join(draw.choice([items, linked])) + f"</{tag}>"
    if kind == 1:
        return "<table><tr>" + "".join(f"<td>{t}</td>" for t in linked) + "</tr></table>"
    if kind == 2:
        lines = "".join(f"<li>{draw.choice(['{}', '<a href=x>{}</a>', '<a href=x>{}</a>']).format(_words(draw, 2, 7))}</li>" for _ in items)
        return f"{opened}<{draw.choice(['h3', 'h4', 'b', 'p'])}>{_words(draw, 1, 3)}</h3><ul>{lines}</ul></{tag}>"
    if kind == 3:
        return opened + "".join(f"<p><a href=x>{_words(draw, 2, 8)}</a></p>" for _ in items) + f"</{tag}>"
    if kind == 4:
        return f"{opened}{draw.choice(['&copy; 2024 ', '\u00a9 ', 'Copyright ', ''])}{_words(draw, 1, 6)}</{tag}>"
    return opened + "".join(f"<div>{_words(draw, 1, 3)}</div>" for _ in items) + f"</{tag}>"


def _furnished(page: str, draw: random.Random) -> str:
    """A page with furniture before, in and behind its article, and now and then another container for it."""
    if draw.random() < 0.4:
        name = draw.choice(ARTICLE_WORDS)
        opened, closed = draw.choice([("<main>", "</main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), (f'<section class="post-{name}">', "</section>")])
        page = page.replace("<article>", opened, 1).replace("</article>", closed, 1)
    spots = [m.end() for m in re.finditer(r"</p>|</h1>|<body>|</article>|</nav>|</main>", page)]
    for spot in sorted(draw.sample(spots, min(len(spots), draw.randint(1, 4))), reverse=True):
        page = page[:spot] + _furniture(draw) + page[spot:]
    return page


def _invented(draw: random.Random) -> str:
    """A page of invented words with an article in it."""
    parts = [f"<h1>{_words(draw, 2, 9)}</h1>"]
    for _ in range(draw.randint(1, 8)):
        kind = draw.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<p><b>{}<br>", "<table><tr><td>{}</td></tr></table>"])
        parts.append(kind.format(_words(draw, 1, draw.choice([6, 30, 90]))))
    menu = "".join(f'<li><a href="/{_words(draw, 1, 1)}">{_words(draw, 1, 2)}</a></li>' for _ in range(draw.randint(2, 7)))
    return f"<html><head><title>{_words(draw, 2, 5)}</title></head><body><nav><ul>{menu}</ul></nav><article>{''.join(parts)}</article><footer>{_words(draw, 2, 20)}</footer></body></html>"


_HERE = "\ue000"  # stands in the article's texts of a placed page until it is labelled


def _name(draw: random.Random) -> str:
    name = draw.choice([_words(draw, 1, 1), "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 8)))])
    return draw.choice(["{}", "{}", f"{{}}{draw.randint(1, 99)}", f"{{}}-{_words(draw, 1, 1)}", "site-{}", "{}-box", "page_{}", "page{}"]).format(name)


def _placed(draw: random.Random) -> str:
    """An invented page whose article is known by its place: in a container of any name or in none, below wrappers whose
    names may be those of furniture, with furniture around and in it or without, of any name as well; in several scripts."""
    draw.script = draw.choice(_SCRIPTS) if draw.random() < 0.3 else None
    parts = [f"<h1>{_HERE}{_words(draw, 2, 9)}</h1>"] if draw.random() < 0.7 else []
    for _ in range(draw.choice([1, 2, 3, 5, 8])):
        kind = draw.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>"])
        parts.append(kind.format(_HERE + _words(draw, 1, draw.choice([6, 30, 90, 90, 2000 if draw.random() < 0.1 else 90]))))
    if draw.random() < 0.7:  # articles seldom end in a word or two
        parts.append(draw.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(_HERE + _words(draw, 15, 90)))
    if draw.random() < 0.3:
        parts.insert(draw.randint(0, len(parts)), _furniture(draw))
    furniture = draw.choice(FURNITURE_WORDS)
    wrapped = draw.choice([f"has-{furniture}", f"{furniture}-{_words(draw, 1, 1)}", f"with {furniture}"])
    tag, attribute = draw.choice(["div", "div", "section", "td"]), draw.choice(["id", "class"])
    opened, closed = draw.choice([
        ("", ""), ("", ""), (f"<{tag} {attribute}='{_name(draw)}'>", f"</{tag}>"), (f"<{tag} {attribute}='{_name(draw)}'>", f"</{tag}>"), ("<div>", "</div>"),
        (f"<article class='{_name(draw)} {wrapped}'>", "</article>"), (f"<main id='{wrapped}'>", "</main>"), ("<article>", "</article>"),
    ])
    if draw.random() < 0.15:
        parts.insert(draw.randint(0, len(parts)), _unnamed(draw))
    some = draw.choice([_furniture, _unnamed, lambda d: d.choice([_furniture, _unnamed])(d)])
    around = [some(draw) for _ in range(draw.choice([0, 1, 2, 4]))]
    menu = "".join(f'<li><a href="/x">{_words(draw, 1, 2)}</a></li>' for _ in range(draw.randint(2, 7)))
    if around and draw.random() < 0.6:
        around.insert(0, f"<nav><ul>{menu}</ul></nav>")
        around.append(f"<footer>{_words(draw, 2, 20)}</footer>")
    spot = draw.randint(0, len(around))
    if draw.random() < 0.3:
        around.append(_unnamed(draw, draw.choice([0, 4, 4])))
    page = "".join([*around[:spot], opened, *parts, closed, *around[spot:]])
    draw.script = None
    if opened and draw.random() < 0.4:  # a wrapper of everything; in it the article has a container of its own
        page = f"<div class='{draw.choice([_name(draw), wrapped])}'>{page}</div>"
    return draw.choice(["{}", "<html><body>{}</body></html>", "<html><body>{}</body></html>"]).format(page)


def _extract(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Weights = weights.value
        for batch in batches:
            pages = batch.column("html").to_pylist()
            first = 0
            while first < len(pages):  # a few MB of pages at a time
                end, held = first, 0
                while end < len(pages) and (end == first or held + len(pages[end] or "") <= 1 << 21):
                    held += len(pages[end] or "")
                    end += 1
                read = [blocks_of(p or "") for p in pages[first:end]]
                texts = ["\n\n".join(b[0] for b, good in zip(blocks, marks, strict=True) if good) for blocks, marks in zip(read, label(read, w), strict=True)]
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )
                first = end

    return run


def _sample(source: DataFrame) -> list[str]:
    """Up to SAMPLE_PAGES pages, those with the smallest page_id hashes. Ids alone are compared; only the chosen pages come
    to the driver, cut at 200,000 characters each, which bounds the sample."""
    mark = F.xxhash64("page_id")
    ids = source.filter("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").distinct().orderBy(mark, "page_id").limit(SAMPLE_PAGES).collect()
    chosen = source.filter(F.col("page_id").isin([r.page_id for r in ids])).select("page_id", F.substring("html", 1, 200_000).alias("html"))
    rows = chosen.groupBy("page_id").agg(F.min("html").alias("html")).collect() if ids else []
    return [r.html for r in sorted(rows, key=lambda r: r.page_id) if r.html is not None]


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks of the article joined by two line feeds; empty if none), n_chars.

    A null or empty html has no blocks. A page without an article-like container has what the labeller makes of it;
    it is taught on such pages.
    Null ids and urls come back as they are, repeated rows as often as they come; other columns are not read.
    """
    ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = pages.sparkSession.sparkContext.broadcast(train(_sample(source)))
    return source.mapInArrow(_extract(weights), "page_id bigint, url string, text string, n_chars bigint")
