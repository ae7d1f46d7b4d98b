"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text under one innermost block element, in page order. Each
block has features of its ancestors (tags, and groups of words in their class, id and role) and of its text.
The field has the labels main text and other; it is trained by gradient ascent on the penalised
likelihood of labelled pages and decoded by Viterbi. The labelled pages are drawn by ``labelled_pages``:
layouts with semantic tags or only with classes, menus, headers, footers, sidebars, notices, adverts, forms
and reader comments around an article. The field has some tens of weights and goes with the task.

Text inside a block has character references decoded and white space (breaks included) turned into one
space; blocks are joined by two newlines. Scripts, styles, templates, titles and form controls are no text at
all; formulas, drawings' labels and fallback text are text like any other.

Edge cases: null, empty and textless pages give an empty text; unclosed and stray tags follow the usual implied
ends; markup without tags is one block; a page is read whole, in time in proportion to its length, whatever the
markup (from the first tag with an unclosed quote on, quotes in tags count for nothing); equal rows each give a row;
further columns are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import map_batches

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template title textarea select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the value is ended by a start tag of the key.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_CLOSERS = BLOCKS - {"label", "legend", "caption", "summary"}

#: What an element ends stays within the innermost of these.
_WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: What ends a tag, or opens an attribute's quoted value.
_STOP = re.compile(r">|=\s*([\"'])")
_END = {t: re.compile(rf"</{t}(?![a-zA-Z0-9:-])", re.I) for t in SILENT}
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Groups of words in class, id and role.
WORDS = {
    "advert": "ad ads adv advert adverts advertisement advertorial sponsor sponsored promo promotion banner dfp adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay toast announcement paywall subscribe subscription newsletter dialog",
    "side": "sidebar side aside rail related recommended recommendations more trending popular widget widgets complementary teaser",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses feedback",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs skip links masthead topbar header banner",
    "foot": "footer foot copyright legal colophon contentinfo bottom disclaimer",
    "form": "form login signin signup register search searchbox contact input field",
    "share": "share sharing social follow tags tag meta byline author date timestamp tools toolbar",
    "content": "content article post entry story main text maincontent articlebody entrycontent postcontent page prose",
}
_GROUP = {w: g for g, words in WORDS.items() for w in words.split()}
_SPLIT = re.compile(r"[^a-z]+")
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "table", "figure", "blockquote", "section", "ul", "ol", "li", "p", "pre", "address", "label", "details", "dialog")
FEATURES = (
    "bias",
    *(f"in_{t}" for t in TAGS),
    *(f"word_{g}" for g in WORDS),
    "comment_inside_article",
    "heading",
    "first_heading",
    "bare",
    "short",
    "middle",
    "long",
    "very_long",
    "linked",
    "half_linked",
    "sentence",
    "no_lower",
    "copyright",
    "start",
    "end",
)
#: An invisible character that marks main text while pages are drawn; it is taken out before training.
MARK = chr(0x2063)
_AT = {f: i for i, f in enumerate(FEATURES)}


@functools.lru_cache(maxsize=4096)
def _groups(attributes: str) -> frozenset[str]:
    """The word groups in a tag's class, id and role."""
    out = set()
    for m in _NAMES.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()
        out |= {_GROUP[w] for w in _SPLIT.split(value) if w in _GROUP}
        joined = _SPLIT.sub("", value)
        if joined in _GROUP:
            out.add(_GROUP[joined])
    return frozenset(out)


class Block:
    """A run of text: the innermost block element, the tags and word groups of all its ancestors, characters in links."""

    __slots__ = ("text", "last", "tags", "words", "linked")

    def __init__(self, text: str, last: str, tags: frozenset[str], words: frozenset[str], linked: int):
        self.text, self.last, self.tags, self.words, self.linked = text, last, tags, words, linked


def _tokens(page: str):
    """Text as (None, text), tags as (name, attributes) with a slash before the name of an end tag."""
    at, text, n = 0, 0, len(page)
    last = page.rfind(">")
    strict = True
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            yield None, page[text:at]
            end = page.find("-->", at + 4)
            at = text = end + 3 if end >= 0 else n
            continue
        if at > last:
            break
        m = _NAME.match(page, at + 1)
        if not m:
            if page.startswith(("<!", "<?"), at):
                yield None, page[text:at]
                at = text = page.find(">", at) + 1
            else:
                at += 1
            continue
        end = m.end()
        while strict:
            stop = _STOP.search(page, end)
            if stop and not stop[1]:
                end = stop.start()
                break
            close = page.find(stop[1], stop.end()) if stop else -1
            if close < 0:
                strict = False  # a quote without its partner: this tag and the next ones end at the first >
                end = m.end()
            else:
                end = close + 1
        if not strict:
            end = page.find(">", end)
        yield None, page[text:at]
        name = m[0].lower()
        yield name, page[m.end() : end]
        at = text = end + 1
        if name in SILENT and page[end - 1] != "/":
            e = _END[name].search(page, at)
            if not e:
                text = n
                break
            close = page.find(">", e.end())
            at = text = close + 1 if close >= 0 else n
    yield None, page[text:]


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    none: frozenset[str] = frozenset()
    # open blocks: tag, and the tags and word groups from the outermost on; where each tag is open
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = [("", none, none)]
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    linked, in_link = 0, False

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, *stack[-1], linked))
            parts.clear()
        linked = 0

    def innermost(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close_from(k: int):
        while len(stack) > k:
            where[stack.pop()[0]].pop()

    for tag, raw in _tokens(page or ""):
        if tag is None:
            if raw:
                text = html.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if in_link:
                    linked += len(text.strip())
            continue
        closing = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag in SILENT or tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "hr":
            end_block()
        elif tag in BLOCKS:
            end_block()
            in_link = False
            if closing:
                k = innermost((tag,))
                if k and (tag != "p" or stack[-1][0] == "p"):
                    close_from(k)
                continue
            if stack[-1][0] == "p" and tag in _CLOSERS:
                close_from(len(stack) - 1)
            if tag in IMPLIED:
                k = innermost(IMPLIED[tag])
                if k > innermost(_WALLS[tag]):
                    close_from(k)
            if tag not in VOID and not raw.endswith("/"):
                _, tags, words = stack[-1]
                own = _groups(raw) if raw else none
                where.setdefault(tag, []).append(len(stack))
                stack.append((tag, tags if tag in tags else tags | {tag}, words if own <= words else words | own))
    end_block()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Feature matrix [block, feature] of zeros and ones."""
    x = np.zeros((len(blocks), len(FEATURES)))
    n, headed = len(blocks), False
    for k, b in enumerate(blocks):
        tags, size = b.tags, len(b.text)
        names = ["bias"]
        names += [f"in_{t}" for t in TAGS if t in tags]
        names += [f"word_{g}" for g in b.words]
        if "comment" in b.words and "article" in tags:
            names.append("comment_inside_article")
        if b.last in ("h1", "h2", "h3", "h4", "h5", "h6"):
            names.append("heading")
            if b.last == "h1" and not headed:
                names.append("first_heading")
                headed = True
        if not tags & {"p", "li", "td", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dd"}:
            names.append("bare")
        names.append("short" if size < 25 else "middle" if size < 80 else "long" if size < 250 else "very_long")
        if b.linked * 2 > size:
            names.append("linked")
        elif b.linked * 5 > size:
            names.append("half_linked")
        if b.text[-1] in ".!?…:;\"'”»)":
            names.append("sentence")
        if b.text.upper() == b.text:
            names.append("no_lower")
        if "©" in b.text or "copyright" in b.text.lower():
            names.append("copyright")
        if k < 2:
            names.append("start")
        if k >= n - 2:
            names.append("end")
        x[k, [_AT[f] for f in names]] = 1
    return x


class Field:
    """Weights [label, feature] and transitions [label, label]; label 1 is main text."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best labels by Viterbi; ties go to label 0."""
        score = (x @ self.weights.T).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = score[0]
        back = []
        for s0, s1 in score[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return np.array(out[::-1])


def train(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 160, rate: float = 0.3, penalty: float = 0.004) -> Field:
    """Gradient ascent (Adam) on the penalised log-likelihood of (features, labels)."""
    n, longest, d = len(pages), max(len(y) for _, y in pages), len(FEATURES)
    x, y, real = np.zeros((n, longest, d)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for k, (a, b) in enumerate(pages):
        x[k, : len(b)], y[k, : len(b)], real[k, : len(b)] = a, b, True
    gold = np.eye(2)[y] * real[..., None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    w, m = np.zeros((2, d)), np.zeros((2, 2))
    mean, square = np.zeros(2 * d + 4), np.zeros(2 * d + 4)
    for step in range(1, rounds + 1):
        s = x @ w.T
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = s[:, 0]
        for t in range(1, longest):
            a = alpha[:, t - 1, :, None] + m[None]
            new = np.logaddexp(a[:, 0], a[:, 1]) + s[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b = m[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :]
            new = np.logaddexp(b[..., 0], b[..., 1])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        pair = alpha[:, :-1, :, None] + m[None, None] + (s + beta)[:, 1:, None, :] - z[:, None, None, None]
        pair = np.exp(np.where(real[:, 1:, None, None], pair, -np.inf))
        gw = np.einsum("ntl,ntd->ld", gold - p, x) / n - penalty * w
        gm = (gold_moves - pair.sum(axis=(0, 1))) / n - penalty * m
        g = np.concatenate([gw.ravel(), gm.ravel()])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) / (1 + step / 80)
        w, m = w + move[: 2 * d].reshape(2, d), m + move[2 * d :].reshape(2, 2)
    return Field(w, m)


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """Random pages and the labels of their leaf blocks. Main text holds a mark that the labels come from."""
    rng = random.Random(seed)
    mark = MARK
    out = []

    def words(a, b):
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a, b):
        return words(a, b).capitalize() + rng.choice(["."] * 6 + ["!", "?", ""])

    def wrap(kind, names, body):
        if rng.random() < 0.4:
            return f"<{kind}>{body}</{kind}>" if kind != "div" else f'<div class="{rng.choice(names)}">{body}</div>'
        tag = rng.choice([kind, "div"])
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">{body}</{tag}>'

    def links(a, b):
        return "<ul>" + "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"

    def para(a=4, b=60, own=True):
        text = " ".join(sentence(2, 18) for _ in range(rng.randint(1, max(1, rng.randint(a, b) // 10))))
        if rng.random() < 0.15:
            text = f"<b>{text}" + rng.choice(["</b>", "<br>"])
        if rng.random() < 0.15:
            text += f' <a href="#">{words(1, 4)}</a>.'
        return f"<p>{mark if own else ''}{text}" + rng.choice(["</p>", "</p>", "\n"])

    def other(kind):
        if kind == "nav":
            return wrap("nav", ["nav", "menu", "navbar", "breadcrumbs", "pagination"], links(2, 8))
        if kind == "header":
            return wrap("header", ["header", "masthead", "top-bar"], f"<div>{words(1, 5)}</div>" + rng.choice(["", f"<h2>{words(1, 4)}</h2>", links(2, 5), f"<p>{sentence(3, 10)}</p>"]))
        if kind == "footer":
            return wrap("footer", ["footer", "site-footer", "copyright"], rng.choice([f"&copy; {words(1, 3)} &middot; {sentence(2, 9)}", f"<p>{sentence(3, 20)}</p>", links(2, 6), f"<div>{sentence(2, 9)}</div>"]))
        if kind == "aside":
            return wrap("aside", ["sidebar", "related", "widget", "trending"], rng.choice(["", f"<h3>{words(1, 4)}</h3>"]) + rng.choice([links(2, 6), para(4, 30, False), f"<p>{sentence(4, 20)}</p>" * 2]))
        if kind == "ad":
            body = rng.choice([sentence(3, 25), f"<p>{sentence(4, 25)}</p>", f'<a href="#">{sentence(2, 9)}</a>'])
            return f'<div class="{rng.choice(["ad", "ads", "advert", "ad-slot banner", "sponsored", "promo"])}">{body}</div>'
        if kind == "notice":
            body = f"<p>{' '.join(sentence(4, 15) for _ in range(rng.randint(1, 3)))}</p>" + rng.choice(["", "<button>OK</button>"])
            return f'<div {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "consent", "newsletter", "alert", "modal popup", "subscribe"])}">{body}</div>'
        if kind == "form":
            return f'<form>{rng.choice(["<label>" + words(1, 3) + "</label>", sentence(2, 8), "<p>" + sentence(2, 12) + "</p>"])}<input name="q"><button>{words(1, 2)}</button></form>'
        if kind == "comments":
            one = lambda: rng.choice(["<li>{}</li>", '<div class="comment">{}</div>', '<article class="comment">{}</article>']).format(f"<b>{words(1, 2)}</b>" + rng.choice([para(4, 40, False), f"<p>{sentence(3, 30)}</p>"]))
            return f'<{(t := rng.choice(["section", "div", "ol"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "responses"])}">' + rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 4))) + f"</{t}>"
        return f'<div class="{rng.choice(["share", "social", "tags", "byline"])}">{words(1, 6)}</div>'

    for _ in range(n):
        body = [f"<h{rng.choice('1112')}>{mark}{words(2, 9).capitalize()}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            r = rng.random()
            if r < 0.7:
                body.append(para())
            elif r < 0.77:
                body.append(f"<h{rng.choice('23')}>{mark}{words(1, 6)}</h2>")
            elif r < 0.83:
                body.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.86:
                body.append(f"<blockquote>{para(4, 30)}</blockquote>")
            elif r < 0.88:
                body.append(f"<table><tr><td>{mark}{words(1, 3)}</td><td>{mark}{words(1, 3)}</td></tr></table>")
            elif r < 0.9:
                body.append(f"<figure><figcaption>{mark}{sentence(2, 12)}</figcaption></figure>")
            elif r < 0.92:
                body.append(rng.choice([f"<pre>{mark}{words(2, 20)}</pre>", f"<dl><dt>{mark}{words(1, 3)}<dd>{mark}{sentence(2, 12)}</dl>"]))
            else:  # text of its own, or in a plain box
                text = mark + " ".join(sentence(2, 14) for _ in range(rng.randint(1, 4)))
                body.append(rng.choice([f"<div>{text}</div>", f"<section>{text}</section>", f"{text}<hr>", f"<div>{mark}{words(1, 4)}</div>"]))
        for kind in ("ad", "share", "aside", "comments", "notice", "form"):
            if rng.random() < 0.12:
                body.insert(rng.randint(1, len(body)) if kind != "comments" else len(body), other(kind))
        article = "\n".join(body)
        frame = rng.random()
        if frame < 0.45:
            article = f"<article>{article}</article>"
        elif frame < 0.65:
            article = f"<main>{article}</main>"
        elif frame < 0.8:
            article = f'<main><article class="post">{article}</article></main>'
        elif frame < 0.95:
            article = f'<div class="{rng.choice(["content", "article-body", "entry-content", "post", "story"])}">{article}</div>'
        before = [other(k) for k in ("header", "nav", "ad", "notice", "aside", "form") if rng.random() < 0.4]
        after = [other(k) for k in ("comments", "aside", "ad", "form", "nav", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        page = f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{article}{''.join(after)}</body></html>"
        out.append((page, [int(mark in b.text) for b in leaf_blocks(page)]))
    return out


@functools.lru_cache(maxsize=1)
def trained(n: int = 400) -> Field:
    """The field trained on ``n`` labelled pages."""
    pages = []
    for page, labels in labelled_pages(n):
        blocks = leaf_blocks(page.replace(MARK, ""))
        if len(blocks) == len(labels) and blocks:
            pages.append((features(blocks), np.array(labels)))
    return train(pages)


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    return "\n\n".join([b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y])


def extracted(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    field = field or trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(p, field) for p in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return map_batches(pages.select("page_id", "url", "html"), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint", make)
