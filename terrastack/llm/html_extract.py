"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.gbt import Trees, fit
from terrastack.llm.html_tree import Node, parse

#: Words in class, id and role that hint at main text, or at something else. Fixed values.
GOOD = re.compile(r"article|content|entry|post|main|story|body|text|blog|page\b|hentry|prose")
BAD = re.compile(
    r"comment|discuss|disqus|respon|reply|reaction|feedback|side|widget|nav|menu|foot|head|banner|mast|crumb|share|social|tool|promo|advert|\bads?\b|\bad[-_]|[-_]ad\b|sponsor|cookie|consent|notice|alert|gdpr|popup|modal|overlay|subscri|newsletter|signup|login|search|related|recommend|more[-_]|trend|popular|tag[s-]|categor|copyright|legal|disclaim|pag(?:er|ination)|author|byline|meta\b|hidden|print|skip|rail|teaser|form"
)
TAGS = ["", "p", "div", "li", "ul", "ol", "article", "main", "section", "nav", "aside", "header", "footer", "form", "table", "td", "h1", "h2", "blockquote", "body", "button", "label", "pre", "figure"]
_TAG = {t: i for i, t in enumerate(TAGS)}
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_AWAY = frozenset("nav aside header footer form button label menu dialog search".split())


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: its subtree's text density and links, attribute words, depth, and how its siblings look."""
    n = len(nodes)
    parent = np.array([0 if x.parent is None else x.parent.index for x in nodes])
    base = np.array(
        [
            (len(x.text), x.linked, x.text.count(".") + x.text.count(",") if x.text else 0, x.text.count(" ") + 1 if x.text else 0, 1 if x.text else 0, x.inputs, 1 if x.tag == "p" else 0, 1 if x.tag == "li" else 0, x.marks, 1)
            for x in nodes
        ],
        np.float64,
    )
    total = base.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        total[parent[i]] += total[i]
    depth = np.zeros(n)
    own = np.array([(_TAG.get(x.tag, len(TAGS)), 2 * bool(GOOD.search(x.tokens)) if x.tokens else 0, len(BAD.findall(x.tokens)) if x.tokens else 0, x.tag in _HEADING, x.tag in _AWAY) for x in nodes], np.float64).reshape(n, 5)
    above = np.zeros((n, 4))  # hints of ancestors: good, bad, away, inside article or main
    place, brothers = np.zeros(n), np.zeros(n)
    for i, x in enumerate(nodes):
        k = len(x.children)
        for j, c in enumerate(x.children):
            place[c.index], brothers[c.index] = j, k
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p]
            above[i, 0] += own[p, 1]
            above[i, 1] += own[p, 2]
            above[i, 2] = max(above[i, 2], own[p, 4])
            above[i, 3] = max(above[i, 3], nodes[p].tag in ("article", "main"))
    length = np.maximum(total[:, 0], 1)
    words = np.maximum(total[:, 3], 1)
    up = total[parent]
    before, after = np.zeros(n), np.zeros(n)
    text_so_far = np.concatenate(([0], np.cumsum(base[:, 0])[:-1]))
    for x in nodes:
        for a, b in zip(x.children, x.children[1:]):
            before[b.index], after[a.index] = total[a.index, 0], total[b.index, 0]
    return np.column_stack(
        (
            np.log1p(total[:, 0]), total[:, 1] / length, total[:, 2] / words, np.log1p(total[:, 3]), total[:, 3] / np.maximum(total[:, 4], 1), total[:, 4], total[:, 5], total[:, 6], total[:, 7], total[:, 7] / total[:, 9], total[:, 8] / words,
            total[:, 0] / total[:, 9], own, above, depth, place, brothers, place / np.maximum(brothers, 1), total[:, 0] / np.maximum(up[:, 0], 1), total[:, 0] / max(total[0, 0], 1), text_so_far / max(total[0, 0], 1), np.log1p(before), np.log1p(after), own[parent, 0],
        )
    )


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Text blocks that are kept, as a mask over nodes.

    A node that is dropped drops all below it, and one that is kept has kept ancestors. Of these choices the one with
    the largest sum of log-odds wins: kept nodes count their odds, dropped ones the opposite. Bottom up, each subtree's
    best value is the better of dropping it whole and keeping its root with every child's best.
    """
    n = len(nodes)
    weight = np.array([np.log1p(len(x.text)) if x.text else 1.0 for x in nodes]) * odds
    drop, keep = -weight.copy(), weight.copy()
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent.index
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = np.zeros(n, bool)
    for i, x in enumerate(nodes):
        kept[i] = keep[i] > drop[i] if i == 0 else kept[x.parent.index] and keep[i] > drop[i]
    return kept & np.array([bool(x.text) for x in nodes])


def blocks_of(page: str, trees: Trees) -> list[str]:
    """Main text blocks of one page, in page order."""
    _, nodes = parse(page)
    if len(nodes) < 2:
        return []
    kept = decode(nodes, np.clip(trees.log_odds(features(nodes)), -6, 6))
    return [x.text for x in nodes if kept[x.index]]


# ---------------------------------------------------------------- labelled pages

_WORDS = "the of and in that it was for on with as by at from this are or an be which had not but have were one all their has been there more when who out about into some time could them other than then its over also after people made first where most these two may well such only new".split()


def _prose(rng: np.random.Generator, words: int) -> str:
    if words <= 0:
        return ""
    picked = [_WORDS[i] if rng.random() < 0.5 else "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 10))) for i in rng.integers(0, len(_WORDS), words)]
    out, start = [], True
    for w in picked:
        end = rng.random() < 0.1
        out.append((w.capitalize() if start else w) + ("." if end else "," if rng.random() < 0.06 else ""))
        start = end
    return " ".join(out).rstrip(",.") + "."


def labelled_page(rng: np.random.Generator) -> str:
    """A made-up page; main text carries the attribute ``data-main``, on the smallest element that holds all of it."""
    pick = lambda *x: x[rng.integers(len(x))]
    some = lambda p: rng.random() < p
    prose = lambda a, b: _prose(rng, int(rng.integers(a, b)))
    attr = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick(*names)} {pick("clearfix", "wrap", "box", "col-4")}"')
    link = lambda w: f'<a href="/{rng.integers(999)}">{_prose(rng, w)[:-1]}</a>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link(int(rng.integers(1, 3)))}</li>" for _ in range(n)) + "</ul>"

    def noise() -> str:
        kind = rng.integers(12)
        if kind == 0:
            return f"<nav{attr('menu', 'navbar', 'breadcrumbs', 'site-nav') if some(0.6) else ''}>{links(int(rng.integers(2, 10)))}</nav>"
        if kind == 1:
            return f"<div{attr('ad', 'advert', 'ads', 'ad-slot', 'sponsored', 'promo', 'banner-ad')}>{prose(3, 25)}</div>"
        if kind == 2:
            return f"<aside{attr('sidebar', 'widget', 'related', 'rail') if some(0.6) else ''}><h3>{prose(1, 4)}</h3>{pick(links(4), '<p>' + prose(5, 60) + '</p>')}</aside>"
        if kind == 3:
            return f"<div{attr('cookie-notice', 'cookie-consent', 'notice', 'alert', 'gdpr', 'popup')}><p>{prose(6, 40)}</p><button>{prose(1, 3)}</button></div>"
        if kind == 4:
            return f"<form{attr('newsletter', 'search', 'signup', 'login')}><label>{prose(1, 5)}</label><input type=\"text\"><button>{prose(1, 2)}</button><p>{prose(3, 15)}</p></form>"
        if kind in (5, 6):
            many = "".join(f"<{pick('div', 'li', 'article', 'section')}{attr('comment', 'comment-body', 'reply')}><p>{prose(4, 60)}</p>" + (f"<p>{prose(4, 30)}</p>" if some(0.3) else "") + "</div>" for _ in range(rng.integers(1, 7)))
            return f"<{pick('div', 'section')}{attr('comments', 'comment-list', 'discussion', 'responses', 'reader-comments')}><h2>{prose(1, 4)}</h2>{many}</div>"
        if kind == 7:
            return f"<div{attr('sidebar', 'side', 'widget-area')}><div><h4>{prose(1, 4)}</h4><p>{prose(5, 70)}</p></div>{links(3)}</div>"
        if kind == 8:
            return f"<div{attr('share', 'social', 'tags', 'related-posts', 'recommended')}>{pick(links(4), link(2) + ' ' + link(1) + ' ' + link(2))}</div>"
        if kind == 9:
            return f"<header{attr('masthead', 'site-header', 'top') if some(0.6) else ''}><h1>{prose(1, 5)}</h1><p>{prose(2, 12)}</p>{links(3) if some(0.5) else ''}</header>"
        if kind == 10:
            return f"<{pick('script', 'style')}>var t=1;</script></style>"
        return f"<footer{attr('footer', 'site-footer', 'colophon') if some(0.5) else ''}>{pick('&copy; ', '')}{prose(3, 30)}{' &middot; ' + prose(2, 12) if some(0.5) else ''}{links(3) if some(0.3) else ''}</footer>"

    def paragraph() -> str:
        text = prose(1, int(pick(12, 60, 160)))
        if some(0.25):
            text = f"<{pick('b', 'em', 'strong', 'i')}>{text}</{pick('b', 'em', 'x')}>" + prose(1, 40)
        if some(0.15):
            text += " " + link(2) + " " + prose(2, 30)
        if some(0.05):
            return "<ul>" + "".join(f"<li>{prose(3, 30)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        if some(0.05):
            return f"<blockquote><p>{text}</p></blockquote>"
        if some(0.08):
            return f"<h2>{prose(1, 7)}</h2><p>{text}</p>"
        return f"<p>{text}" + ("</p>" if some(0.85) else "<br>")

    body = (f"<h1>{prose(1, 12)}</h1>" if some(0.85) else "") + "".join(paragraph() for _ in range(rng.integers(1, int(pick(4, 12, 30)))))
    if some(0.12):
        body = f"<table><tr><td>{prose(1, 9)}</td><td>{prose(1, 9)}</td></tr></table>" + body
    box = pick("article", "article", "article", "main", "div", "div", "section")
    name = attr("article", "content", "post", "entry-content", "story", "main-content", "article-body", "post-body") if box != "article" or some(0.4) else ""
    main = f'<{box}{name} data-main="1">{body}</{box}>'
    inner = noise() if some(0.2) else ""
    if inner and some(0.5):
        main = main[: -len(f"</{box}>")] + inner + f"</{box}>"
    if some(0.35):
        main = f"<{pick('main', 'div', 'section')}{attr('main', 'container', 'page', 'wrapper') if some(0.7) else ''}>{main}{noise() if some(0.4) else ''}</div>"
    before = "".join(noise() for _ in range(rng.integers(0, 5)))
    after = "".join(noise() for _ in range(rng.integers(0, 5)))
    whole = before + main + after
    if some(0.3):
        whole = f"<div{attr('page', 'container', 'wrapper', 'site')}>{whole}</div>"
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{whole}</body></html>"


def labelled(pages: int = 500, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of made-up pages: 1 where a subtree holds main text, 0 elsewhere."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = labelled_page(rng)
        at = page.index(' data-main="1"')
        tag_start = page.rindex("<", 0, at)
        marked = page[:tag_start] + '<section class="zzmainzz">' + page[tag_start:].replace(' data-main="1"', "", 1)
        _, plain = parse(page.replace(' data-main="1"', "", 1))
        # the marked page has one node more, which tells where the main element stands
        _, extra = parse(marked)
        where = next(i for i, x in enumerate(extra) if "zzmainzz" in x.tokens)
        y = _holds(plain, where)
        xs.append(features(plain))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def _holds(nodes: list[Node], main: int) -> np.ndarray:
    """1 for text blocks below node ``main`` that no noise element encloses, and for all ancestors of such."""
    y = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.text:
            up, noise = x.parent, False
            while up is not None and up.index > main:
                noise |= up.tag in _AWAY or bool(up.tokens and BAD.search(up.tokens))
                up = up.parent
            if up is not None and up.index == main and not noise:
                y[i] = 1
        if y[i] and x.parent is not None:
            y[x.parent.index] = 1
    return y


@lru_cache
def train(pages: int = 500, seed: int = 11) -> Trees:
    """Fit on made-up pages labelled by construction: no page of the corpus is needed."""
    x, y = labelled(pages, seed)
    return fit(x, y, trees=40, depth=4, rate=0.25)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block is one space, blocks are joined by a line feed in page
    order. A null or empty page, or one without main text, has an empty text. Very long pages are read whole; of
    choices of equal odds the one that drops wins. Repeated rows are read alike; an empty table stays empty; other
    columns are ignored.
    """
    trees = trees or train()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                parsed = [parse(h)[1] if h else [] for h in part.column(2).to_pylist()]
                rows = [features(nodes) for nodes in parsed if len(nodes) > 1]
                odds = np.clip(trees.log_odds(np.concatenate(rows)), -6, 6) if rows else np.zeros(0)
                texts, at = [], 0
                for nodes in parsed:
                    if len(nodes) < 2:
                        texts.append("")
                        continue
                    kept = decode(nodes, odds[at : at + len(nodes)])
                    at += len(nodes)
                    texts.append("\n".join(x.text for x in nodes if kept[x.index]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(of, "page_id long, url string, text string, n_chars long")
