"""Main text of web pages: boosted trees over DOM blocks, then a decoding in which descendants agree with ancestors."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import bounded
from .boosting import Forest, boost
from .dom import Page, read
from .session import prepare

#: Words in class, id and role names that speak for and against main text.
GOOD = frozenset("article body content entry main post story text blog page prose markdown column hentry".split())
BAD = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget rail related recommended "
    "recommend more comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup form login search share sharing social toolbar "
    "pagination pager tags meta copyright legal disclaimer skip hidden complementary contentinfo dialog".split()
)
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "form", "blockquote", "pre", "table", "td", "figure", "body", "dl")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NAME_SLOTS = 12
TRAINING_PAGES = 700


def slot(name: str) -> int:
    value = 0
    for c in name.encode():
        value = (value * 131 + c) & 0xFFFFFFFF
    return value * 2654435761 % (1 << 32) * NAME_SLOTS >> 32


def features(page: Page) -> np.ndarray:
    """A row a block: tag, attribute tokens of it and its ancestors, subtree density, depth, and how its siblings are."""
    blocks = page.blocks
    n = len(blocks)
    own = np.array([sum(len(page.runs[t]) for t in b.texts) for b in blocks], float)
    total, links, paragraphs, nodes, commas, forms = own.copy(), np.array([float(b.links) for b in blocks]), np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    for i, b in enumerate(blocks):
        paragraphs[i] = b.tag == "p"
        forms[i] = b.tag in ("form", "fieldset")
        commas[i] = sum(page.runs[t].count(",") + page.runs[t].count(".") for t in b.texts)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = blocks[i].parent
        children[p].append(i)
        for x in (total, links, paragraphs, nodes, commas, forms):
            x[p] += x[i]
    width = len(TAGS) + 1 + 24 + NAME_SLOTS
    out = np.zeros((n, width))
    above = np.zeros((n, 4))  # good and bad names, semantic boilerplate and main elements at or above
    whole = max(total[0], 1)
    # among its siblings: a block's place, how many bear its tag, and the two largest texts
    place, alike, largest, second = np.zeros(n, np.int64), np.ones(n), np.zeros(n), np.zeros(n)
    for family in children:
        family.reverse()
        same = Counter(blocks[j].tag for j in family)
        top = sorted((total[j] for j in family), reverse=True)[:2]
        for at, j in enumerate(family):
            place[j], alike[j] = at, same[blocks[j].tag]
            largest[j], second[j] = top[0], top[1] if len(top) > 1 else 0.0
    for i, b in enumerate(blocks):
        good, bad = sum(x in GOOD for x in b.names), sum(x in BAD for x in b.names)
        before = above[b.parent] if i else np.zeros(4)
        above[i] = before + (good, bad, b.tag in ("nav", "header", "footer", "aside", "form"), b.tag in ("article", "main"))
        row = out[i]
        if b.tag in TAGS:
            row[TAGS.index(b.tag)] = 1
        row[len(TAGS)] = b.tag in HEADINGS
        family = len(children[b.parent]) if i else 1
        rival = second[i] if total[i] == largest[i] else largest[i]
        row[len(TAGS) + 1 : len(TAGS) + 25] = (
            good, bad, before[0], before[1], before[2], before[3], b.depth, np.log1p(own[i]), np.log1p(total[i]), total[i] / whole, links[i] / max(total[i], 1),
            np.log1p(total[i] / nodes[i]), np.log1p(paragraphs[i]), np.log1p(nodes[i]), commas[i] / max(total[i], 1), forms[i], place[i] / max(family - 1, 1), np.log1p(family),
            alike[i] / family, rival / whole, links[b.parent if i else 0] / max(total[b.parent if i else 0], 1), total[i] / max(total[b.parent if i else 0], 1),
            len(b.names) > 0, b.marks / (1 + own[i] / 50),
        )
        for name in b.names:
            if name not in GOOD and name not in BAD:
                row[len(TAGS) + 25 + slot(name)] = 1
    return out


def decode(page: Page, probability: np.ndarray) -> np.ndarray:
    """Which blocks' own texts are main text, by the likeliest labelling that is consistent from ancestor to descendant.

    A block is *around* main text, *in* it, or *out* of it. Below what is out all is out; below what is in, blocks are
    in or out; below what is around, anything. Blocks vote with their log odds, weighted by the length of their text.
    """
    blocks = page.blocks
    n = len(blocks)
    odds = np.log(np.clip(probability, 1e-4, 1 - 1e-4) / np.clip(1 - probability, 1e-4, 1))
    size = np.array([sum(len(page.runs[t]) for t in b.texts) for b in blocks], float)
    vote = odds * (0.3 + np.log1p(size))
    score = np.zeros((n, 3))  # around, in, out, of the subtree
    score[:, 1], score[:, 0] = vote, -0.05
    score[:, 0] -= np.where(size > 0, 0.2, 0)
    pick = np.zeros((n, 3), np.int64)  # the state each takes for a parent around, in, out
    for i in range(n - 1, -1, -1):
        around, inside, out = score[i]
        change = 1.0  # what it costs to leave the parent's state
        pick[i] = int(np.argmax((around, inside - change, out - 0.1))), 1 + int(out - change > inside), 2
        if i:
            p = blocks[i].parent
            score[p, 0] += max(around, inside - change, out - 0.1)
            score[p, 1] += max(inside, out - change)
            score[p, 2] += out
    state = np.zeros(n, np.int64)
    state[0] = pick[0, 0]
    for i in range(1, n):
        state[i] = pick[i, state[blocks[i].parent]]
    return state == 1


def main_text(page: Page, forest: Forest, probability: np.ndarray | None = None) -> str:
    if not page.runs:
        return ""
    chosen = decode(page, forest.probability(features(page)) if probability is None else probability)
    return " ".join(run for run, block in zip(page.runs, page.owner) if chosen[block])


def training_page(r: random.Random) -> tuple[str, list[str]]:
    """A made-up page and its main text runs; site furniture and article alike come in many forms."""
    sounds = ["ka", "lo", "mi", "ren", "tas", "ul", "vor", "en", "shi", "do", "pe", "ar", "qui", "nes", "öl", "été"]
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(1, 4)))
    sentence = lambda lo=3, hi=18: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice(".....?!,")
    prose = lambda n: " ".join(sentence() for _ in range(n))
    name = lambda *xs: f' {r.choice(("class", "class", "id"))}="{r.choice(xs)}"' if xs and r.random() < 0.85 else ""
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return text

    def nav() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        return r.choice((f"<nav><ul>{items}</ul></nav>", f'<div class="{r.choice(("menu", "nav-bar", "navigation", "breadcrumbs"))}"><ul>{items}</ul></div>', f"<ul{name('menu', 'topnav')}>{items}</ul>", f"<nav>{' '.join(link() for _ in range(5))}</nav>"))

    def advert() -> str:
        return f'<div class="{r.choice(("ad", "ad-slot", "advert", "sponsored", "banner", "promo"))}">{r.choice((prose(1), prose(2), link(), f"<p>{prose(r.randint(1, 3))}</p>"))}</div>'

    def notice() -> str:
        return r.choice((f'<div class="{r.choice(("cookie-notice", "notice", "alert", "consent-banner", "gdpr"))}">{r.choice((prose(2), f"<p>{prose(2)}</p>"))}<button>ok</button></div>', f'<div role="{r.choice(("alert", "dialog"))}"><p>{prose(2)}</p></div>'))

    def form() -> str:
        return f"<form{name('newsletter', 'search', 'signup')}><label>{sentence(2, 5)}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>"

    def aside() -> str:
        inner = r.choice((f"<h3>{sentence(1, 4)}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(5))}</ul>", f"<h3>{sentence(1, 3)}</h3><p>{prose(r.randint(1, 4))}</p>", form(), f"<p>{prose(2)}</p>" * r.randint(1, 3)))
        return r.choice((f"<aside{name('sidebar', 'widget')}>{inner}</aside>", f'<div class="{r.choice(("sidebar", "related-posts", "widget", "right-rail", "recommended"))}">{inner}</div>'))

    def comments() -> str:
        one = lambda: r.choice((f'<div class="comment"><p>{prose(r.randint(1, 4))}</p></div>', f'<li class="comment"><b>{word()}</b><p>{prose(r.randint(1, 5))}</p></li>', f'<article class="comment"><header>{word()}</header><p>{prose(r.randint(1, 4))}</p></article>', f"<p>{word()}: {prose(2)}</p>"))
        inner = f"<h3>{sentence(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 8)))
        return f'<{(t := r.choice(("section", "div", "ol", "div")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "reader-comments", "discussion", "replies"))}">{inner}</{t}>'

    def foot() -> str:
        inner = r.choice((f"&copy; {word()}.example &middot; {prose(r.randint(1, 3))}", f"<p>{prose(r.randint(1, 3))}</p>", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul><p>&copy; {word()}</p>"))
        return r.choice((f"<footer>{inner}</footer>",) * 3 + (f'<div class="{r.choice(("footer", "site-footer", "copyright"))}">{inner}</div>',))

    def article() -> str:
        out = []
        title = sentence(2, 12)
        if r.random() < 0.85:
            head = f"<h1>{keep(title)}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        if r.random() < 0.15:
            out.append(r.choice((f'<div class="share">{link()} {link()}</div>', f'<ul class="social">{"".join(f"<li>{link()}</li>" for _ in range(3))}</ul>')))
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            text = keep(prose(r.choice((1, 1, 2, 4, 8))))
            if kind < 0.7:
                out.append(r.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br></p>", f"<p>{text} <a href=/x>{keep(word())}</a></p>")))
            elif kind < 0.78:
                out.append(f"<h2>{text}</h2>")
            elif kind < 0.84:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.9:
                out.append("<ul><li>" + text + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<table><tr><td>{text}</td><td>{keep(word())}</td></tr></table>")
            if r.random() < 0.06:
                out.append(r.choice((advert, aside, form, notice))())
        if not kept:
            out.append(f"<p>{keep(prose(2))}</p>")
        return "".join(out)

    inner = article()
    wrap = r.choice((("article", ""),) * 4 + (("main", ""), ("div", name("content", "post-content", "entry-content", "article-body", "story")), ("section", name("content", "article")), ("div", ' id="main"'), ("div", ' class="post"')))
    inner = f"<{wrap[0]}{wrap[1]}>{inner}" + ("" if r.random() < 0.03 else f"</{wrap[0]}>")
    after = "".join(f() for f in (advert, comments, aside, notice) if r.random() < 0.3)
    before = "".join(f() for f in (notice, aside, advert, form) if r.random() < 0.3)
    if r.random() < 0.3:
        inner = f"<{(t := r.choice(('div', 'main', 'section')))}{name('wrapper', 'container', 'page', 'content', 'row')}>{before}{inner}{after}</{t}>"
        before = after = ""
    top = r.choice(("", nav(), nav(), f"<header{name('header', 'site-header')}>{link()}<p>{sentence()}</p>{nav()}</header>", f"<header><h2>{sentence(1, 3)}</h2></header>{nav()}"))
    head = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    return head + top + before + inner + after + (foot() if r.random() < 0.9 else "") + ("</body></html>" if r.random() < 0.9 else ""), kept


def train(pages: int = TRAINING_PAGES, seed: int = 11) -> Forest:
    """Trees learned from ``pages`` made-up pages: no table holds labels for this, and the bound is this parameter."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        source, kept = training_page(r)
        page, marked = read(source), set()
        good = {" ".join(t.split()) for t in kept}
        inside = np.zeros(len(page.blocks), bool)
        mixed = np.zeros(len(page.blocks), bool)
        for run, block in zip(page.runs, page.owner):
            if run in good or any(run.startswith(g) for g in good if len(g) > 8):
                inside[block] = True
            else:
                marked.add(block)
        for block in range(len(page.blocks) - 1, 0, -1):
            parent = page.blocks[block].parent
            if inside[block] and not page.blocks[parent].texts:
                inside[parent] = True
            if block in marked or mixed[block]:
                mixed[parent] = True
        # a container counts as main text only from the innermost one around all of it
        for block in range(len(page.blocks)):
            if page.blocks[block].tag in ("html", "body") or mixed[block] and not page.blocks[block].texts and page.blocks[block].tag in ("div", "section", "main") and page.blocks[block].depth <= 2:
                inside[block] = False
        x.append(features(page))
        y.append(inside)
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


def extract(pages: DataFrame, forest: Forest | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; null and empty pages, and pages without main text, give ''.

    Character references are decoded, white space inside a block is made one space, blocks are joined in page order by
    one space. Row by row, without a shuffle; rows that repeat an id or have none each give a row; other columns are
    ignored; an empty table gives an empty result.
    """
    prepare(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(forest or train())
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html", 1 << 20):
            read_ = [read(source or "") for source in batch.column("html").to_pylist()]
            rows = [features(p) for p in read_]
            probability = np.split(shipped.value.probability(np.concatenate(rows)), np.cumsum([len(x) for x in rows])[:-1])
            texts = [main_text(p, shipped.value, q) for p, q in zip(read_, probability)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
