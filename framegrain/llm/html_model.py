"""The block classifier of operator 10: a logistic fit, and edges on its scale, over pages with known labels.

No table says which blocks of a page are its text, so pages are drawn whose blocks are: layouts with and without
article elements, wrappers with side words, boxes inside and beside the text, with words of random letters, so
that only structure, length, links and punctuation can be learned. The fit takes TRAIN_PAGES such pages, the
edges are those under which the minimum cut errs least on TUNE_PAGES others. Both are drawn from one seed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np

from framegrain.llm.common import SEED
from framegrain.llm.html_extract import FEATURES, blocks, costs, minimum_cut, smoothness

TRAIN_PAGES, TUNE_PAGES = 500, 160
#: Strength of the penalty on the weights (the bias is free).
RIDGE = 0.3
GRID = {"near": (0.0, 0.25, 0.5, 1.0, 2.0), "parent": (0.0, 0.5, 1.0), "decay": (0.3, 0.6)}
#: First characters of a drawn block that is content and of one that is not.
KEPT, LEFT = "", ""
#: Ways to hide an element. Where text is concerned they say little: much of it is shown later, or hidden from readers' aids only.
HIDDEN = (" hidden", ' aria-hidden="true"', ' style="display: none"')


class Model(NamedTuple):
    weights: np.ndarray
    edges: tuple[float, float, float]


class Pages:
    """Draws pages; every block of text starts with KEPT or LEFT."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.aside = np.random.default_rng(seed + 7)
        self.pool = ["".join(map(chr, self.rng.integers(97, 123, self.rng.integers(2, 10)))) for _ in range(500)]

    def one(self, *choices):
        return choices[self.rng.integers(len(choices))]

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def some(self, lo: int, hi: int, make) -> str:
        return "".join(make() for _ in range(self.rng.integers(lo, hi + 1)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.pool[i] for i in self.rng.integers(0, len(self.pool), self.rng.integers(lo, hi + 1)))

    def sentence(self) -> str:
        return self.words(1, 22).capitalize() + self.one(".", ".", ".", ".", "!", "?")

    def prose(self) -> str:
        n = int(min(12, self.rng.geometric(0.35)))
        text = " ".join(self.sentence() for _ in range(n))
        return text.replace(" ", f' <a href="/{self.words(1, 1)}">{self.words(1, 3)}</a> ', 1) if self.odds(0.15) else text

    def link(self, mark: str) -> str:
        return f'<a href="/{self.words(1, 1)}">{mark}{self.words(1, 6)}</a>'

    def attr(self, *names: str) -> str:
        return f' {self.one("class", "class", "id")}="{self.one(*names)}"'

    # Content.

    def text(self) -> str:
        kind, k = self.rng.random(), KEPT
        if kind < 0.68:
            return f"<p>{k}{self.prose()}" + self.one("</p>", "</p>", "</p>", "")
        if kind < 0.76:
            return f"<h{self.one(2, 3)}>{k}{self.words(1, 8)}</h2>"
        if kind < 0.84:
            return "<ul>" + self.some(2, 5, lambda: f"<li>{k}{self.one(self.words(1, 6), self.prose(), self.link(''))}</li>") + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{k}{self.prose()}</blockquote>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{k}{self.words(2, 12)}</figcaption></figure>"
        if kind < 0.95:
            return "<table>" + self.some(1, 3, lambda: f"<tr><td>{k}{self.words(1, 3)}</td><td>{k}{self.words(1, 3)}</td></tr>") + "</table>"
        return f"<div>{k}{self.one(self.words(1, 5), self.prose())}</div>"

    def story(self) -> str:
        title = f"<h1>{KEPT}{self.words(1, 12)}</h1>"
        if self.odds(0.3):
            title = f"<header>{title}{self.one('', f'<p>{KEPT}{self.words(2, 8)}</p>')}</header>"
        body = title if self.odds(0.9) else ""
        for _ in range(self.rng.integers(1, 5)):
            run = self.some(1, 4, self.text)
            if self.odds(0.15):  # a name with a side word that speaks of what the text is about
                run = f"<div{self.attr('entry-comments-guide', 'post-notice-board', 'about-search-engines', 'story-cookie-recipe', 'post-legal-news', 'the-social-part', 'text-reader-notes')}>{run}</div>"
            body += run + (self.box(inside=True) if self.odds(0.3) else "")
        return body

    # What is not content.

    def names(self) -> tuple[str, ...]:
        return self.one(
            ("ad", "advert", "ad-banner", "ad_slot", "sponsored", "promo-box", "banner-top"), ("share", "social-share", "share-buttons", "post-share"), ("newsletter", "subscribe-box", "signup", "newsletter-form"),
            ("cookie-notice", "cookies", "gdpr", "consent-banner", "site-notice", "popup"), ("widget", "sidebar-widget", "sidebar", "right-sidebar", "widget-area"), ("tags", "breadcrumbs", "pager", "pagination", "post-navigation", "menu-main"),
            ("related", "related-posts", "recommended", "post-related", "related-list"), ("copyright", "legal", "disclaimer", "site-footer", "footer-inner"),
        )

    def filling(self) -> str:
        k = LEFT
        return self.one(
            f"<p>{k}{self.prose()}</p>", f"{k}{self.prose()}", f"<h3>{k}{self.words(1, 4)}</h3>" + self.some(1, 3, lambda: f"<p>{k}{self.prose()}</p>"), "<ul>" + self.some(2, 6, lambda: f"<li>{self.link(k)}</li>") + "</ul>",
            f"<h4>{k}{self.words(1, 4)}</h4><ul>" + self.some(2, 5, lambda: f"<li>{self.link(k)}</li>") + "</ul>", self.link(k), f"<div>{k}{self.words(1, 5)}</div><p>{self.link(k)}</p>",
        )

    def box(self, inside: bool = False) -> str:
        kind = self.rng.random()
        if kind < 0.55:
            return f"<{self.one('div', 'div', 'section', 'ul')}{self.attr(*self.names())}>{self.filling()}</div></section></ul>"
        if kind < 0.75:
            return f"<aside>{self.filling()}</aside>"
        if kind < 0.88:
            return f"<form action=x>{self.one('', f'<label>{LEFT}{self.words(1, 3)}</label>')}<p>{LEFT}{self.words(2, 14)}</p><input><button>{LEFT}{self.words(1, 2)}</button></form>"
        return self.comments() if not inside else f"<nav>{self.filling()}</nav>"

    def comments(self) -> str:
        one = lambda: self.one(
            f"<li><article class=comment><p>{LEFT}{self.prose()}</p></article></li>", f"<div class=comment-body><h4>{LEFT}{self.words(1, 2)}</h4><p>{LEFT}{self.prose()}</p></div>", f"<p>{LEFT}{self.prose()}</p>"
        )
        return f"<section{self.attr('comments', 'comments-area', 'reader-comments', 'disqus', 'post-comments', 'replies')}><h3>{LEFT}{self.words(1, 3)}</h3><ol>{self.some(1, 5, one)}</ol></section>"

    def top(self) -> str:
        nav = f"<nav><ul>{self.some(2, 8, lambda: f'<li>{self.link(LEFT)}</li>')}</ul></nav>"
        bare = "<div><ul>" + self.some(4, 8, lambda: f"<li>{self.link(LEFT)}</li>") + "</ul></div>"
        return self.one(nav, nav, f"<header>{self.link(LEFT)}<p>{LEFT}{self.words(1, 8)}</p></header>{nav}", f"<header><h2>{LEFT}{self.words(1, 3)}</h2>{nav}</header>", f"<div{self.attr('menu', 'main-menu', 'navbar', 'site-nav')}>{self.filling()}</div>", bare, "")

    def bottom(self) -> str:
        sign = f"{LEFT}© {self.words(2, 14)}{self.one('', '.')}"
        return self.one(f"<footer>{sign}</footer>", f"<footer>{sign}</footer>", f"<footer>{self.filling()}<p>{sign}</p></footer>", f"<div{self.attr('footer', 'site-footer', 'copyright')}>{sign}</div>", f"<p>{sign}</p>", "")

    def page(self) -> str:
        """A page of which a few blocks, of the text or not, are marked as hidden."""
        mark = lambda m: m[0] if self.aside.random() >= (0.04 if m[2] == KEPT else 0.06) else f"<{m[1]}{HIDDEN[self.aside.integers(len(HIDDEN))]}>{m[2]}"
        return re.sub(f"<([a-z0-9]+)>([{KEPT}{LEFT}])", mark, self.plain_page())

    def plain_page(self) -> str:
        if self.odds(0.06):
            return self.one(f"{KEPT}{self.prose()}", f"<p>{KEPT}{self.prose()}", f"<div>{KEPT}{self.words(3, 30)}</div>", f"<body>{self.top()}{self.bottom()}</body>")
        story = self.one(
            "<article>%s</article>", "<article>%s</article>", "<main>%s</main>", "<main><article>%s</article></main>", '<article class="post comments-open">%s</article>', f"<div{self.attr('content', 'post-body', 'entry', 'main-text', 'story')}>%s</div>",
            "<div>%s</div>", "<section>%s</section>", "<div><div>%s</div></div>", "%s",
        ) % self.story()
        before, after = self.some(0, 2, self.box), self.some(0, 3, self.box)
        if self.odds(0.3):
            story = f"<div{self.attr('page with-sidebar', 'wrapper', 'page-search-results', 'layout social', 'site')}>{story}</div>"
        body = f"{self.top()}{before}{story}{after}{self.bottom()}"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body{self.one('', '', self.attr('single-post right-sidebar', 'home has-menu', 'post-template'))}>{body}</body></html>"


def drawn(pages: int, seed: int) -> list[tuple[list, np.ndarray]]:
    """(blocks, whether each is content) of drawn pages."""
    source, out = Pages(seed), []
    for _ in range(pages):
        found = blocks(source.page())
        if found:
            out.append((found, np.array([b.text.lstrip().startswith(KEPT) for b in found])))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    penalty[FEATURES.index("bias")] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def errors(pages, weights: np.ndarray, edges: list[tuple]) -> list[int]:
    """Blocks that the minimum cut labels wrongly, under each choice of edges."""
    priced = [(found, costs(found, weights), y) for found, y in pages]
    return [sum(int((np.array(minimum_cut(cost, smoothness(found, *e))) != y).sum()) for found, cost, y in priced) for e in edges]


@lru_cache(maxsize=1)
def fitted(seed: int = SEED) -> Model:
    train, tune = drawn(TRAIN_PAGES, seed), drawn(TUNE_PAGES, seed + 1)
    weights = _logistic(np.array([b.features for found, _ in train for b in found]), np.concatenate([y for _, y in train]).astype(float))
    edges = list(product(*GRID.values()))
    return Model(weights, min(zip(errors(tune, weights, edges), edges, strict=True))[1])
