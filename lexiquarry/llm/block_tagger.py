"""A bidirectional LSTM in numpy that labels the blocks of a page, and the pages that it is trained on.

The training pages are made here: random words in templates that vary in containers, class names, nesting and in which
kinds of boilerplate they have where. Nothing is learned from the pages that are extracted.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .html_blocks import FEATURES, blocks, features

HIDDEN = 24


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Layer:
    """One direction of the LSTM."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.wx = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs) * 0.5).astype(np.float32)
        self.wh = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden) * 0.5).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States (time, page, hidden) for inputs in order of time."""
        steps, n, _ = x.shape
        size = self.wh.shape[0]
        xw = x @ self.wx + self.b
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out, saved = np.zeros((steps, n, size), np.float32), []
        for t in range(steps):
            z = xw[t] + h @ self.wh
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * o * tc + (1 - m) * h
            out[t] = h
        return out, saved

    def back(self, x: np.ndarray, saved: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of wx, wh and b."""
        size = self.wh.shape[0]
        dwx, dwh, db = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.b)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(saved) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = saved[t]
            dh = dh + d_out[t]
            dm = dh * m
            dnew = dc * m + dm * o * (1 - tc * tc)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dm * tc * o * (1 - o), dnew * i * (1 - g * g)], 1)
            dwx += x[t].T @ dz
            dwh += h.T @ dz
            db += dz.sum(0)
            dh = dz @ self.wh.T + dh * (1 - m)
            dc = dnew * f + dc * (1 - m)
            assert dh.shape[1] == size
        return [dwx, dwh, db]


class Tagger:
    """Scores blocks by the states of both directions."""

    def __init__(self, inputs: int = FEATURES, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.forward, self.backward = Layer(rng, inputs, hidden), Layer(rng, inputs, hidden)
        self.v = (rng.standard_normal((2 * hidden, 1)) * 0.1).astype(np.float32)
        self.v0 = np.zeros(1, np.float32)

    def _weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Both directions' weights side by side, gates at half their size, so that one tanh serves all."""
        size = self.forward.wh.shape[0]
        half = np.concatenate([np.full(3 * size, 0.5, np.float32), np.ones(size, np.float32)])
        wx, wh, b = (np.stack([getattr(layer, c) * half for layer in (self.forward, self.backward)]) for c in ("wx", "wh", "b"))
        return wx, wh, b, size

    @staticmethod
    def _steps(xw: np.ndarray, wh: np.ndarray, size: int, state: tuple[np.ndarray, np.ndarray], mask: np.ndarray | None = None):
        """States (time, direction, page, hidden) of both directions at once, each in its order of time; and the last state."""
        h, c = state
        out = np.empty((*xw.shape[:3], size), np.float32)
        for t in range(len(xw)):
            z = np.tanh(xw[t] + h @ wh)
            gates = z[..., : 3 * size] * 0.5 + 0.5
            new = gates[..., size : 2 * size] * c + gates[..., :size] * z[..., 3 * size :]
            new_h = gates[..., 2 * size :] * np.tanh(new)
            if mask is None:
                h, c = new_h, new
            else:
                m = mask[t]
                h, c = h + m * (new_h - h), c + m * (new - c)
            out[t] = h
        return out, (h, c)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        wx, wh, b, size = self._weights()
        n = x.shape[1]
        xw = np.stack([x @ wx[0] + b[0], x[::-1] @ wx[1] + b[1]], 1)
        both = None if mask.all() else np.stack([mask, mask[::-1]], 1)[..., None]
        start = np.zeros((2, n, size), np.float32)
        out, _ = self._steps(xw, wh, size, (start, start), both)
        return _sigmoid(np.concatenate([out[:, 0], out[::-1, 1]], 2) @ self.v + self.v0)[:, :, 0]

    def long_scores(self, vectors: Callable[[int, int], np.ndarray], n: int, together: int = 4096) -> np.ndarray:
        """Scores of one page of n blocks, whose vectors are made for ``together`` blocks at a time."""
        wx, wh, b, size = self._weights()
        ahead, back = np.empty((n, size), np.float32), np.empty((n, size), np.float32)
        state = (np.zeros((2, 1, size), np.float32),) * 2
        for lo in range(0, n, together):
            hi = min(n, lo + together)
            xw = np.stack([vectors(lo, hi) @ wx[0] + b[0], vectors(n - hi, n - lo)[::-1] @ wx[1] + b[1]], 1)[:, :, None]
            out, state = self._steps(xw, wh, size, state)
            ahead[lo:hi], back[n - hi : n - lo] = out[:, 0, 0], out[::-1, 1, 0]
        return _sigmoid(ahead @ self.v[:size] + back @ self.v[size:] + self.v0)[:, 0]

    def parameters(self) -> list[np.ndarray]:
        return [p for layer in (self.forward, self.backward) for p in (layer.wx, layer.wh, layer.b)] + [self.v, self.v0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of the blocks and its gradients."""
        a, sa = self.forward.run(x, mask, True)
        b, sb = self.backward.run(x[::-1], mask[::-1], True)
        h = np.concatenate([a, b[::-1]], 2)
        p = _sigmoid(h @ self.v + self.v0)[:, :, 0]
        n = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
        d = ((p - y) * mask / n)[:, :, None].astype(np.float32)
        dh = d @ self.v.T
        size = a.shape[2]
        return float(loss), [*self.forward.back(x, sa, dh[:, :, :size]), *self.backward.back(x[::-1], sb, dh[::-1, :, size:]), (h.reshape(-1, 2 * size).T @ d.reshape(-1, 1)), d.sum((0, 1))]

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 16, rate: float = 0.01, seed: int = 3) -> list[float]:
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        losses, step = [], 0
        for epoch in range(epochs):
            slow = 1 - epoch / epochs
            order, total = rng.permutation(len(pages)), 0.0
            for at in range(0, len(order), batch):
                x, mask, y = padded([pages[i] for i in order[at : at + batch]])
                loss, grads = self.gradients(x, mask, y)
                total += loss
                step += 1
                for p, g, mm, vv in zip(self.parameters(), grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    p -= rate * slow * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)
            losses.append(total / max(1, -(-len(order) // batch)))
        return losses


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, mask, labels), time first."""
    steps = max(len(x) for x, _ in pages)
    out = np.zeros((steps, len(pages), FEATURES), np.float32)
    mask, y = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, (x, labels) in enumerate(pages):
        out[: len(x), k], mask[: len(x), k], y[: len(x), k] = x, 1, labels
    return out, mask, y


# --- training pages --------------------------------------------------------------------------------------------

#: Containers of articles and of each kind of boilerplate, as (tag, class names to draw from).
ARTICLES = [
    ("article", ["", "post", "entry", "story", "article", "hentry post"]),
    ("main", ["", "content", "main", "site-main"]),
    ("div", ["content", "article", "article-body", "post-content", "entry-content", "story", "main-content", "text", "body", "document", "prose", "markdown-body", "story-body", "rich-text", "page-content", "bodywrapper", "col-main", "post"]),
    ("section", ["article", "content", "story", ""]),
]
KINDS = {
    "menu": [("nav", ["", "menu", "navbar", "main-nav", "main-navigation"]), ("div", ["menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "topbar", "nav-list", "portlet"]), ("ul", ["menu", "nav", "nav-list"]), ("td", ["menu", "nav"])],
    "header": [("header", ["", "site-header", "masthead", "header-wrap"]), ("div", ["header", "masthead", "banner", "logo", "site-branding", "header-wrap"])],
    "footer": [("footer", ["", "site-footer"]), ("div", ["footer", "copyright", "legal", "site-info"]), ("address", ["footer", ""])],
    "sidebar": [("aside", ["", "sidebar", "related", "widget-area"]), ("div", ["sidebar", "related", "widget", "recommended", "trending", "most-read", "sphinxsidebar", "see-also", "panel"]), ("section", ["widget", "related", "recommended", "more-stories"])],
    "notice": [("div", ["cookie", "cookie-notice", "notice", "consent", "gdpr", "popup", "newsletter", "subscribe", "alert", "paywall", "cookie-banner", "modal", "signup-box"]), ("section", ["notice", "newsletter"]), ("aside", ["newsletter", "newsletter-box"])],
    "advert": [("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "ad-container", "top-banner ad"]), ("aside", ["ad", "promo"])],
    "form": [("form", ["", "search", "login", "signup", "comment-form"])],
    "comments": [("div", ["comments", "comment", "comment-list", "replies", "discussion", "disqus", "comments-area"]), ("section", ["comments", "responses", "reader-comments"]), ("ol", ["comment-list", "comments"]), ("ul", ["comments"])],
    "share": [("div", ["share", "social", "tags", "author-box", "pagination", "share-buttons", "post-navigation"]), ("nav", ["navigation post-navigation", "pagination"])],
    "contents": [("div", ["toc", "table-of-contents", "contents"]), ("nav", ["toc", "contents"])],
}
ROLES = {"menu": "navigation", "footer": "contentinfo", "header": "banner", "sidebar": "complementary", "form": "search", "contents": "navigation"}
#: Names that say nothing of what an element holds.
NEUTRAL = ["wrap", "wrapper", "container", "row", "col", "inner", "outer", "block", "grid", "layout", "site", "page", "section", "module", "component", "clearfix", "fluid", "box", "root", "card", "left", "right", "center", "full", "width", "default", "type", "template", "theme", "light", "item"]
PHRASES = {
    "menu": ["Home", "News", "Sport", "About", "Contact", "Log in", "Skip to content", "Menu", "Navigation", "Main page"],
    "header": ["Welcome", "Daily news", "Search"],
    "footer": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "©", "© example.org", "© 2019", "Powered by", "This page was last edited"],
    "sidebar": ["Related articles", "Most read", "Read more", "Trending", "Recent posts", "You may also like", "See also"],
    "notice": ["We use cookies to improve your experience", "Accept all", "Subscribe to our newsletter", "Your privacy", "Sign up", "Accept", "Settings"],
    "advert": ["Advertisement", "Sponsored", "Buy now"],
    "form": ["Your name", "Email", "Send", "Search", "Leave a reply", "Post comment", "Go"],
    "comments": ["Comments", "Reply", "says:", "Great post!", "3 comments", "Thanks!"],
    "share": ["Share on", "Tweet", "Tags:", "Next page", "Written by", "Previous:", "Next:", "Share"],
    "contents": ["Contents", "Table of contents", "1 Introduction", "2 History", "On this page"],
}


class Maker:
    """Makes a page at a time; main text is marked by a character that texts don't have."""

    MARK = "\x01"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        letters = self.r.choice(["etaoinshrdlu", "eaéèçrntsiou", "enisratdhuöß", "aeosrnidlcñó", "etaoinshrdlucmfwypvbgk", "ETAOINSHRDLU"])
        junk = self.r.random() < 0.1
        out = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) + (self.r.choice(["###", "%%%", "***", "!!", " |", "$$$"]) if junk else "") for _ in range(self.r.randint(low, high))]
        return (" ".join(out).capitalize() + self.r.choice([".", ".", ".", "", "?"])).strip()

    def neutral(self) -> str:
        """A few names without a meaning."""
        r = self.r
        return " ".join(r.choice([r.choice(NEUTRAL), r.choice(NEUTRAL) + "-" + r.choice(NEUTRAL), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7)))]) for _ in range(r.randint(1, 3)))

    def open(self, choices: list, role: str = "") -> tuple[str, str]:
        r = self.r
        tag, names = r.choice(choices)
        name = r.choice(names)
        if r.random() < 0.3:
            name = f"{name} {self.neutral()}" if r.random() < 0.5 else f"{self.neutral()} {name}"
        kind = r.choice(["class", "class", "id"])
        extra = f' role="{role}"' if role and r.random() < 0.25 else ""
        return (f'<{tag} {kind}="{name}"{extra}>' if name else f"<{tag}{extra}>"), f"</{tag}>"

    def wrapped(self, inside: str, p: float = 0.3) -> str:
        """Perhaps in some containers that mean nothing."""
        while self.r.random() < p:
            tag = self.r.choice(["div", "div", "section"])
            inside = f'<{tag} class="{self.neutral()}">{inside}</{tag}>' if self.r.random() < 0.8 else f"<{tag}>{inside}</{tag}>"
        return inside

    def main(self) -> str:
        m, r = self.MARK, self.r
        title = self.words(3, 10) if r.random() < 0.8 else self.words(1, 3)
        out = [f"<h1>{m}{title}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.25:
            out = [f'<header class="{r.choice(["entry-header", "article-header", "post-header", "header", ""])}">{out[0]}</header>']
        if r.random() < 0.4:
            out.append(r.choice([f"<p><b>{m}{title}<br>", f"<p><b>{m}{title}</b></p>", f"<p><strong>{m}{title}</strong></p>"]))
        plain = r.random() < 0.1
        for _ in range(r.choice([1, 2, 3, 4, 6, 8, 12])):
            k = r.random()
            long = (1, 3) if k < 0.2 else (3, 20) if k < 0.45 else (10, 90) if k < 0.95 else (100, 400)
            text = m + self.words(*long)
            if r.random() < 0.1:
                text += f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 9)}'
            k = r.random()
            if plain:
                out.append(f"<p>{text}")
            elif k < 0.74:
                out.append(f"<p>{text}</p>" if r.random() < 0.9 else f"<p><b>{text}<br>")
            elif k < 0.82:
                out.append(f"<h{r.randint(2, 4)}>{m}{self.words(1, 7)}</h{r.randint(2, 4)}>")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{m}{self.words(2, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif k < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif k < 0.93:
                out.append("<dl>" + "".join(f"<dt>{m}{self.words(1, 3)}</dt><dd>{m}{self.words(2, 20)}</dd>" for _ in range(r.randint(1, 3))) + "</dl>")
            elif k < 0.95:
                out.append(f"<pre>{text}</pre>")
            elif k < 0.975:
                out.append(f"<figure><img><figcaption>{m}{self.words(2, 9)}</figcaption></figure>")
            else:
                out.append(f"<table><tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 4)}</td></tr></table>")
        cut = r.randint(0, len(out))
        if not plain and r.random() < 0.15:
            out[cut:] = [self.wrapped("".join(out[cut:]), 0.7)]
        if r.random() < 0.15:
            out.insert(r.randint(0, min(3, len(out))), self.boilerplate("contents"))
        return "".join(out)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        start, end = self.open(KINDS[kind], ROLES.get(kind, ""))
        item = lambda: r.choice(PHRASES[kind]) if r.random() < 0.4 else self.words(1, 3) if kind in ("menu", "share", "contents") else self.words(1, 40)
        n = r.randint(1, 8)
        form = r.random()
        if kind in ("menu", "sidebar", "footer", "share", "contents") and form < 0.65:
            body = "<ul>" + "".join(f'<li><a href="/{k}">{item()}</a></li>' for k in range(n)) + "</ul>" if r.random() < 0.8 else "<br>".join(f'<a href="/{k}">{item()}</a>' for k in range(n))
        elif kind == "comments":
            body = "".join(f"<{t}>{item()}</{t}>" if r.random() < 0.5 else f'<{r.choice(["div", "article"])} class="{r.choice(["comment", "reply", "body", "comment-body"])}"><p>{item()}</p></div>' for t in (r.choice(["p", "div", "li"]) for _ in range(n)))
        elif kind == "form":
            body = f"<label>{item()}</label><input><button>{item()}</button>"
        elif form < 0.5:
            body = item()
        else:
            body = "".join(f"<p>{item()}</p>" if r.random() < 0.8 else f"<button>{item()}</button>" for _ in range(min(n, 3)))
        if kind == "sidebar" and r.random() < 0.2:
            body = "".join(f'<a href="/{k}"><h3>{item()}</h3></a>' for k in range(n))
        if r.random() < 0.25:
            body = f"<h{r.randint(2, 4)}>{r.choice(PHRASES[kind])}</h3>" + body
        return start + self.wrapped(body, 0.15) + end

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.boilerplate(k) for k in kinds if r.random() < p)
        start, end = self.open(ARTICLES, "main") if r.random() < 0.9 else ("", "")
        inside = self.main()
        if r.random() < 0.3:
            cut = inside.find("<p>", len(inside) // 2)
            if cut > 0 and not inside[:cut].rstrip().endswith("<br>"):
                inside = inside[:cut] + some(["advert", "notice", "sidebar"], 0.4) + inside[cut:]
        inside += some(["share", "comments", "form"], 0.15)
        inside = start + self.wrapped(inside) + end
        after = some(["share", "comments", "sidebar", "form"], 0.3)
        if r.random() < 0.3:
            inside, after = self.wrapped(some(["header", "menu"], 0.2) + inside + after, 0.6), ""
            if r.random() < 0.4:
                inside = f"<main>{inside}</main>"
        before = some(["notice"], 0.2) + some(["header", "menu"], 0.6) + some(["advert"], 0.5) + some(["sidebar", "form"], 0.15)
        after += some(["advert", "notice"], 0.2) + some(["sidebar"], 0.2) + some(["footer"], 0.8)
        names = self.neutral() if r.random() < 0.3 else ""
        if r.random() < 0.15:
            names += " " + r.choice([r.choice(n) for kind in KINDS.values() for _, n in kind] + ["single-post", "has-sidebar", "home"])
        body = f'<body class="{names.strip()}">' if names else "<body>"
        return f"<html><head><title>{self.words(2, 6)}</title></head>{body}{self.wrapped(before + self.wrapped(inside, 0.25) + after)}</body></html>"

    def example(self) -> tuple[np.ndarray, np.ndarray]:
        found = blocks(self.page())
        y = np.array([self.MARK in b.text for b in found], np.float32)
        for b in found:
            b.text = b.text.replace(self.MARK, "")
        return features(found), y


@lru_cache(2)
def trained(pages: int = 2600, epochs: int = 8, seed: int = 1) -> Tagger:
    """A tagger fitted to pages made from ``seed``; the same one on every call."""
    maker = Maker(seed)
    tagger = Tagger()
    tagger.fit([maker.example() for _ in range(pages)], epochs)
    return tagger
