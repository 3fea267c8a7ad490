"""Train the block labeller on generated pages: ``python -m loomgraph.llm.train_blocks``.

Pages are made from random words in many layouts, with known main blocks, and the
network is fitted by back-propagation through time with Adam. Seeds are fixed.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np

from loomgraph.llm import blocks as bl

_SYLLABLES = "an be co da el fi go ha in jo ka la mi no on pa qui re sa ti un ve wo xi yo za ch th st er tion ment keit ción eau ß ñ é ü".split()
_SITE = "home about contact login register search menu news sport archive shop help privacy terms next previous share tweet print subscribe rss more top back".split()
_NOTICE = "cookies accept settings agree consent policy newsletter sign up email subscribe notice we use this site javascript".split()
_ADVERT = "advertisement sponsored buy now offer sale discount deal promoted free shipping".split()
_REMARK = "reply says comment like report posted ago thanks great agree".split()


class Pages:
    """Random pages as (html, list of main texts)."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, options):
        return options[self.r.integers(len(options))]

    def word(self) -> str:
        return "".join(self.one(_SYLLABLES) for _ in range(self.r.integers(1, 5)))

    def words(self, low: int, high: int, lexicon: list[str] | None = None) -> str:
        share = self.r.choice([0.0, 0.3, 0.9]) if lexicon else 0.0
        out = [self.one(lexicon) if lexicon and self.r.random() < share else self.word() for _ in range(self.r.integers(low, high))]
        style = self.r.integers(8)
        if style == 0:
            out = [w.upper() + "!!" for w in out]
        elif style == 1:
            out = [w + self.one(["***", "###", "&amp;&amp;", "%%%"]) for w in out]
        elif style == 2:
            out = [x for w in out for x in (w, "|")]
        elif style == 3:
            out = [out[0]] * len(out)
        else:
            out = [w + ("." if self.r.random() < 0.12 else "," if self.r.random() < 0.08 else "") for w in out]
            out[0] = out[0].capitalize()
            if self.r.random() < 0.8:
                out[-1] = out[-1].rstrip(".,") + "."
        return " ".join(out)

    def named(self, tag: str, names: list[str], own: bool = True) -> tuple[str, str]:
        """Opening and closing tag, mostly with a telling class or id."""
        name = self.one(names)
        if self.r.random() < 0.4:
            name += self.one(["-", "_", " "]) + self.word()
        attribute = self.one(["class", "class", "id"])
        if not own or self.r.random() < 0.9:
            return f'<{tag} {attribute}="{name}">', f"</{tag}>"
        return f"<{tag}>", f"</{tag}>"

    def menu(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3, _SITE)}</a>' for _ in range(self.r.integers(2, 9))]
        kind = self.r.integers(3)
        inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if kind < 2 else " ".join(items)
        a, b = ("<nav>", "</nav>") if self.r.random() < 0.6 else self.named(self.one(["div", "nav", "ul"]), ["nav", "menu", "navbar", "breadcrumb", "topnav", "navigation"], False)
        return a + inner + b

    def box(self, tags: list[str], names: list[str], lexicon: list[str], low: int, high: int, bare: list[str] = ()) -> str:
        if bare and self.r.random() < 0.4:
            tag = self.one(bare)
            a, b = f"<{tag}>", f"</{tag}>"
        else:
            a, b = self.named(self.one(tags), names, False)
        lines = []
        for _ in range(self.r.integers(1, 5)):
            text = self.words(low, high, lexicon)
            wrap = self.one(["p", "div", "span", "li", "h3", "h4", "a", ""])
            lines.append(f"<{wrap}>{text}</{wrap}>" if wrap else text)
        return a + ("".join(lines) if self.r.random() < 0.5 else lines[0]) + b

    def aside(self) -> str:
        return self.box(["div", "aside", "section"], ["sidebar", "side", "widget", "related", "recommended", "popular", "trending"], _SITE, 2, 20, ["aside"])

    def advert(self) -> str:
        return self.box(["div", "section", "aside"], ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"], _ADVERT, 2, 25)

    def notice(self) -> str:
        return self.box(["div", "section"], ["cookie", "cookie-notice", "notice", "consent", "popup", "modal", "newsletter", "alert", "gdpr"], _NOTICE, 3, 30, ["dialog", "noscript"])

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3, _NOTICE)}</label><input type=text>" for _ in range(self.r.integers(1, 4)))
        extra = f"<p>{self.words(3, 15, _NOTICE)}</p>" if self.r.random() < 0.5 else ""
        pick = f"<select><option>{self.word()}<option>{self.word()}</select><textarea>{self.words(1, 6)}</textarea>" if self.r.random() < 0.3 else ""
        return f"<form>{extra}{fields}{pick}<button>{self.words(1, 3, _NOTICE)}</button></form>"

    def remarks(self) -> str:
        a, b = self.named(self.one(["section", "div", "ol"]), ["comments", "comment-list", "responses", "discussion", "reader-comments"], False)
        head = f"<h3>{self.words(1, 4, _REMARK)}</h3>" if self.r.random() < 0.6 else ""
        each = ""
        for _ in range(self.r.integers(1, 6)):
            x, y = self.named(self.one(["div", "li", "article"]), ["comment", "reply", "response", "user-comment"], False)
            each += f"{x}<b>{self.word()}</b> <p>{self.words(3, 50, _REMARK)}</p>{y}"
        return a + head + each + b

    def footer(self) -> str:
        text = self.one([f"&copy; {self.word()}.com &middot; {self.words(2, 20)}", self.words(3, 20, _SITE), f"<p>{self.words(3, 15)}</p><p>Copyright {self.words(2, 8, _SITE)}</p>"])
        a, b = ("<footer>", "</footer>") if self.r.random() < 0.7 else self.named("div", ["footer", "bottom", "site-footer", "copyright"], False)
        return a + text + b

    def header(self) -> str:
        a, b = ("<header>", "</header>") if self.r.random() < 0.6 else self.named("div", ["header", "masthead", "top", "logo", "site-header"], False)
        return a + self.one([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 4)}</a>', f"<p>{self.words(1, 8)}</p>"]) + (self.menu() if self.r.random() < 0.3 else "") + b

    def article(self) -> tuple[str, list[str]]:
        main: list[str] = []

        def said(text: str) -> str:
            main.append(text)
            return text

        a, b = self.one([("<article>", "</article>")] * 3 + [("<main>", "</main>"), self.named("div", ["content", "article", "post", "entry", "article-body", "story", "main", "post-content", "text"], False), ("<main><article>", "</article></main>"), self.named("article", ["post", "entry", "story"], False), self.named("section", ["content", "article", "story"], False)])
        body = f"<h1>{said(self.words(1, 12))}</h1>" if self.r.random() < 0.8 else ""
        for _ in range(self.r.integers(1, 14)):
            text = self.words(*self.one([(1, 4), (3, 30), (20, 120)]))
            kind = self.r.integers(14)
            if kind == 0:
                body += f"<h{k}>{said(text)}</h{k}>" if (k := self.r.integers(2, 5)) else ""
            elif kind == 1:
                body += "<ul>" + "".join(f"<li>{said(self.words(1, 12))}</li>" for _ in range(self.r.integers(1, 5))) + "</ul>"
            elif kind == 2:
                body += f"<blockquote>{said(text)}</blockquote>"
            elif kind == 3:
                body += f"<div>{said(text)}</div>"
            elif kind == 4:
                body += f"<p><b>{said(text)}<br>"
            elif kind == 5:
                cells = [self.words(1, 4) for _ in range(4)]
                main.extend(cells)
                body += "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></table>"
            elif kind == 6:
                body += f"<p>{said(text)}"
            elif kind == 7 and self.r.random() < 0.5:
                body += self.one([self.advert, self.notice, self.form, self.aside])()
            else:
                body += f"<p>{said(text)}</p>"
        return a + body + b, main

    def page(self) -> tuple[str, list[str]]:
        p = lambda x: self.r.random() < x
        head = f"<head><meta charset='utf-8'><title>{self.words(1, 10)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>" if p(0.9) else ""
        above = [f() for f, x in ((self.header, 0.4), (self.menu, 0.7), (self.notice, 0.3), (self.advert, 0.5), (self.form, 0.1), (self.aside, 0.15)) if p(x)]
        below = [f() for f, x in ((self.aside, 0.3), (self.advert, 0.3), (self.remarks, 0.35), (self.form, 0.2), (self.menu, 0.15), (self.notice, 0.2), (self.footer, 0.8)) if p(x)]
        if p(0.5):
            self.r.shuffle(above)
        body, main = self.article()
        if p(0.03):
            body, main = "", []
        a, b = self.one([("", ""), ("", ""), ('<div id="wrapper">', "</div>"), ('<div class="container"><div class="row">', "</div></div>")])
        page = f"<!DOCTYPE html><html>{head}<body>{a}{''.join(above)}<!-- ad 1 -->{body}{''.join(below)}{b}"
        return page + ("" if p(0.15) else "</body></html>"), main


def labelled(seed: int, n: int) -> list[tuple[list[bl.Block], np.ndarray]]:
    """Parsed pages and the labels of their blocks, matched in order to the main texts."""
    source, out = Pages(seed), []
    import html as entities

    while len(out) < n:
        page, main = source.page()
        wanted = [" ".join(entities.unescape(t).split()) for t in main]
        blocks, at = bl.parse(page), 0
        labels = np.zeros(len(blocks), np.float32)
        start = page.index("<!-- ad 1 -->")
        early = len(bl.parse(page[:start]))
        for i in range(early, len(blocks)):
            if at < len(wanted) and blocks[i].text == wanted[at]:
                labels[i] = 1
                at += 1
        if at == len(wanted) and blocks:
            out.append((blocks, labels))
    return out


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    size, h = 2 * bl.WIDTH + bl.NUMBERS, bl.HIDDEN
    w = {"path": r.normal(0, 0.3, (bl.PATH_BUCKETS, bl.WIDTH)), "word": r.normal(0, 0.05, (bl.WORD_BUCKETS, bl.WIDTH)), "v": r.normal(0, 0.2, (2 * h + size, 1)), "c": np.zeros(1)}
    for d in "fb":
        w |= {f"w{d}": r.normal(0, 0.2, (size, 4 * h)), f"u{d}": r.normal(0, 0.2, (h, 4 * h)), f"b{d}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])}
    return {k: v.astype(np.float32) for k, v in w.items()}


def back_lstm(x, mask, w, u, kept, dout):
    """Gradients of an LSTM run for w, u, b and x."""
    h_ = bl.HIDDEN
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * h_, x.dtype), np.empty_like(x)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, c, c2, i, f, o, new = kept[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        th = np.tanh(c2)
        g = np.where(m, dh, 0)
        dc2 = np.where(m, dc, 0) + g * o * (1 - th * th)
        dz = np.concatenate([dc2 * new * i * (1 - i), dc2 * c * f * (1 - f), g * th * o * (1 - o), dc2 * i * (1 - new * new)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w.T
        dh = np.where(m, 0, dh) + dz @ u.T
        dc = np.where(m, 0, dc) + dc2 * f
    return dw, du, db, dx


def train(pages: int = 5000, epochs: int = 6, batch: int = 32, rate: float = 4e-3) -> dict[str, np.ndarray]:
    w = initial()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    data = labelled(1, pages)
    made = [([np.array(bl.path_buckets(b.path)) for b in own], [np.array(bl.word_buckets(b.text)) for b in own], np.array([bl.numbers(b, i / len(own)) for i, b in enumerate(own)], np.float32), labels) for own, labels in data]
    r, step = np.random.default_rng(5), 0
    for epoch in range(epochs):
        total = 0.0
        order = sorted(range(len(made)), key=lambda i: len(made[i][3]) + r.random() * 6)
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        r.shuffle(groups)
        for group in groups:
            sizes = np.array([len(made[i][3]) for i in group])
            steps = sizes.max()
            x = np.zeros((steps, len(group), 2 * bl.WIDTH + bl.NUMBERS), np.float32)
            y, mask = np.zeros((steps, len(group)), np.float32), np.arange(steps)[:, None] < sizes
            hide = r.random((steps, len(group))) < 0.15  # paths are sometimes hidden, so that the neighbours must tell
            for k, i in enumerate(group):
                paths, words, nums, labels = made[i]
                for t in range(sizes[k]):
                    if not hide[t, k]:
                        x[t, k, : bl.WIDTH] = w["path"][paths[t]].mean(axis=0)
                    x[t, k, bl.WIDTH : 2 * bl.WIDTH] = w["word"][words[t]].mean(axis=0)
                x[: sizes[k], k, 2 * bl.WIDTH :] = nums
                y[: sizes[k], k] = labels
            kf, kb = [], []
            ahead = bl.run_lstm(x, mask, w["wf"], w["uf"], w["bf"], kf)
            back = bl.run_lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"], kb)[::-1]
            joint = np.concatenate([ahead, back, x], axis=2)
            p = bl.sigmoid(joint @ w["v"] + w["c"])[:, :, 0]
            total += float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / mask.sum())
            d = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            grads = {"v": np.einsum("tbi,tbo->io", joint, d), "c": d.sum(axis=(0, 1))}
            dj = d @ w["v"].T
            h = bl.HIDDEN
            grads["wf"], grads["uf"], grads["bf"], dxf = back_lstm(x, mask, w["wf"], w["uf"], kf, dj[:, :, :h])
            grads["wb"], grads["ub"], grads["bb"], dxb = back_lstm(x[::-1], mask[::-1], w["wb"], w["ub"], kb, dj[::-1, :, h : 2 * h])
            dx = dj[:, :, 2 * h :] + dxf + dxb[::-1]
            gp, gw = np.zeros_like(w["path"]), np.zeros_like(w["word"])
            for k, i in enumerate(group):
                paths, words, _, _ = made[i]
                for t in range(sizes[k]):
                    if not hide[t, k]:
                        np.add.at(gp, paths[t], dx[t, k, : bl.WIDTH] / len(paths[t]))
                    np.add.at(gw, words[t], dx[t, k, bl.WIDTH : 2 * bl.WIDTH] / len(words[t]))
            grads["path"], grads["word"] = gp, gw
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w[k] -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch + 1}: loss {total / len(groups):.4f}", file=sys.stderr)
    return w


def score(w: dict[str, np.ndarray], seed: int, n: int) -> tuple[float, float]:
    """Shares of blocks and of whole pages labelled right, on pages of another seed."""
    net, right, blocks, whole = bl.Labeller(w), 0, 0, 0
    data = labelled(seed, n)
    for (_, labels), p in zip(data, net.chances([net.vectors(own) for own, _ in data])):
        good = (p >= 0.5) == (labels > 0)
        right, blocks, whole = right + good.sum(), blocks + len(good), whole + good.all()
    return right / blocks, whole / len(data)


if __name__ == "__main__":
    began = time.time()
    weights = train()
    print("held-out blocks, pages right: %.4f %.4f; %.0f s" % (*score(weights, 99, 500), time.time() - began))
    np.savez_compressed(Path(__file__).with_name("blocks.npz"), **{k: v.astype(np.float16) for k, v in weights.items()})
