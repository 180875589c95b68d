"""Synthetic pages with known main text, on which the extractor's trees are fitted.

Every page is drawn from a seeded generator: a main part in one of many
containers, and around and inside it menus, headers, footers, sidebars,
notices, adverts, forms, share bars and reader comments, under many tags and
class names or none. Elements that hold boilerplate carry the attribute
``data-drop``, which the trainer reads and no feature sees.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ba co de el fi go ha in jo ka lo mi ne or pa qui ro sa ti un ve wa xi yo zu".split()
_KINDS = {
    "nav": (["nav", "div", "ul", "div"], ["nav", "menu", "navbar", "main-menu", "navigation", "breadcrumb", "topnav", ""]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "topbar", "page-header", "logo", ""]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "bottom", "colophon", "legal", ""]),
    "sidebar": (["aside", "div"], ["sidebar", "widget", "related", "side", "recommended", "popular", "aside", "rail"]),
    "notice": (["div", "section"], ["cookie", "notice", "consent", "cookie-banner", "alert", "gdpr", "popup", "modal", "newsletter"]),
    "ad": (["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement", "ad-slot"]),
    "form": (["form"], ["search", "login", "subscribe", "contact", "signup", ""]),
    "share": (["div", "ul"], ["share", "social", "share-buttons", "tags", "toolbar"]),
    "comments": (["section", "div", "ol"], ["comments", "comment-list", "comment", "disqus", "replies", "respond", "reader-comments"]),
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        for k in range(len(out)):
            if self.r.random() < 0.12:
                out[k] += self.r.choice(",.;:")
        return " ".join(out).capitalize() + self.r.choice([".", ".", "", "!"])

    def attrs(self, names: list[str]) -> str:
        name = self.r.choice(names)
        if not name:
            return ""
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="c{self.r.randint(1, 9)} {name}"', f" class='{name}-{self.r.choice(['a', 'wrap', 'box', 'inner'])}'"])

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.r.randint(1, 999)}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " ".join(items)

    def boilerplate(self, kind: str) -> str:
        tags, names = _KINDS[kind]
        tag, r = self.r.choice(tags), self.r
        body = {
            "nav": lambda: self.links(2, 9),
            "header": lambda: f'<a href="/">{self.words(1, 3)}</a>' + r.choice(["", f"<p>{self.words(2, 8)}</p>", self.links(1, 5)]),
            "footer": lambda: r.choice([f"&copy; {self.words(1, 12)}", f"<p>&copy; {self.words(2, 25)}</p>", self.links(2, 8) + f"<p>{self.words(3, 20)}</p>"]),
            "sidebar": lambda: f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(2, 7), f"<p>{self.words(5, 60)}</p>", f"<p>{self.words(5, 30)}</p>" * 2]),
            "notice": lambda: f"<p>{self.words(6, 40)}</p>" + r.choice(["", "<button>OK</button>", self.links(1, 2)]),
            "ad": lambda: r.choice([self.words(3, 30), f"<p>{self.words(5, 40)}</p>", f'<a href="/x">{self.words(3, 12)}</a>']),
            "form": lambda: f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + r.choice(["", f"<p>{self.words(4, 20)}</p>"]),
            "share": lambda: self.links(2, 6),
            "comments": lambda: r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + "".join(f'<div class="{r.choice(["comment", "reply", "c", "comment-body"])}"><b>{self.words(1, 2)}</b><p>{self.words(5, 60)}</p></div>' for _ in range(r.randint(1, 6))),
        }[kind]()
        if tag == "ul" and not body.startswith("<ul>"):
            tag = "div"
        return f"<{tag}{self.attrs(names)} data-drop>{body}</{tag}>"

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for k in range(len(words)):
            if self.r.random() < 0.03:
                tag = self.r.choice(['a href="/y"', "b", "em", "span", "i"])
                words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    def block(self) -> str:
        r = self.r.random()
        if r < 0.72:
            text = self.inline(self.words(1, self.r.choice([6, 40, 120, 300])))
            return f"<p>{text}</p>" if self.r.random() < 0.85 else f"<p><b>{text}<br>"
        if r < 0.8:
            k = self.r.randint(2, 4)
            return f"<h{k}>{self.words(1, 8)}</h{k}>"
        if r < 0.87:
            return "<ul>" + "".join(f"<li>{self.inline(self.words(2, 25))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"
        if r < 0.92:
            return f"<blockquote>{self.r.choice(['', '<p>'])}{self.words(5, 60)}</blockquote>"
        if r < 0.95:
            return f"<pre>{self.words(3, 30)}</pre>"
        if r < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        return f"<div>{self.words(5, 80)}</div>"

    def page(self) -> str:
        r = self.r
        title = self.words(1, 12)
        blocks = [f"<h1>{title}</h1>"] * (r.random() < 0.85) + [self.block() for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3, 5, 8, 15]))]
        if r.random() < 0.6 or not blocks:
            # Many articles open with their title's words; some hold nothing more.
            lead = f"{title} {self.words(1, r.choice([5, 20, 60]))}" if r.random() < 0.6 else title
            blocks.insert(min(1, len(blocks)), f"<p><b>{lead}<br>" if r.random() < 0.6 else f"<p>{lead}</p>")
        for kind in ("ad", "share", "sidebar", "form", "notice", "comments", "nav"):
            if r.random() < 0.14:
                at = len(blocks) if kind == "comments" else r.randint(1, len(blocks))
                blocks.insert(at, self.boilerplate(kind))
        tag, names = r.choice([("article", ["", "post", "entry", "story"]), ("main", ["", "content"]), ("div", ["content", "post", "entry-content", "article-body", "main", "story", "text"]), ("section", ["content", "", "article"]), ("div", [""])])
        main = f"<{tag}{self.attrs(names)}>{''.join(blocks)}</{tag}>"
        for _ in range(r.randint(0, 2)):
            main = f"<div{self.attrs(['wrapper', 'container', 'page', 'row', '', 'layout', 'main'])}>{main}{self.boilerplate('sidebar') if r.random() < 0.3 else ''}</div>"
        top = [self.boilerplate(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < (0.75 if k in ("header", "nav") else 0.35)]
        end = [self.boilerplate(k) for k in ("comments", "sidebar", "ad", "share", "nav", "footer", "notice") if r.random() < (0.8 if k == "footer" else 0.3)]
        if r.random() < 0.3:
            r.shuffle(top)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{''.join(top)}{main}{''.join(end)}</body></html>"


def pages(n: int, seed: int = 5) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
