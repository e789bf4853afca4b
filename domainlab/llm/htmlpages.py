"""Labelled pages to fit the extraction model on.

Pages are put together at random from the parts that sites are made of, with many ways of
marking each part up, with and without telling class names, nested in wrappers, sometimes
with elements left open. Each block of the article carries a token of its own, so that the
label of any block of the parsed page is known whatever the parser makes of the mark-up."""

from __future__ import annotations

import random

from domainlab.llm.htmldom import Node

#: Ends every word of the article's blocks, and of nothing else.
MARK = "⁣"

_SYLLABLES = "an er in on re th st en ti or ed ha es it nd al ou le ng se ar te co de ra vi mo lu pa".split()

#: Ways to write the opening tag of each part outside the article; %s is a random suffix.
_WAYS = {
    "menu": ["<nav>", '<nav class="main-nav">', '<div class="menu">', '<div id="navigation">', '<ul class="nav">',
             '<div role="navigation">', '<div class="breadcrumb">', '<ol class="breadcrumbs">', '<div class="navbar">',
             '<div class="pagination">', '<ul id="main-menu">', "<div>"],
    "header": ["<header>", '<div id="header">', '<div class="masthead">', '<header class="site-header">',
               '<div class="top-banner">', '<div role="banner">', '<div class="site-branding">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<footer class="foot">',
               '<div role="contentinfo">', '<div class="copyright">', '<div class="legal">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">',
             '<div class="related-posts">', '<section class="recommended">', '<div class="popular">',
             '<div role="complementary">', '<div class="author-bio">', '<div class="tags">', '<section class="related">'],
    "advert": ['<div class="ad">', '<div class="advert">', '<div id="ads">', '<div class="sponsored">',
               '<section class="promo">', '<div class="ad-slot">', '<p class="advertisement">', '<aside class="ad">',
               '<div class="banner-ad">'],
    "notice": ['<div class="cookie-notice">', '<div id="cookie-consent">', '<div class="gdpr">',
               '<div class="newsletter">', '<div role="dialog">', '<div class="alert">', '<section class="subscribe">',
               '<div class="modal popup">', "<dialog>", '<div class="notice">', '<div id="cookies">',
               '<div role="alert">', '<p class="notice">', '<div class="cookie-banner">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="social-links">', '<div class="follow-us">'],
    "comment": ['<section id="comments">', '<div class="comments">', '<div id="comments">', '<ol class="commentlist">',
                '<div class="comment-thread">', '<section class="reader-comments">', '<div id="disqus_thread">',
                '<div class="replies">', '<div class="discussion">', '<div class="comment">', '<ul class="comments">'],
    "form": ["<form>", '<form action="/s" class="search">', '<form id="login">', '<form class="contact-form">',
             '<form method="post">'],
    "hidden": ['<div hidden>', '<div style="display:none">', '<div aria-hidden="true">'],
}
_WRAP = ["<div>", '<div class="wrapper">', '<div class="container">', '<div id="page">', "<section>",
         '<div class="row">', '<div class="col-8">', '<div class="inner">', "<main>", '<div id="content">',
         '<main role="main">', '<div class="layout">']
_ARTICLE = ["<article>", "<article>", "<article>", '<article class="post">', "<main>", '<div class="article">',
            '<div id="content">', '<div class="post-content">', '<section class="story">', '<div class="entry">',
            '<div itemprop="articleBody">', '<div class="main-text">', '<div role="main">', "<div>", "<section>",
            '<div class="content">', '<section>']


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        # some pages have odd prose: few sentence marks, symbols at words, very short texts
        self.dry = self.r.random() < 0.15
        self.odd = self.r.choice(["", "", "", "", "", "###", "%%%", "!!"])

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice([1, 1, 2, 2, 3, 4])))

    def prose(self, n: int, mark: bool = False) -> str:
        out = []
        for k in range(n):
            w = self.word()
            if not self.dry and (k == n - 1 or self.r.random() < 0.12):
                w += self.r.choice([".", ".", ",", "!", "?"] if k < n - 1 else ["."])
            out.append((w.capitalize() if not k or out[-1].rstrip(MARK)[-1:] in ".!?" else w) + self.odd + MARK * mark)
        return " ".join(out)

    def link(self, n: int = 0, mark: bool = False) -> str:
        return f'<a href="/{self.word()}">{self.prose(n or self.r.randint(1, 3), mark).rstrip(".")}</a>'

    def close(self, opening: str) -> str:
        return f"</{opening[1:].split()[0].rstrip('>')}>"

    def links(self) -> str:
        items = [self.link() for _ in range(self.r.randint(1, 8))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", ""]).join(items)

    def paragraphs(self, lo: int, hi: int) -> str:
        return "".join(f"<p>{self.prose(self.r.randint(3, 40))}</p>" for _ in range(self.r.randint(lo, hi)))

    def part(self, kind: str) -> str:
        r, opening = self.r, self.r.choice(_WAYS[kind])
        if opening == "<div>":
            inner = "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(3, 8))) + "</ul>"
        elif kind == "menu":
            inner = self.links()
            if opening.startswith(("<ul", "<ol")):
                inner = "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(1, 7)))
        elif kind == "header":
            inner = r.choice([f"<a href='/'>{self.prose(2)}</a>", f"<h1>{self.prose(2)}</h1>",
                              f"<p>{self.prose(r.randint(2, 9))}</p>", self.prose(3)]) + r.choice(["", self.links()])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.word()}.example &middot; {self.prose(r.randint(2, 20))}",
                              f"<p>&copy; 2020 {self.prose(r.randint(2, 12))}</p>", self.links(),
                              f"<p>{self.prose(r.randint(4, 25))}</p>" + self.links(), self.prose(r.randint(2, 12))])
        elif kind == "side":
            inner = r.choice([f"<h3>{self.prose(2)}</h3>" + self.links(), self.links(),
                              f"<h4>{self.prose(2)}</h4>" + self.paragraphs(1, 3), self.paragraphs(1, 2)])
        elif kind == "advert":
            inner = r.choice([self.prose(r.randint(2, 40)), self.link(4) + " " + self.prose(5), self.paragraphs(1, 2)])
        elif kind == "notice":
            inner = r.choice([self.prose(r.randint(4, 40)), self.paragraphs(1, 2)]) + r.choice(
                ["", "<button>OK</button>", self.link(1)])
        elif kind == "share":
            inner = "".join(f"<li>{self.link(1)}</li>" for _ in range(r.randint(2, 5)))
        elif kind == "comment":
            one = lambda: r.choice([
                f'<div class="comment"><b>{self.word()}</b><p>{self.prose(r.randint(2, 50))}</p></div>',
                f"<li><p>{self.prose(r.randint(2, 50))}</p></li>", f"<p>{self.prose(r.randint(2, 60))}</p>",
                f"<div><span>{self.word()}</span> {self.prose(r.randint(2, 50))}</div>",
                f'<article class="comment"><p>{self.prose(r.randint(2, 50))}</p></article>'])
            inner = r.choice(["", f"<h3>{self.prose(2)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = (f"<label>{self.prose(2)}</label><input name=q><button>{self.word()}</button>"
                     + r.choice(["", f"<p>{self.prose(r.randint(3, 20))}</p>"]))
        else:
            inner = self.paragraphs(1, 2)
        if opening.startswith("<p"):
            inner = self.prose(r.randint(2, 30))
        return opening + inner + self.close(opening)

    def article(self) -> str:
        r = self.r
        opening = r.choice(_ARTICLE)
        out = []
        if r.random() < 0.8:
            title = self.link(r.randint(1, 12), True) if r.random() < 0.15 else self.prose(r.randint(1, 12), True)
            h = f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{title}</{t}>"
            out.append(h if r.random() < 0.85 else f"<header>{h}</header>")
        n = r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 20])
        for k in range(n):
            kind = r.random()
            words = r.choice([1, 2, 3, 6, 10, 20, 40, 60, 90])
            if kind < 0.72:
                text = self.prose(words, True)
                if r.random() < 0.15:
                    text += " " + self.link(2, True) + " " + self.prose(5, True)
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>",
                                     f"<p><em>{text}</em></p>", f"<div>{text}</div>", f"<p>{text}<br></p>"]))
            elif kind < 0.80:
                out.append(f"<h2>{self.prose(r.randint(1, 6), True)}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.prose(r.randint(1, 15), True)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{self.prose(words, True)}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.prose(2, True)}</td><td>{self.prose(1, True)}</td></tr>"
                                               for _ in range(3)) + "</table>")
            elif kind < 0.93:
                out.append(f"<pre>{self.prose(words, True)}</pre>")
            elif kind < 0.96:
                # paragraphs and lists that are links throughout: sources, further reading
                out.append(r.choice([f"<p>{self.link(max(3, words // 4), True)}.</p>", f"<p>{self.link(max(3, words // 2), True)}</p>",
                                     "<ul>" + "".join(f"<li>{self.link(r.randint(2, 9), True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                                     "<ol>" + "".join(f"<li>{self.link(r.randint(2, 9), True)}</li>" for _ in range(r.randint(2, 5))) + "</ol>"]))
            else:
                out.append(self.part(r.choice(["advert", "share", "notice", "form", "side"])))
        if r.random() < 0.1:
            out.append(self.part("comment"))
        body = "".join(out)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            w = r.choice(["<div>", '<div class="body">', "<section>", '<div class="text">'])
            body = w + body + self.close(w)
        return opening + body + self.close(opening)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            # bare text
            return r.choice(["", "<br>", "<html><body>"]) + self.prose(r.randint(5, 120), True)
        some = lambda kinds, p: [self.part(k) for k in kinds if r.random() < p]
        before = some(["notice"], 0.15) + some(["header"], 0.3) + some(["menu"], 0.75) + some(
            ["advert"], 0.5) + some(["form"], 0.1) + some(["hidden"], 0.05)
        after = some(["side"], 0.3) + some(["share"], 0.1) + some(["comment"], 0.3) + some(
            ["advert", "form", "notice"], 0.12) + some(["menu"], 0.15) + some(["footer"], 0.8)
        if r.random() < 0.3:
            r.shuffle(before)
        middle = self.article()
        if r.random() < 0.3:
            # a wrapper around the article and what stands beside it
            w, k = r.choice(_WRAP), r.randint(0, len(after))
            middle = w + middle + "".join(after[:k]) + self.close(w)
            after = after[k:]
        body = "".join(before) + middle + "".join(after)
        if r.random() < 0.2:
            w = r.choice(_WRAP[:7])
            body = w + body + self.close(w)
        head = (f"<!DOCTYPE html><html><head><title>{self.prose(4)}</title><style>p{{margin:0}}</style>"
                f'<script>var t="</p>";</script></head><body>')
        page = head + body + "</body></html>"
        return page if r.random() < 0.9 else page[:-len("</body></html>")]


def page(seed: int) -> tuple[str, str]:
    """(html, the mark that ends the words of article blocks)."""
    return _Maker(seed).page(), MARK


def labels(nodes: list[Node], mark: str) -> list[int]:
    """1 for blocks that carry the mark and for elements that hold such a block; what is 0
    is boilerplate throughout. The marks are taken out of the texts."""
    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        x = nodes[k]
        if x.text is not None:
            out[k] = int(mark in x.text)
            x.text = x.text.replace(mark, "")
        if out[k] and x.parent >= 0:
            out[x.parent] = 1
    return out
