"""Labelled pages to train on: invented pages of many layouts, whose main text carries a mark."""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "\ue000"
"""Begins the text of each block of main text; taken out before features are made."""

#: Class or id words for each kind of page part, as sites commonly have them.
PARTS = {
    "menu": ("nav menu navbar navigation topnav main-menu site-nav breadcrumbs breadcrumb toc pagination pager links", "nav ul div"),
    "header": ("header site-header masthead topbar page-header banner logo branding", "header div"),
    "footer": ("footer site-footer page-footer colophon bottom copyright legal", "footer div"),
    "sidebar": ("sidebar side widget rail secondary related-posts related recommended popular tags trending", "aside div section"),
    "notice": ("cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay paywall message", "div section aside"),
    "advert": ("ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner-ad adsbygoogle", "div aside section ins"),
    "form": ("form search search-form newsletter signup subscribe login contact-form register", "form div"),
    "comments": ("comments comment-list comment commentlist discussion responses reply disqus reader-comments replies", "div section ol aside"),
    "share": ("share social sharing share-buttons follow social-links", "div ul"),
}
CONTENT = "article content main post post-content post-body entry entry-content story story-body article-body text body-text page-content main-content".split()
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "aeiourstlnmdéèçê", "aeiouäöüßnrstchg", "aeiouñíóácdrls", "абвгдежзиклмнопрст")
PHRASES = {
    "notice": "We use cookies to improve this site|This site uses cookies|Accept all cookies|Your privacy matters to us|Please enable scripts|You have two articles left",
    "footer": "© {w} All rights reserved|Copyright {w}|Terms of use|Privacy policy|&copy; {w} &middot; {s}",
    "form": "Subscribe to our newsletter|Search|Login|Register|Your email|Send",
    "share": "Share this|Follow us|Share on {w}",
    "advert": "Advertisement|Sponsored|{s}|Buy {w} now|{s}",
    "comments": "{n} Comments|Reply|Leave a reply|{w} says|Log in to comment",
    "sidebar": "Related|Most read|Popular posts|{s}",
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(ALPHABETS)
        self.lexicon = ["".join(self.r.choices(self.letters, k=self.r.randint(1, 9))) for _ in range(120)]

    def words(self, n: int) -> str:
        return " ".join(self.r.choices(self.lexicon, k=n))

    def sentence(self, most: int = 14) -> str:
        return (self.words(self.r.randint(1, most)).capitalize() + self.r.choice(".....?!")).replace(" ", self.r.choice([" ", " ", ", "]), 1)

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 1, 2, 3, 5, 9))))
        if self.r.random() < 0.15:
            text = text.replace(" ", " &amp; ", 1)
        if self.r.random() < 0.2:
            cut = len(text) // 2
            text = text[:cut] + self.r.choice(("<br>", "<b>x</b>", ' <a href="/x">x</a> ', "<em>y</em> ")) + text[cut:]
        return text

    def attributes(self, kind: str) -> str:
        names, _ = PARTS[kind]
        if self.r.random() < 0.25:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(names.split())}"'

    def phrase(self, kind: str) -> str:
        return self.r.choice(PHRASES[kind].split("|")).format(w=self.words(1), s=self.sentence(), n=self.r.randint(0, 99))

    def part(self, kind: str) -> str:
        r = self.r
        tags = PARTS[kind][1].split()
        attributes = self.attributes(kind)
        tag = tags[0] if not attributes else r.choice(tags)  # a plain div tells nothing
        if kind in ("advert", "notice", "comments", "share") and not attributes:
            attributes = f' class="{PARTS[kind][0].split()[0]}"'
        if kind == "menu":
            items = "".join(f'<li><a href="/{i}">{self.words(r.randint(1, 3))}</a></li>' for i in range(r.randint(2, 8)))
            body = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(f'<a href="/{i}">{self.words(1)}</a>' for i in range(4))
        elif kind == "comments":
            body = f"<h3>{self.phrase(kind)}</h3>" + "".join(f'<{"li" if tag == "ol" else "div"}{r.choice(["", " class=comment"])}><p>{self.prose()}</p></{"li" if tag == "ol" else "div"}>' for _ in range(r.randint(1, 4)))
        elif kind == "form":
            body = f"<label>{self.phrase(kind)}</label><input><button>{self.phrase(kind)}</button>" + r.choice(["", f"<p>{self.sentence()}</p>", f"<select><option>{self.words(1)}<option>{self.words(1)}</select>"])
            if tag != "form":
                body = f"<form>{body}</form>"
        elif kind == "sidebar":
            body = f"<h3>{self.phrase(kind)}</h3>" + r.choice([f"<p>{self.prose()}</p>", "<ul>" + "".join(f"<li><a href=/x>{self.sentence(6)}</a></li>" for _ in range(r.randint(1, 5))) + "</ul>", self.prose()])
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(2)}</h1>", f"<a href=/>{self.words(1)}</a>", f"<p>{self.sentence()}</p>", self.words(3)]) + r.choice(["", self.part("menu"), f"<div>{self.words(2)}</div>"])
        elif kind == "footer":
            body = r.choice([self.phrase(kind), f"<p>{self.phrase(kind)}</p>", f"<p>{self.prose()}</p><p>{self.phrase(kind)}</p>", f"&copy; {self.words(1)}.example &middot; {self.prose()}"])
        else:
            body = r.choice([self.prose(), f"<p>{self.phrase(kind)}</p>", f"<p>{self.prose()}</p>", self.phrase(kind)]) if kind in PHRASES else self.prose()
        return f"<{tag}{attributes}>{body}</{tag}>"

    def main(self) -> str:
        """Blocks of main text, with other parts in between at times."""
        r = self.r
        out = []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.66:
                out.append(f"<p>{MARK}{self.prose()}</p>" if r.random() < 0.85 else f"<p><b>{MARK}{self.prose()}<br>")
            elif x < 0.72:
                out.append(f"<h{r.randint(2, 4)}>{MARK}{self.words(r.randint(1, 6))}</h2>".replace("</h2>", f"</h{2}>"))
            elif x < 0.76:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.prose()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.79:
                out.append(f"<blockquote><p>{MARK}{self.prose()}</p></blockquote>")
            elif x < 0.81:
                out.append(f"<table><tr><td>{MARK}{self.words(2)}</td><td>{MARK}{self.words(1)}</td></tr></table>")
            elif x < 0.83:
                out.append(f"<figure><img src=x><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif x < 0.85:
                out.append(f"<pre>{MARK}{self.words(5)}</pre>")
            elif x < 0.88:
                out.append(f"<div>{MARK}{self.prose()}</div>")
            elif x < 0.97:
                out.append(self.part(r.choice(("advert", "share", "sidebar", "notice", "form", "menu"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        title = self.words(r.randint(1, 8))
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x:0}}</style><script>var a='</p>';</script></head><body>"
        before = "".join(self.part(k) for k in ("notice", "header", "menu", "advert", "form", "share") if r.random() < 0.45)
        after = "".join(self.part(k) for k in ("comments", "share", "sidebar", "form", "advert", "footer", "menu") if r.random() < 0.45)
        heading = f"<h1>{MARK}{title} {self.words(2)}</h1>"
        body = self.main()
        form = r.random()
        inner = self.part("comments") if r.random() < 0.12 else ""
        if form < 0.45:
            main = f"<article>{heading}{body}{inner}</article>"
        elif form < 0.55:
            main = f'<article class="{r.choice(CONTENT)}"><header>{heading}</header>{body}{inner}</article>'
        elif form < 0.7:
            main = f'<main>{r.choice(["", "<article>"])}{heading}{body}{inner}</main>'
        elif form < 0.92:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(CONTENT)}">{heading}{body}{inner}</div>'
        else:
            main = f"{heading}{body}"
        if r.random() < 0.3:
            before, main, after = before + f'<div class="{r.choice(("wrapper", "container", "page", "row", "site"))}">', main, f"{after}</div>"
        return head + before + main + after + r.choice(["</body></html>", ""])


def sample_pages(n: int, seed: int) -> Iterator[str]:
    for i in range(n):
        yield _Page(seed * 1_000_003 + i).page()
