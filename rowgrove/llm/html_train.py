"""Training of the block labeller on generated pages whose main text is known.

``python -m rowgrove.llm.html_train`` writes the weights file anew; the seed makes it reproducible.
Pages are drawn from random layouts: semantic or plain containers, many class names, menus, headers, footers, sidebars, notices,
adverts, forms, related links and reader comments (some of them inside the article), untidy mark-up, several made-up languages.
"""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np

from . import html_lstm
from .html_blocks import Features, blocks_of

PAGES, EPOCHS, BATCH, SEED = 9_000, 7, 48, 77

# Words that pages use around their text, and names of classes.
SYLLABLES = ("an er th on in the re ti es or nt ed at en st ou ha", "en er ch ei te ge st un be ie au ung sch ü ß", "de la os ci ón ar el es ra ta do que ñ í", "le ou ai eau é ent que on re tion è ch", "ka no shi ta mi ru to ha ne yo", "ов на ст ен то ра ко ни ла", "ing ly ness ful able ment pre con")
MENU = "Home|About|Contact|News|Sport|Login|Sign up|Search|Blog|Archive|Products|Services|Startseite|Über uns|Kontakt|Inicio|Noticias|Accueil|Actualités|Shop|Help|FAQ|Careers|Press|Forum|Videos|Photos|Weather".split("|")
FOOT = "All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Aviso legal|Mentions légales|Powered by|Sitemap|Cookie settings|© 2019|© 2024|Copyright|Follow us|Subscribe to our newsletter|Tous droits réservés|Alle Rechte vorbehalten".split("|")
NOTICE = "We use cookies to improve your experience|Accept all|Reject|Diese Website verwendet Cookies|Este sitio utiliza cookies|Ce site utilise des cookies|Please enable JavaScript|You have 3 free articles left|Subscribe now to continue reading|Your session has expired|Notice: maintenance tonight".split("|")
FORM = "Name|Email|Password|Submit|Send|Search|Your comment|Post comment|Subscribe|Sign in|Remember me|Forgot password?|Choose a country|Phone".split("|")
ADVERT = "Advertisement|Sponsored|Buy now|Special offer|50% off|Anzeige|Publicidad|Publicité|Limited time deal|Click here|Shop today|Free shipping|Promoted".split("|")
TALK = "Reply|says|Great post!|I disagree|Comments|Leave a comment|Posted by|Report|Like|Kommentare|Comentarios|Commentaires|thanks for sharing|wrote".split("|")
MAIN_NAMES = "content|main-content|post-content|entry-content|article-body|story|post|entry|text|body-copy|articleText|page-content|main|post-body|single|prose".split("|")
SIDE_NAMES = "sidebar|side|aside|widget|related|related-posts|recommended|most-read|trending|right-col|rail|tags|popular|see-also".split("|")
AD_NAMES = "ad|ads|advert|advertisement|banner|promo|sponsored|ad-slot|adBox|teaser-ad|commercial|partner".split("|")
NOTICE_NAMES = "notice|cookie|cookie-banner|consent|alert|gdpr|popup|modal|paywall|message|warning|overlay|newsletter".split("|")
TALK_NAMES = "comments|comment|commentlist|discussion|responses|disqus|reader-comments|replies|user-comments|reactions".split("|")
TOP_NAMES = "header|site-header|masthead|top|topbar|branding|logo|page-header".split("|")
FOOT_NAMES = "footer|site-footer|bottom|colophon|legal|copyright|page-footer".split("|")
MENU_NAMES = "nav|menu|navbar|navigation|breadcrumb|breadcrumbs|main-menu|links|toc|pagination|pager|share|social".split("|")


class Maker:
    """Random pages; main text is marked by a private-use sign that features never see."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return "".join(self.pick(self.syllables) for _ in range(int(self.r.integers(1, 4))))

    def sentence(self, low: int = 2, high: int = 20) -> str:
        words = [self.word() for _ in range(int(self.r.integers(low, high)))]
        sign = self.junk
        text = " ".join(w + self.pick(sign) for w in words)
        return text[:1].upper() + text[1:] + self.pick([".", ".", ".", "?", "!", ""])

    def prose(self, low: int = 1, high: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(int(self.r.integers(low, high))))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def label(self, known) -> str:
        return self.pick(known) if self.chance(0.5) else self.sentence(1, 4).rstrip(".?!")

    def attributes(self, names) -> str:
        if self.plain:
            return ""
        name = self.pick(names)
        return self.pick([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f" class={name}", f' class="{self.word()}-{name}"'])

    def main_text(self, text: str) -> str:
        return self.MARK + text

    def article(self) -> str:
        out = []
        if self.chance(0.8):
            tag = self.pick(["h1", "h1", "h2"])
            title = f"<{tag}>{self.main_text(self.sentence(1, 12))}</{tag}>"
            if self.chance(0.15):  # an article's own header holds its title
                title = f"<header>{title}{f'<p>{self.main_text(self.prose(1, 2))}</p>' if self.chance(0.4) else ''}</header>"
            out.append(title)
        untidy = self.chance(0.4)
        for _ in range(int(self.r.integers(1, self.pick([4, 8, 24])))):
            kind = self.r.random()
            text = self.sentence(1, 4) if kind < 0.25 else self.prose(20, 90) if kind < 0.27 else self.prose()
            if self.chance(0.07) and not self.plain:  # articles, too, speak of licences, offers and cookies
                text = self.pick([*FOOT, *NOTICE, *ADVERT, *TALK]) + " " + (self.sentence(1, 9) if self.chance(0.7) else f"{self.word()} 4.0.")
            text = self.main_text(text)
            if self.chance(0.15):
                text += " " + self.link(self.word()) + " " + self.word()
            if kind < 0.86:
                out.append(f"<p><b>{text}<br>" if untidy and self.chance(0.3) else f"<p>{text}" if untidy and self.chance(0.3) else f"<p>{text}</p>")
            elif kind < 0.91:
                out.append(f"<h{self.pick([2, 3])}>{self.main_text(self.sentence(1, 6))}</h{self.pick([2, 3])}>")
            elif kind < 0.935:
                tag = self.pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.main_text(self.sentence(1, 9))}</li>" for _ in range(int(self.r.integers(2, 6)))) + f"</{tag}>")
            elif kind < 0.98:
                out.append(self.pick([f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<figure><img><figcaption>{text}</figcaption></figure>", f"<dl><dt>{self.main_text(self.word())}</dt><dd>{text}</dd></dl>", f"<div>{text}</div>", f"<section><p>{text}</p></section>"]))
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.main_text(self.word())}</td><td>{self.main_text(self.word())}</td></tr>" for _ in range(3)) + "</table>")
        for part, p in ((self.advert, 0.25), (self.aside, 0.12), (self.menu, 0.08), (self.talk, 0.12), (self.form, 0.06), (self.notice, 0.06)):
            if self.chance(p):
                plain, self.plain = self.plain, False
                spot = len(out) if part == self.talk else int(self.r.integers(len(out) + 1))
                out.insert(spot, part())
                self.plain = plain
        return "".join(out)

    def bare(self) -> str:
        """An article without a container: paragraphs, or text with line ends between, directly in the body."""
        if self.chance(0.5):
            return self.article()
        lines = [self.main_text(self.prose(1, 5)) for _ in range(int(self.r.integers(1, 12)))]
        head = f"<h1>{self.main_text(self.sentence(1, 9))}</h1>" if self.chance(0.7) else ""
        return head + self.pick(["<br><br>", "<p>", "<hr>", "<br>"]).join(lines)

    def menu(self) -> str:
        items = [self.label(MENU) for _ in range(int(self.r.integers(2, 10)))]
        tag = self.pick(["nav", "nav", "div", "ul", "div"])
        name = self.attributes(MENU_NAMES) if tag != "nav" or self.chance(0.3) else ""
        if tag == "ul" or self.chance(0.6):
            body = "".join(f"<li>{self.link(x)}</li>" if self.chance(0.9) else f"<li>{x}</li>" for x in items)
            return f"<{tag}{name}>{body}</{tag}>" if tag == "ul" else f"<{tag}{name}><ul>{body}</ul></{tag}>"
        return f"<{tag}{name}>{self.pick([' | ', ' ', ' &middot; ']).join(map(self.link, items))}</{tag}>"

    def header(self) -> str:
        tag = self.pick(["header", "header", "div"])
        body = self.pick([f"<h1>{self.label(MENU)}</h1>", f"<div>{self.link(self.label(MENU))}</div>", f"<p>{self.sentence(1, 8)}</p>", f"<h1>{self.link(self.word())}</h1><p>{self.sentence(2, 6)}</p>"])
        return f"<{tag}{self.attributes(TOP_NAMES)}>{body}{self.menu() if self.chance(0.4) else ''}</{tag}>"

    def aside(self) -> str:
        tag = self.pick(["aside", "div", "section"])
        name = self.attributes(SIDE_NAMES) if tag != "aside" or self.chance(0.5) else ""
        body = f"<h3>{self.label(MENU)}</h3>" if self.chance(0.6) else ""
        if self.chance(0.5):
            body += "<ul>" + "".join(f"<li>{self.link(self.sentence(1, 9))}</li>" for _ in range(int(self.r.integers(2, 7)))) + "</ul>"
        else:
            body += "".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(int(self.r.integers(1, 4))))
        return f"<{tag}{name}>{body}</{tag}>"

    def advert(self) -> str:
        body = self.pick([self.prose(1, 3), self.label(ADVERT), f"<p>{self.label(ADVERT)}</p><p>{self.prose(1, 3)}</p>", self.link(self.sentence(1, 6))])
        comment = f"<!-- ad {int(self.r.integers(9))} -->" if self.chance(0.4) else ""
        return f"{comment}<{(t := self.pick(['div', 'div', 'section', 'aside'] if '<p' in body else ['div', 'div', 'section', 'p']))}{self.attributes(AD_NAMES)}>{body}</{t}>"

    def notice(self) -> str:
        body = self.pick([f"<p>{self.label(NOTICE)}. {self.prose(1, 3)}</p>", self.label(NOTICE), f"<p>{self.prose(1, 3)}</p><button>{self.label(FORM)}</button>"])
        return f"<div{self.attributes(NOTICE_NAMES)}>{body}</div>"

    def form(self) -> str:
        fields = "".join(f"<label>{self.label(FORM)}</label><input>" if self.chance(0.6) else f"<p>{self.label(FORM)} <input></p>" for _ in range(int(self.r.integers(1, 5))))
        extra = f"<p>{self.prose(1, 3)}</p>" if self.chance(0.4) else ""
        return f"<form{self.attributes(['search', 'login', 'form', 'signup', 'contact'])}>{extra}{fields}<button>{self.label(FORM)}</button></form>"

    def talk(self) -> str:
        tag, inner = self.pick([("section", "article"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "p"), ("aside", "p")])
        out = [f"<h3>{self.label(TALK)}</h3>"] if self.chance(0.5) and tag not in ("ol", "ul") else []
        for _ in range(int(self.r.integers(1, 7))):
            who = f"<b>{self.word()}</b> {self.pick(TALK)}: " if self.chance(0.4) else ""
            text = who + (self.label(TALK) if self.chance(0.2) else self.prose(1, 5))
            out.append(f"<{inner}{self.attributes(TALK_NAMES) if self.chance(0.5) else ''}>{text if inner == 'p' or self.chance(0.5) else f'<p>{text}</p>'}</{inner}>")
        plain, self.plain = self.plain, False
        name = self.attributes(TALK_NAMES)
        self.plain = plain
        return f"<{tag}{name}>{''.join(out)}</{tag}>"

    def footer(self) -> str:
        tag = self.pick(["footer", "footer", "div"])
        name = self.attributes(FOOT_NAMES) if tag != "footer" or self.chance(0.4) else ""
        start = f"&copy; {self.word()}.example &middot; " if self.chance(0.5) else ""
        body = self.pick([start + self.prose(1, 3), f"<p>{start}{self.label(FOOT)}</p>", f"<ul>{''.join(f'<li>{self.link(self.label(FOOT))}</li>' for _ in range(4))}</ul><p>{self.label(FOOT)}</p>"])
        return f"<{tag}{name}>{body}</{tag}>"

    def page(self) -> str:
        self.syllables = self.pick(SYLLABLES).split()
        self.junk = self.pick([[""], [""], ["", "", ","], [" |"], ["!!"], ["###", "%%%", "&amp;&amp;", "***"]])
        self.plain = False
        kind = self.r.random()
        tag, name = ("article", "") if kind < 0.45 else ("main", "") if kind < 0.6 else (self.pick(["div", "section", "td"]), self.attributes(MAIN_NAMES))
        self.plain = self.chance(0.12)
        before = [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.85), (self.advert, 0.5), (self.form, 0.15), (self.aside, 0.2)) if self.chance(p)]
        after = [f() for f, p in ((self.advert, 0.2), (self.talk, 0.35), (self.aside, 0.35), (self.form, 0.25), (self.menu, 0.2), (self.footer, 0.85), (self.notice, 0.1)) if self.chance(p)]
        if self.chance(0.08):  # a page of its article alone
            before, after = [], []
        alone = self.chance(0.13)
        main = self.bare() if alone else f"<{tag}{name if tag in ('article', 'main') or not self.plain else ''}>{self.article()}</{tag}>"
        if self.chance(0.3) and not alone:
            main = f"<div{self.attributes(['container', 'wrapper', 'page', 'row', 'layout', 'outer'])}>{main}{after.pop(0) if after and self.chance(0.5) else ''}</div>"
        end = "</body></html>" if self.chance(0.9) else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 9)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{main}{''.join(after)}{end}"


def labelled(pages: int, seed: int):
    """(path buckets, word buckets, figures, labels) of generated pages."""
    maker, features = Maker(seed), Features()
    for _ in range(pages):
        blocks = blocks_of(maker.page())
        y = np.array([Maker.MARK in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(Maker.MARK, "") or "-"
        if blocks:
            yield (*features.of(blocks), y)


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, say=print) -> dict[str, np.ndarray]:
    data = list(labelled(pages, seed))
    w, rng = html_lstm.fresh(), np.random.default_rng(seed)
    adam = html_lstm.Adam(w)
    for epoch in range(epochs):
        order = np.array(sorted(rng.permutation(len(data)), key=lambda i: len(data[i][3]) + 4 * rng.random()))
        batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        losses = []
        for k in rng.permutation(len(batches)):
            some = [data[i] for i in batches[k]]
            loss, grads = html_lstm.gradients([p for d in some for p in d[0]], [x for d in some for x in d[1]], np.concatenate([d[2] for d in some]), [len(d[3]) for d in some], np.concatenate([d[3] for d in some]), w)
            adam.step(w, grads)
            losses.append(loss)
        say(f"epoch {epoch}: loss {np.mean(losses):.4f}")
    return w


def accuracy(w: dict, pages: int, seed: int) -> float:
    right = total = 0
    for paths, words, figures, y in labelled(pages, seed):
        x, _ = html_lstm.inputs(paths, words, figures, w)
        right += int(((html_lstm.label(x, [len(y)], w) > 0.5) == (y > 0)).sum())
        total += len(y)
    return right / max(1, total)


if __name__ == "__main__":
    weights = train()
    print("held-out accuracy", accuracy(weights, 400, SEED + 1))
    to = sys.argv[1] if len(sys.argv) > 1 else Path(__file__).with_name(html_lstm.WEIGHTS)
    np.savez_compressed(to, **{k: v.astype(np.float16) for k, v in weights.items()})
