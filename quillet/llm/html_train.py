"""Train the model of html_extract.py on generated pages: python -m quillet.llm.html_train.

Pages are drawn from several families of layouts, with the role of every stretch of text known. Half of them give the odds of
attribute tokens, the other half the trees. The sample is bounded by N_PAGES. Besides the model, the accuracy on pages of
each family by a model that has seen none of that family is printed.
"""

from __future__ import annotations

import json
import random

import numpy as np

from quillet.llm.boosting import logits, train
from quillet.llm.html_extract import BUCKETS, MODEL, Page

N_PAGES = 4000
#: Marks main text in a generated page; taken out again after parsing.
MARK = "\ue000"
SYLLABLES = "an ar be ci de do en er es fi ga he in la le lo ma me mi na ne no on or ou pa qu ra re ri sa se st ta te th ti to un ve ver wh zu ü é ñ ß".split()


#: Letters of other scripts, for pages that aren't in a Latin one.
SCRIPTS = ["абвгдежзиклмнопрстуфхцчшыюя", "αβγδεζηθικλμνξοπρστυφχψω", "的一是在不了有和人这中大为上个国我以要他时来用们", "あいうえおかきくけこさしすせそたちつてとなにぬねの"]
_script: list[str] = []  # the page's script, if it isn't Latin


def words(r: random.Random, n: int) -> str:
    if _script:
        gap = "" if _script[0][0] in "的あ" else " "
        return gap.join("".join(r.choices(_script[0], k=r.randint(2, 8))) + r.choice(["", "", "", "", ",", "."]) for _ in range(n)) + "."
    out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) + r.choice(["", "", "", "", "", ",", "."]) for _ in range(n)]
    if r.random() < 0.06:
        out = [w + r.choice(["***", "&amp;&amp;", "$$", " |"]) for w in out]
    return " ".join(out).capitalize() + "."


def tagged(r: random.Random, semantic: list[str], names: list[str]) -> tuple[str, str]:
    """A start and an end tag: one that says what it is, or a div or section with a class or id."""
    if semantic and r.random() < 0.5:
        tag = r.choice(semantic)
        extra = f' class="{r.choice(names)}"' if names and r.random() < 0.4 else ""
    else:
        tag = r.choice(["div", "div", "section"])
        extra = f' {r.choice(["class", "id"])}="{r.choice(["", "", "page-", "x "])}{r.choice(names)}{r.choice(["", "", "-1", " clearfix"])}"' if names else ""
    return f"<{tag}{extra}>", f"</{tag}>"


def links(r: random.Random, n: int) -> str:
    one = [f'<a href="/{i}">{words(r, r.randint(1, 4))}</a>' for i in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if r.random() < 0.7 else " | ".join(one)


def paragraph(r: random.Random, mark: str, least: int = 1, most: int = 90) -> str:
    n = int(np.exp(r.uniform(np.log(least), np.log(most))))
    text = mark + words(r, n)
    for _ in range(r.choice([0, 0, 0, 1, 1, 2, 4])):  # markup within the text, around a word or a few
        inline = r.choice(['a href="#"', "b", "em", "span", "code", "strong", "i", 'span class="x"', "sup", "br"])
        inner = mark + r.choice([words(r, 1)[: r.randint(1, 4)], words(r, r.randint(1, 4))])
        text += f"<br>{inner} " if inline == "br" else f" <{inline}>{inner}</{inline.split()[0]}>"
        text += r.choice(["", f" {mark}{words(r, r.randint(1, 9))}", f"{mark}."])
    if r.random() < 0.12:
        return f"<p><b>{text}<br>"
    if r.random() < 0.1:
        return f"<p>{text}"
    return f"<p>{text}</p>"


#: Names of class and id by part of a page, as sites use them.
NAMES = {
    "main": "content article post entry story main-content post-body text article-body body-copy richtext prose entry-content mainbody inhalt contenido contenu artikel texte".split(),
    "nav": "nav menu navbar main-nav top-menu breadcrumbs navigation toolbar pager pagination menue menü barra-nav skip".split(),
    "header": "header masthead site-header banner topbar kopf cabecera".split(),
    "footer": "footer site-footer foot copyright disclaimer fuss pie colophon".split(),
    "ad": "ad ads advert sponsored promo banner-ad adv advertisement outbrain promoted werbung anuncio".split(),
    "side": "sidebar widget related teaser recommended recommendations side-col barra-lateral".split(),
    "notice": "cookie-notice alert consent notice gdpr modal popup cookies hinweis aviso".split(),
    "form": "newsletter signup login search subscribe community anmeldung".split(),
    "comments": "comments replies disqus respond shoutbox kommentare comentarios".split(),
    "reply": "comment reply kommentar".split(),
    "share": "share social tags byline meta sharing author bio autor".split(),
    "box": "wrapper container page row col-6 flex mt-4 inner outer grid clearfix css-1ab2 x".split(),
}


def boilerplate(r: random.Random) -> dict[str, str]:
    def wrap(semantic: str, part: str, inner: str) -> str:
        a, b = tagged(r, semantic.split(), NAMES[part])
        return a + inner + b

    plain = lambda n: r.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(words(r, r.randint(2, n)))
    return {
        "nav": wrap("nav", "nav", links(r, r.randint(3, 9))),
        "header": wrap("header", "header", f"<h1>{words(r, 3)}</h1>" + plain(8)),
        "footer": wrap("footer", "footer", "&copy; " + words(r, r.randint(3, 25)) + r.choice(["", links(r, 3)])),
        "ad": wrap("", "ad", plain(40)),
        "side": wrap("aside", "side", f"<h3>{words(r, 2)}</h3>" + r.choice([links(r, 5), paragraph(r, "", 5, 40)])),
        "notice": wrap("", "notice", plain(40) + "<button>Ok</button>"),
        "form": wrap("form", "form", f"<label>{words(r, 3)}</label><input name=q>" + plain(12)),
        "comments": wrap("", "comments", "".join(wrap("", "reply", f"<b>{words(r, 1)}</b>" + paragraph(r, "", 4, 60)) for _ in range(r.randint(1, 5)))),
        "share": wrap("", "share", links(r, 3)),
    }


def body_of(r: random.Random, part: dict[str, str]) -> list[str]:
    """The blocks of a main text, MARK in each stretch, with an advert between them now and then."""
    body = [f"<h1>{MARK}{words(r, r.randint(2, 12))}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
        x = r.random()
        if x < 0.84:
            body.append(paragraph(r, MARK))
        elif x < 0.89:
            body.append(f"<h2>{MARK}{words(r, 4)}</h2>")
        elif x < 0.93:
            body.append("<ul>" + "".join(f"<li>{MARK}{words(r, r.randint(3, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif x < 0.96:
            body.append(f"<blockquote>{paragraph(r, MARK)}</blockquote>")
        elif x < 0.98:
            body.append(f"<pre>{MARK}{words(r, 12)}</pre>")
        else:
            body.append("<table>" + "".join(f"<tr><td>{MARK}{words(r, 2)}</td><td>{MARK}{words(r, 2)}</td></tr>" for _ in range(3)) + "</table>")
        if r.random() < 0.08:
            body.append(part["ad"] or part["share"])
    return body


def semantic(r: random.Random, part: dict[str, str]) -> str:
    """Parts one after the other, each in a tag or a box that says what it is."""
    a, b = tagged(r, ["article", "article", "main"], [*NAMES["main"], ""])
    inner = a + "".join(body_of(r, part)) + b
    if r.random() < 0.3:
        a, b = tagged(r, ["main"], NAMES["box"])
        inner = a + r.choice([part["side"], part["nav"], ""]) + inner + r.choice([part["comments"], part["side"], ""]) + b
    return "".join([part["notice"], part["header"], part["nav"], part["ad"], inner, part["share"], part["form"], part["side"], part["comments"], part["footer"]])


def soup(r: random.Random, part: dict[str, str]) -> str:
    """Every part and paragraph in boxes within boxes whose names say nothing."""

    def boxed(x: str) -> str:
        for _ in range(r.randint(0, 3)):
            x = f'<div class="{r.choice(NAMES["box"])}">{x}</div>'
        return x

    inner = [boxed(x.replace("<p>", "<div>").replace("</p>", "</div>") if r.random() < 0.5 else x) for x in body_of(r, part)]
    main = f'<div class="{r.choice(NAMES["main"] + NAMES["box"])}">{"".join(inner)}</div>'
    return "".join(boxed(x) for x in [part["header"], part["nav"], part["notice"], boxed(main), part["share"], part["side"], part["form"], part["comments"], part["footer"]] if x)


def tables(r: random.Random, part: dict[str, str]) -> str:
    """Columns of a layout table."""
    cells = [part["nav"], f"<font size=2>{''.join(body_of(r, part))}</font>" if r.random() < 0.5 else "".join(body_of(r, part)), part["side"] + part["ad"]]
    row = "".join(f"<td{r.choice(['', ' valign=top', ' width=150'])}>{x}" + r.choice(["</td>", ""]) for x in cells)
    return f"<center>{part['header']}</center><table><tr>{row}</tr></table>{part['form']}{part['comments']}<hr>{part['footer']}"


def flat(r: random.Random, part: dict[str, str]) -> str:
    """A main text without a box of its own."""
    return "".join([part["nav"], part["header"], part["notice"], *body_of(r, part), part["share"], part["comments"], part["form"], part["footer"]])


def foreign(r: random.Random, part: dict[str, str]) -> str:
    return r.choice([semantic, soup])(r, part)


FAMILIES = {f.__name__: f for f in (semantic, soup, tables, flat, foreign)}


def page(r: random.Random, family: str | None = None) -> str:
    """A page whose main text carries MARK in each of its stretches."""
    family = family or r.choice([*FAMILIES, "semantic", "semantic", "semantic"])
    _script[:] = [r.choice(SCRIPTS)] if family == "foreign" else []
    part = boilerplate(r)
    for k in list(part):
        if r.random() < (0.2 if k in ("nav", "footer", "ad") else 0.6):
            part[k] = ""
    head = f"<!DOCTYPE html><html><head><title>{words(r, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    out = head + FAMILIES[family](r, part) + r.choice(["</body></html>", ""])
    _script.clear()
    return out


def labelled(source: str, odds: list[float]) -> tuple[Page, np.ndarray]:
    """The page, and whether each node's subtree has main text."""
    p = Page(source, odds)
    y = np.array([MARK in t for t in p.text])
    p.text = [t.replace(MARK, "") for t in p.text]
    for i in range(len(y) - 1, 0, -1):
        y[p.parent[i]] |= y[i]
    return p, y


def token_odds(sources: list[str]) -> list[float]:
    """Log odds that a node with a token of the bucket holds main text, against those of nodes with any token."""
    main, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for s in sources:
        p, y = labelled(s, [0.0] * BUCKETS)
        for buckets, label in zip(p.tokens, y, strict=True):
            for i in buckets:
                every[i] += 1
                main[i] += label
    base = np.log((main.sum() + 1) / (every.sum() - main.sum() + 1))
    return [round(float(x), 3) for x in np.where(every > 0, np.clip(np.log((main + 1) / (every - main + 1)) - base, -6, 6), 0.0)]


def rows_of(sources: list[str], odds: list[float]) -> tuple[np.ndarray, np.ndarray]:
    parts = [labelled(s, odds) for s in sources]
    return np.concatenate([p.features() for p, _ in parts]), np.concatenate([y for _, y in parts]).astype(float)


def fitted(sources: list[str]) -> dict:
    """The model of some pages, in any order."""
    odds = token_odds(sources[::2])
    return train(*rows_of(sources[1::2], odds), trees=120, depth=5) | {"tokens": odds}


def accuracy(model: dict, sources: list[str]) -> float:
    x, y = rows_of(sources, model["tokens"])
    return float(((logits(model, x) > 0) == (y > 0)).mean())


def pages(seed: int, n: int, families: list[str] | None = None) -> list[str]:
    r = random.Random(seed)
    return [page(r, r.choice(families) if families else None) for _ in range(n)]


if __name__ == "__main__":
    for held_out in FAMILIES:
        others = [f for f in FAMILIES if f != held_out]
        print(f"{held_out}: accuracy {accuracy(fitted(pages(3, 800, others)), pages(4, 200, [held_out])):.4f} by a model of the other families", flush=True)
    model = fitted(pages(1, N_PAGES))
    MODEL.write_text(json.dumps(model))
    print(f"held-out pages of all families: accuracy {accuracy(model, pages(2, 400)):.4f}")
