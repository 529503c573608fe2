"""Labelled pages the block model is trained on: layouts by hand, filled with seeded invented words."""

from __future__ import annotations

import random
import re

#: Layouts. ``data-main`` marks elements whose text is main text; {n} stands for a text of about n words, {a:n} for one inside a link,
#: [x|lo-hi] repeats x.
LAYOUTS = (
    '<html><head><title>{6}</title></head><body><nav><ul>[<li>{a:1}</li>|3-8]</ul></nav><div class="ad">{9}</div><article><h1 data-main>{8}</h1>'
    '[<p data-main>{40}</p>|0-8][<p data-main>{3}</p>|0-2]<p data-main><b>{7}<br>[<p data-main>{30}</p>|0-4]</article><footer>&copy; {1} &middot; {9}</footer></body></html>',
    '<html><body><header><div class="logo">{a:1}</div><nav class="main-menu">[<a href="/x">{1}</a> |3-7]</nav></header><main><article><header><h1 data-main>{8}</h1>'
    '<p class="byline">{4}</p></header>[<p data-main>{45}</p>|2-9]<h2 data-main>{4}</h2>[<p data-main>{35}</p>|1-4]<ul>[<li data-main>{9}</li>|0-5]</ul></article></main>'
    '<aside class="sidebar"><h3>{2}</h3><ul>[<li>{a:5}</li>|2-6]</ul></aside><section class="comments" id="comments"><h3>{2}</h3>[<div class="comment"><p>{22}</p></div>|1-6]</section>'
    '<footer><p>© 2020 {5}</p><ul>[<li>{a:2}</li>|2-4]</ul></footer></body></html>',
    '<html><body><div id="header"><h2>{2}</h2><ul class="nav">[<li>{a:1}</li>|3-8]</ul></div><div id="content"><h1 data-main>{7}</h1>[<p data-main>{38}</p>|2-9]'
    '[<p data-main>{4}</p>|0-2]<blockquote data-main>{15}</blockquote>[<p data-main>{25}</p>|0-3]</div><div id="sidebar"><h4>{2}</h4>[<p>{12}</p>|1-3]<ul>[<li>{a:4}</li>|2-5]</ul></div>'
    '<div id="footer"><p>&copy; {6}</p></div></body></html>',
    '<html><body><div class="cookie-notice"><p>{18}</p><button>{1}</button></div><div class="topbar">{a:2} {a:2}</div><div class="post"><h1 data-main>{6}</h1><div class="meta">{5}</div>'
    '<div class="post-body entry-content">[<p data-main>{42}</p>|2-8]<h3 data-main>{3}</h3>[<p data-main>{28}</p>|1-3]<div class="share-buttons">{a:1} {a:1} {a:1}</div></div></div>'
    '<div class="related-posts"><h3>{2}</h3><ul>[<li>{a:6}</li>|2-5]</ul></div><form class="newsletter"><p>{9}</p><input type="text"><button>{1}</button></form>'
    '<div id="comments" class="comment-list"><h3>{2}</h3><ol>[<li class="comment"><cite>{2}</cite><p>{25}</p></li>|1-6]</ol><form><label>{2}</label><textarea></textarea></form></div>'
    '<div class="footer">{8} All rights reserved.</div></body></html>',
    '<html><body><table class="layout"><tr><td class="menu">[<a href="/x">{2}</a><br>|4-8]</td><td class="content"><h1 data-main>{5}</h1>[<p data-main>{50}</p>|2-6]'
    '<table><tr><th data-main>{1}</th><th data-main>{1}</th></tr>[<tr><td data-main>{2}</td><td data-main>{2}</td></tr>|1-4]</table></td></tr></table><div class="bottom copyright">{7}</div></body></html>',
    '<html><body><nav role="navigation">[<a href="/x">{1}</a> |3-6]</nav><div class="advert banner"><p>{14}</p></div><article class="story"><h1 data-main>{9}</h1><p data-main class="lead">{20}</p>'
    '[<p data-main>{36}</p>|1-4]<aside class="promo"><p>{12}</p></aside>[<p data-main>{36}</p>|1-4]<figure><figcaption data-main>{8}</figcaption></figure><p data-main>Licensed under {5}</p><p data-main>All rights reserved.</p>'
    '<div class="ad sponsored">{11}</div><p data-main>{30}</p></article><footer class="site-footer"><p>{10}</p></footer></body></html>',
    '<html><body><div class="modal popup subscribe"><h2>{3}</h2><form><p>{8}</p><input></form></div><div class="breadcrumb">{a:1} {a:1} {a:2}</div><section class="main"><h1 data-main>{6}</h1>'
    '[<p data-main>{33}</p>|2-7]<pre data-main>{12}</pre><dl><dt data-main>{2}</dt><dd data-main>{9}</dd></dl></section><div class="notice alert"><p>{16}</p></div>'
    '<div class="widget"><h3>{2}</h3>[<p>{7}</p>|1-3]</div><div class="disclaimer legal"><p>{25}</p></div></body></html>',
    '<html><body><div>{a:1} {a:1} {a:1} {a:2}</div><h1 data-main>{6}</h1>[<p data-main>{40}</p>|1-7]<div>{a:3} {a:2} {a:3}</div><div>© {4}</div></body></html>',
    '<html><body><header><h1>{2}</h1><p>{5}</p></header><nav>[<a href="/x">{1}</a> |2-5]</nav><article><h2 data-main>{6}</h2>[<p data-main>{32}</p>|1-6][<p data-main>{1}</p>|0-2]<footer><p>{5}</p></footer></article>'
    '<section id="respond" class="reply-form"><h3>{2}</h3><form><p>{6}</p><label>{1}</label><input></form></section><div class="reader-comments discussion">[<article class="comment"><h4>{2}</h4><p>{18}</p></article>|1-5]</div><footer>{6}</footer></body></html>',
    '<article>[<p data-main>{25}</p>|0-3]<p data-main>{6}</p>[<p data-main>{2}</p>|0-2]</article>',
    '<body><h1 data-main>{5}</h1>[<p data-main>{30}</p>|1-5][<p data-main>{3}</p>|0-2]</body>',
    '<html><body><div class="gdpr consent banner"><p>{22}</p><a href="/x">{2}</a></div><main><h1 data-main>{7}</h1>[<div data-main>{40}</div>|2-6]<ol>[<li data-main>{12}</li>|0-4]</ol></main>'
    '<div hidden><p>{12}</p></div><div style="display:none">{9}</div><aside><div class="ads">{10}</div><p>{9}</p></aside><div class="social share">{a:1} {a:1}</div><footer><p>{14}</p></footer></body></html>',
)
_REPEAT = re.compile(r"\[((?:[^\[\]])*)\|(\d+)-(\d+)\]")
_TEXT = re.compile(r"\{(a:)?(\d+)\}")
_SYLLABLES = "ba co de fi gu la me no pa ri so tu ver zen lich que ment tion ing é ö ñ st".split()


def _words(rng: random.Random, about: int) -> str:
    n = max(1, about if about <= 2 else rng.randint(about // 2, about * 3 // 2))
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    if n >= 4 and rng.random() < 0.85 or rng.random() < 0.3:
        words[-1] += rng.choice(".....!?:")
    if rng.random() < 0.05:
        words = [w.upper() + "!!" for w in words]
    if rng.random() < 0.05:
        words = [w + rng.choice(("***", "&amp;&amp;", "%%%", " |")) for w in words]
    return " ".join([words[0].capitalize(), *words[1:]])


#: Parts of composed layouts: names an element may have, by what it holds. Fixed values.
TOP = "header masthead topbar navbar menu nav crumbs breadcrumb site-head logo skip-links toolbar search-box login".split()
SIDE = "sidebar rail widget related promo ad advert banner sponsored trending newsletter share social tag-cloud archive-list".split()
BOTTOM = "footer bottom site-foot legal copyright colophon sitemap disclaimer cookie-notice consent popup".split()
SAID = "comments comment-list replies discussion responses reactions".split()
MAIN = "content article story post entry main-text body-copy story-area page-body text".split()
PLAIN = "wrap container row col box inner outer grid section block c1 x2 css-1ab region layout".split()


def _named(rng: random.Random, tags: str, names: list[str]) -> tuple[str, str]:
    """An element's start and end tags, mostly with a name of its kind, else with one that says nothing or none."""
    tag, kind = rng.choice(tags.split()), rng.random()
    name = rng.choice(names) if kind < 0.6 else rng.choice(PLAIN) if kind < 0.8 else ""
    return f"<{tag}{f' {rng.choice(("class", "id"))}="{name}"' if name else ''}>", f"</{tag}>"


def _rest(rng: random.Random, names: list[str]) -> str:
    """What is no main text: links, short lines, a heading with a list."""
    a, b = _named(rng, "div section aside nav header footer" if rng.random() < 0.3 else "div ul section", names)
    if a.startswith("<ul"):
        return a + "".join(f"<li>{{a:{rng.randint(1, 4)}}}</li>" for _ in range(rng.randint(2, 7))) + b
    held = rng.choice(("[{a:2} |2-6]", "<ul>[<li>{a:3}</li>|2-6]</ul>", "<h3>{2}</h3><ul>[<li>{a:5}</li>|2-5]</ul>", "<p>{9}</p>", "<h4>{2}</h4><p>{14}</p>", "<p>{3}</p>{a:2}",
                       "<form><label>{1}</label><input><button>{1}</button></form>", "<span>{2}</span> {a:1} {a:1}", "<p>&copy; {5}</p>"))
    return a + held + b


def _composed(rng: random.Random) -> str:
    """A layout put together of named parts: rests above and below, main text of paragraphs, headings and lists between, comments at times."""
    said = ""
    if rng.random() < 0.35:
        a, b = _named(rng, "div section ol", SAID)
        said = a + "<h3>{2}</h3>" + "".join(f"<div class=\"comment\"><b>{{2}}</b><p>{{{rng.randint(6, 30)}}}</p></div>" for _ in range(rng.randint(1, 5))) + b
    above = "".join(_rest(rng, TOP) for _ in range(rng.randint(1, 3)))
    below = "".join(_rest(rng, SIDE) for _ in range(rng.randint(0, 3))) + said + "".join(_rest(rng, BOTTOM) for _ in range(rng.randint(1, 2)))
    pieces = ["<h1 data-main>{7}</h1>"] if rng.random() < 0.85 else []
    pieces += ['<p class="byline">{3}</p>'] if rng.random() < 0.2 else []
    paragraph = rng.choice(("<p data-main>{35}</p>", "<p data-main>{35}</p>", "<div data-main>{30}</div>"))
    for _ in range(rng.randint(2, 7)):
        pieces.append(rng.choice((
            paragraph, paragraph, paragraph, "<p data-main>{6}</p>", "<h2 data-main>{4}</h2>" + paragraph, "<blockquote data-main>{14}</blockquote>",
            "<ul>[<li data-main>{8}</li>|2-6]</ul>", "<ol>[<li data-main>{3}</li>|2-5]</ol>", "<ul>[<li data-main><b>{1}</b> {6}</li>|2-4]</ul>",
            "<table>[<tr><td data-main>{2}</td><td data-main>{1}</td></tr>|2-4]</table>", f"<p data-main>{{20}} {{a:2}} {{8}}</p>", _rest(rng, SIDE) if rng.random() < 0.3 else paragraph)))
    a, b = _named(rng, "article main div div section td", MAIN)
    body = a + "".join(pieces) + b
    for _ in range(rng.randint(0, 3)):
        a, b = _named(rng, "div section", PLAIN)
        whole = rng.random() < 0.5
        above, body, below = (a + above, body, below + b) if whole else (above, a + body + b, below)
    return f"<html><body>{above}{body}{below}</body></html>"


def composed_layouts(n: int, seed: int) -> list[str]:
    """``n`` layouts, each of its own make."""
    rng = random.Random(seed)
    return [_composed(rng) for _ in range(n)]


def labelled_pages(each: int = 24, seed: int = 11, composed: int = 300, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    """``each`` pages of every layout and one of every composed layout; a part of them cut off, stripped of class names or without a heading."""
    rng = random.Random(seed)
    out = []
    for layout in [*(x for x in layouts for _ in range(each)), *composed_layouts(composed, seed)]:
        page = layout
        while (m := _REPEAT.search(page)) is not None:
            page = page[: m.start()] + m[1] * rng.randint(int(m[2]), int(m[3])) + page[m.end() :]
        page = _TEXT.sub(lambda m: f'<a href="/x">{_words(rng, int(m[2]))}</a>' if m[1] else _words(rng, int(m[2])), page)
        if rng.random() < 0.15:
            page = re.sub(r"<h1[^>]*>.*?</h1>", "", page, count=1)
        if rng.random() < 0.1:
            page = page[: rng.randint(len(page) // 2, len(page))]
        out.append(page)
    return out
