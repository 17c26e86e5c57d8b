"""Labelled web pages of varied layout, put together by rule: the content stands between [[ and ]], boilerplate in it between {{ and }}."""

from __future__ import annotations

import random

_SENTENCES = (
    "Most of the river towns kept their old mills, and the water that once drove them now runs past gardens and quiet yards.",
    "Visitors come in spring, when the banks are green; by autumn the boats are stored and the mills stand almost empty again.",
    "Nobody could say when the bridge was built.",
    "The council paid for new piers twice, and twice the ice took them before the first summer was over.",
    "A short line closes the part.",
    "What remains is a low wall, a row of willows and the sound of the weir at night.",
    "Year by year the catch grew smaller, so the fishermen sold their nets and bought goats instead.",
)
_LABELS = ("Home", "News", "Sport", "About us", "Contact", "Prices", "Help", "Shop", "All topics", "Archive", "Imprint", "Log in")
_ASIDES = ("Buy now and save", "We use cookies on this site", "Subscribe to our weekly letter", "Follow us", "Also of interest", "Most read", "Your opinion counts", "Share this page")

# Elements around and inside articles as sites write them: (element, attributes).
_CONTENT = (
    ("article", ""), ("article", 'class="post"'), ("article", 'class="entry h-entry"'), ("main", ""), ("main", 'role="main"'), ("main", 'id="content"'), ("div", 'class="article-body"'),
    ("div", 'class="entry-content"'), ("div", 'class="post-content"'), ("div", 'id="main"'), ("div", 'class="content"'), ("div", 'class="story"'), ("section", 'class="text"'), ("div", ""), ("td", ""),
)
_INNER = (
    ("div", 'class="lead"'), ("figure", ""), ("figure", 'class="image"'), ("section", ""), ("div", 'class="alert"'), ("div", 'class="note"'), ("section", 'class="part left"'), ("div", 'class="inner"'), ("div", 'class="box"'), ("div", 'class="list"'),
    ("blockquote", ""), ("header", ""), ("header", 'class="entry-header"'), ("footer", 'class="references"'), ("div", 'class="abstract"'), ("div", 'class="caption right"'), ("aside", 'class="footnote"'), ("div", 'class="top"'), ("div", 'class="bottom"'),
)
_BOILER = (
    ("nav", ""), ("nav", 'class="main-nav"'), ("nav", 'role="navigation"'), ("header", ""), ("header", 'class="site-header"'), ("header", 'id="masthead"'), ("div", 'id="header"'), ("div", 'class="header"'), ("div", 'class="navbar"'),
    ("div", 'class="menu"'), ("ul", 'class="menu"'), ("ul", 'class="nav"'), ("div", 'class="navigation"'), ("div", 'class="breadcrumb"'), ("ol", 'class="breadcrumbs"'), ("div", 'class="topbar"'), ("div", 'class="toolbar"'),
    ("footer", ""), ("footer", 'class="site-footer"'), ("div", 'id="footer"'), ("div", 'class="footer"'), ("div", 'class="page-footer"'), ("div", 'role="contentinfo"'),
    ("aside", ""), ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="side-bar"'), ("div", 'role="complementary"'), ("div", 'class="widget"'), ("div", 'class="widget-area"'),
    ("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'), ("div", 'class="ad-banner"'), ("div", 'class="ad-slot"'), ("div", 'id="ad-top"'), ("div", 'class="banner"'), ("div", 'class="banner-ad"'), ("div", 'class="promo"'), ("div", 'class="promotion"'),
    ("div", 'class="sponsored"'), ("div", 'class="sponsor"'), ("section", 'class="ad"'), ("p", 'class="ad"'), ("ins", 'class="adsbygoogle"'),
    ("div", 'class="cookie-notice"'), ("div", 'class="cookie-banner"'), ("div", 'id="cookie-consent"'), ("div", 'class="cookies"'), ("div", 'class="consent"'), ("div", 'class="notice"'), ("p", 'class="notice"'), ("div", 'class="notices"'), ("div", 'class="site-notice"'), ("div", 'class="gdpr"'), ("div", 'class="alert"'), ("div", 'role="alert"'),
    ("div", 'class="popup"'), ("div", 'class="modal"'), ("div", 'role="dialog"'), ("dialog", ""), ("div", 'class="paywall"'), ("div", 'class="newsletter"'), ("div", 'class="newsletter-signup"'), ("div", 'class="subscribe"'), ("div", 'class="signup"'),
    ("form", ""), ("form", 'class="search"'), ("div", 'class="search"'), ("div", 'class="search-form"'), ("div", 'role="search"'), ("div", 'class="login"'), ("form", 'class="login-form"'), ("button", ""), ("select", ""), ("label", ""), ("menu", ""), ("object", ""), ("audio", ""), ("video", ""), ("canvas", ""), ("map", ""),
    ("div", 'class="share"'), ("div", 'class="sharing"'), ("div", 'class="share-buttons"'), ("ul", 'class="social"'), ("div", 'class="social"'), ("figure", 'class="social"'), ("div", 'class="social-links"'), ("div", 'class="social-share"'),
    ("div", 'class="related"'), ("section", 'class="related-posts"'), ("div", 'class="related-articles"'), ("div", 'class="recommended"'), ("div", 'class="recommendations"'), ("div", 'class="read-more"'), ("div", 'class="pagination"'), ("div", 'class="pager"'), ("div", 'class="tags"'), ("div", 'class="skip-link"'),
    ("section", 'class="comments"'), ("section", 'id="comments"'), ("div", 'id="comments"'), ("div", 'class="comments"'), ("div", 'class="comment"'), ("article", 'class="comment"'), ("li", 'class="comment"'), ("ol", 'class="comment-list"'), ("div", 'class="commentlist"'), ("div", 'class="comments-area"'), ("div", 'class="comment-form"'),
    ("div", 'id="disqus_thread"'), ("div", 'class="disqus"'), ("div", 'id="respond"'), ("div", 'class="replies"'), ("div", 'class="reply"'), ("div", 'class="comment-section"'), ("div", 'class="reader-comments"'), ("div", 'class="user-comments"'),
)
# Parts of running text, lists and tables, and headings, with the names that sites give boilerplate elsewhere.
_INLINE = (("span", 'class="share"'), ("em", 'class="related"'), ("a", 'class="comment-link" href="/c"'), ("strong", 'class="ad"'), ("span", 'class="notice"'), ("b", ""), ("abbr", 'class="header"'))
_HEADINGS = (("h2", 'class="banner"'), ("h3", 'class="header"'), ("h2", 'class="menu"'), ("h4", ""))
_CELLS = ('class="header"', 'class="footer"', 'class="ad"', "")
_UNKNOWN = ("user-responses", "kommentare", "opiniones", "lectores", "zuschriften", "avis", "stimmen")
_WRAPPERS = (("div", ""), ("div", 'id="page"'), ("div", 'class="wrapper"'), ("div", 'class="container"'), ("div", 'class="site"'), ("div", 'class="row"'), ("div", 'class="layout main-layout"'), ("div", 'class="column main-column"'), ("div", 'class="area"'), ("div", 'class="section"'), ("div", 'class="block"'), ("div", 'class="site-content"'), ("section", ""))


def _element(kind: tuple[str, str], inside: str) -> str:
    name, attributes = kind
    return f"<{name}{' ' if attributes else ''}{attributes}>{inside}</{name}>"


def labelled_pages(count: int = 600, seed: int = 11) -> list[str]:
    """``count`` pages, and a fourth as many of ``_part_pages``: a wrapper, boilerplate around the content, and some inside it."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join(rng.choice(_SENTENCES) for _ in range(rng.randint(a, b)))
    link = lambda text: f"<a href='/{rng.randint(1, 999)}'>{text}</a>"

    def boilerplate(k: int) -> str:
        kind = rng.choice(_BOILER) if k % 2 else _BOILER[k // 2 % len(_BOILER)]
        linked = rng.random() < 0.6
        inside = "".join(f"<li>{link(x)}</li>" for x in rng.sample(_LABELS, rng.randint(2, 6))) if linked else f"{rng.choice(_ASIDES)} {link(rng.choice(_LABELS))}"
        if "omment" in kind[1] or "repl" in kind[1]:
            inside = f"<p>{say(1, 2)}</p>"
        return _element(kind, f"<ul>{inside}</ul>" if linked and kind[0] not in ("ul", "ol") else inside)

    def block(k: int, in_article: bool) -> str:
        kind = rng.random()
        if kind < 0.5:
            return f"<p>{say(1, 4)}</p>"
        if kind < 0.6:
            return f"<p>{say(1, 2)} {link('a mill')} {say(1, 1)}<br>{say(1, 1)}</p>"
        if kind < 0.7:
            return f"<ul><li>{say(1, 1)}</li><li>{link('A list of mills')}</li></ul>"
        if kind < 0.75:
            return f"<table><tr><td>Year</td><td>{say(1, 1)}</td></tr></table>"
        kind = _INNER[k % len(_INNER)]
        if kind == ("header", "") and not in_article:
            kind = ("div", "")
        return _element(kind, f"<p>{say(1, 2)}</p>")

    pages = []
    for k in range(count):
        container = _CONTENT[k % len(_CONTENT)]
        inner = [block(3 * k + j, container[0] in ("article", "main")) for j in range(rng.randint(1, 4))]
        blocks = [f"<h1>{rng.choice(_SENTENCES)[:24]}</h1>", f"<p>{say(2, 4)}</p>", *inner, f"<p>{say(2, 3)}</p>"]
        if k % 3 == 0:
            blocks.insert(rng.randint(1, len(blocks) - 1), "{{" + boilerplate(2 * k) + "}}")
        before = "".join(boilerplate(2 * k + j) for j in range(rng.randint(0, 3)))
        after = "".join(boilerplate(2 * k + 1 + j) for j in range(rng.randint(0, 3)))
        if k % 5 == 0:  # links and calls that no element or class names
            before += "<div>" + " ".join(link(x) for x in rng.sample(_LABELS, 4)) + "</div>"
            after += f"<div>{link(rng.choice(_ASIDES))} {link('Next')}</div>"
        content = _element(container, "[[" + "".join(blocks) + "]]")
        if container[0] == "td":
            content = f"<table><tr><td>{boilerplate(k)}</td>{content}</tr></table>"
        pages.append(f"<html><head><title>{rng.choice(_LABELS)}</title></head><body>{_element(_WRAPPERS[k % len(_WRAPPERS)], before + content + after)}</body></html>")
    return pages + _part_pages(count // 4, seed)


def _part_pages(count: int, seed: int) -> list[str]:
    """Pages whose articles have parts with the names of boilerplate, and comments behind them under names of the site's own."""
    rng = random.Random(f"parts {seed}")
    say = lambda a, b: " ".join(rng.choice(_SENTENCES) for _ in range(rng.randint(a, b)))
    pages = []
    for k in range(count):
        parts = [
            f"<p>{say(1, 1)} {_element(_INLINE[k % len(_INLINE)], 'a word of it')} {say(1, 1)}</p>",
            _element(_HEADINGS[k % len(_HEADINGS)], "A part of the whole") + f"<p>{say(1, 2)}</p>",
            f"<table><tr><th {_CELLS[k % 4]}>Year</th><td {_CELLS[(k + 1) % 4]}>{say(1, 1)}</td></tr></table>",
            f"<ul><li class='ad'>{say(1, 1)}</li><li class='comment'>{say(1, 1)}</li></ul>",
        ]
        inside = f"<h1>{rng.choice(_SENTENCES)[:24]}</h1><p>{say(2, 4)}</p>" + "".join(rng.sample(parts, rng.randint(1, 4))) + f"<p>{say(2, 3)}</p>"
        entries = "".join(f"<div class='entry{j}'><b>A reader</b> <time>2021-05-0{j + 1}</time><p>{say(1, 2)}</p></div>" if k % 2 else f"<p>{say(1, 1)}</p>" for j in range(rng.randint(2, 4)))
        after = f"<div class='{_UNKNOWN[k % len(_UNKNOWN)]}'>{entries}</div>" if k % 3 else ""
        container = ("div", 'class="posts"') if k % 5 == 0 else _CONTENT[k % 2]
        nav = _element(rng.choice(_BOILER[:17]), "".join(f"<a href='/'>{x}</a> " for x in rng.sample(_LABELS, 4)))
        pages.append(f"<html><head><title>{rng.choice(_LABELS)}</title></head><body>{_element(_WRAPPERS[k % len(_WRAPPERS)], nav + _element(container, f'[[{inside}]]') + after)}</body></html>")
    return pages
