"""Readable text, title and links of HTML, in one pass over the markup.

Every pattern matches at the place where it is tried, through to the end of the text where its own end is missing, and gives
nothing back, so the time grows with the length of any markup, however broken.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Elements that a head may hold; any other start tag ends it.
HEAD_PARTS = frozenset("head html base basefont bgsound link meta title noscript noframes script style template".split())

#: A tag's rest: a quote counts only behind an equals sign, and a quoted value may hold ``>``.
_REST = r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"""
#: In this order: a comment, an element whose content is no markup (name, rest, content), a tag (slash, name, rest), another declaration.
TOKEN = re.compile(
    r"<!--(?:-?>|(?>.*?(?:--!?>|\Z)))"
    r"|<(script|style|xmp|iframe|noembed|noframes|noscript|title|textarea)(?=[\s/>]|\Z)" + _REST + r"(?>(.*?)(?=</\1[\s/>]|\Z))"
    r"|<(/?)([a-z][^\s/>]*+)" + _REST +
    r"|<(?:[!?]|/(?=[^a-z]))[^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>]*+))?""")
SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
#: Character numbers of any length: leading zeros count for nothing, and nothing of eight digits or more is a character.
LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,});?")
ZEROS = re.compile(r"&#0++(?=[0-9])")


@dataclass
class Page:
    """What a page shows: its text, one line per block; its title, None without one; the addresses it links to, in order."""

    text: str
    title: str | None
    links: list[str]


def unescape(text: str) -> str:
    """References resolved, also those of numbers too long for an integer."""
    if "&#" in text:
        text = ZEROS.sub("&#", LONG_NUMBER.sub("�", text))
    return html.unescape(text) if "&" in text else text


def link_of(rest: str) -> str | None:
    """The first ``href`` with a value among a tag's attributes."""
    for name, value in ATTRIBUTE.findall(rest):
        if name.lower() == "href":
            return unescape(value.strip("\"'")) if value else None
    return None


def read_page(markup: str) -> Page:
    """One pass over a whole page.

    Scripts, styles, frames, comments, templates, ``noscript`` and what stands in the head are hidden; a title or a text area
    holds no tags. A tag, a comment or a quoted value without end hides the rest, as in browsers. ``<`` before anything but a
    letter, ``/``, ``!`` or ``?`` is text.
    """
    shown: list[str] = []
    links: list[str] = []
    title, templates, in_head, at = None, 0, False, 0
    for token in TOKEN.finditer(markup):
        if token.start() > at and not templates and not in_head:
            shown.append(unescape(markup[at:token.start()].replace("\n", " ")))
        at = token.end()
        raw, _, content, slash, name, rest = token.groups()
        if name is not None:
            name = name.lower()
            if name == "template":
                templates = max(0, templates - 1) if slash else templates + 1
                shown.append(" ")
            elif templates:
                continue
            elif name == "head":
                in_head = not slash
                shown.append(" ")
            else:
                if in_head and not slash and name not in HEAD_PARTS:
                    in_head = False
                if name in BLOCKS:
                    shown.append("\n")
                elif name == "a" and not slash and (link := link_of(rest)) is not None:
                    links.append(link)
        elif raw is not None and raw.lower() in ("title", "textarea") and not templates:
            if raw.lower() == "textarea":
                in_head = False
                shown.append(unescape(content.replace("\n", " ")))
            elif title is None:
                title = unescape(content)
        else:
            shown.append(" ")
    if not templates and not in_head:
        shown.append(unescape(markup[at:].replace("\n", " ")))
    text = LINES.sub("\n", SPACES.sub(" ", "".join(shown))).strip(" \n")
    return Page(text, title, links)
