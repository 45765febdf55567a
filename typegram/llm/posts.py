"""Words of forum posts: clean text, the author's own part, sentences.

Markup tags, entities and invisible characters are neither words nor breaks: entities become what they stand for, tags
of blocks become white space, other tags and invisible characters go. Own text is what remains without quotations
(block tags, prefixed lines, their attributions) and signatures.
"""

from __future__ import annotations

import html
import re
import unicodedata

import regex

BLOCK = r"br|p|div|hr|blockquote|cite|li|ul|ol|tr|td|table|h[1-6]|quote|attachment"
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});")
_BLOCK_TAG = re.compile(rf"</?(?:{BLOCK})\b[^<>]*>|\[/?(?:{BLOCK})(?:=[^\[\]\n]*)?\]", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][\w-]*(?:\s[^<>]*|/)?>|\[/?(?:b|i|u|s|url|img|color|size|font|code|center|list|spoiler)(?:=[^\[\]\n]*)?\]|\[\*\]", re.S | re.I)
_INVISIBLE = regex.compile(r"\x1b\[[0-9;]*[A-Za-z]|[\p{Cf}\p{Co}\p{Cn}︀-️]|[^\P{Cc}\t\n\r]")
WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "<" in text or "[" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii() or not text.isprintable():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return text


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(clean(text))]


_QUOTE = re.compile(r"\[(/?)quote(?:=[^\]\n]*)?\]|<(/?)blockquote[^<>]*>", re.I)
_PREFIXED = re.compile(r"^[ \t]*(?:>|:(?=[ \t>:]|$)|\|(?=[ \t]|$)).*$", re.M)
_ATTRIBUTION = re.compile(r"^[ \t]*(?:On .{1,60} wrote|[\w.~-]{1,40} wrote|.{1,40} (?:schrieb|escribió|a écrit)|@[\w.]+)[ \t]*:?[ \t]*$", re.M)
_SIGNATURE = re.compile(r"^[ \t]*(?:-- ?|_{5,}|~[\w.]+~.*|sent from my .*|\*\*\*.*)[ \t]*$", re.M | re.I)
_RULED = re.compile(r"<hr\b[^<>]*>\s*<small>.*?(?:</small>|\Z)", re.S | re.I)
_LINE_BREAK = re.compile(r"[ \t]*<br\s*/?>[ \t]*\r?\n?|<p\b[^<>]*>|\r\n?", re.I)


def unquoted(text: str) -> str:
    """Text without block quotations; one that never closes ends with the last closing tag, or with the text."""
    out, depth, start, last, outer = [], 0, 0, None, 0
    for m in _QUOTE.finditer(text):
        closing = bool(m.group(1) or m.group(2))
        if not closing:
            if depth == 0:
                out.append(text[start:m.start()])
                outer = m.start()
            depth += 1
        else:
            last = m.end()
            if depth:
                depth -= 1
                if depth == 0:
                    start = m.end()
    if depth == 0:
        out.append(text[start:])
    elif last is not None and last > outer:
        out.append(text[last:])
    return "\n".join(out)


def own(text: str) -> str:
    text = _LINE_BREAK.sub("\n", unquoted(text))
    text = _ATTRIBUTION.sub("", _PREFIXED.sub("", text))
    text = _RULED.sub("", text)
    m = _SIGNATURE.search(text)
    return clean(text[:m.start()] if m else text)


_DOTS = re.compile(r"(?:[ \t]*[.…。]){3,}|[.…]{2,}")
_END = re.compile(r"[.!?。]+(?:\s+|$)|\n+|¿|¡")


def sentences(text: str) -> list[str]:
    """Ends are . ! ? and line ends; several dots in a row are a pause."""
    text = _DOTS.sub(" ,", text).replace("…", ".")
    return [s for s in _END.split(text) if s and s.strip()]
