"""Raw mails to text: the parts meant to be read, decoded, without a full MIME library.

Written for speed over a crawl: a few regular expressions per mail, no object per header. Broken mails are the
rule: a missing end mark ends the last part with the mail, a cut base64 body gives what decodes, a body without
headers is plain text.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_HEADER = re.compile(
    r"^content-(type|transfer-encoding|disposition)[ \t]*:[ \t]*([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)", re.I | re.M
)
_HEADER_LINE = re.compile(r"(?:From |[!-9;-~]+[ \t]*:)")
_BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\r\n]*)"?|([^\s;"]+))', re.I)
_CHARSET = re.compile(r'charset[ \t]*=[ \t]*"?([\w.:-]+)', re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
# Tags within a word or sentence; any other tag separates.
_INLINE = re.compile(
    r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>")

MAX_DEPTH = 32


def _charset(kind: str) -> str:
    found = _CHARSET.search(kind)
    if found:
        try:
            return codecs.lookup(found[1]).name
        except LookupError:
            pass
    return "utf-8"


def _decode(body: str, encoding: str, kind: str) -> str:
    if encoding == "base64":
        clean = _NOT_BASE64.sub("", body)
        clean = clean[: len(clean) - (len(clean) % 4 == 1)]
        try:
            return binascii.a2b_base64(clean + "=" * (-len(clean) % 4)).decode(_charset(kind), "replace")
        except (binascii.Error, ValueError):
            return ""
    if encoding == "quoted-printable":
        return binascii.a2b_qp(body.encode("utf-8", "replace")).decode(_charset(kind), "replace")
    return body


def _split(body: str, kind: str) -> list[str]:
    found = _BOUNDARY.search(kind)
    mark = (found[1] or found[2] or "").rstrip() if found else ""
    if not mark:
        first = re.search(r"^--(\S+)[ \t]*\r?$", body, re.M)
        if not first:
            return []
        mark = first[1]
    pieces = re.split(r"(?:\A|\r?\n)--" + re.escape(mark) + r"(--)?[ \t]*(?=\r?\n|\Z)", body)
    parts = []
    for i in range(2, len(pieces), 2):
        if pieces[i - 1]:  # the end mark; what follows is no part
            break
        parts.append(re.sub(r"\A\r?\n", "", pieces[i]))
    return parts


def text_parts(raw: str | None) -> list[tuple[str, str]]:
    """(kind, text) of every readable part, 'plain' or 'html', with its transfer encoding undone.

    Attachments and other types are left out, nested multiparts and inline messages opened. Null gives none.
    """
    out: list[tuple[str, str]] = []
    if not raw:
        return out
    todo = [(raw, 0)]
    while todo:
        entity, depth = todo.pop()
        if depth and entity[:1] in ("\r", "\n"):
            head, body = "", entity.lstrip("\r").removeprefix("\n")
        elif not depth and not _HEADER_LINE.match(entity):
            head, body = "", entity
        else:
            end = _BLANK.search(entity)
            head, body = (entity[: end.start()], entity[end.end() :]) if end else (entity, "")
        fields: dict[str, str] = {}
        for name, value in _HEADER.findall(head):
            fields.setdefault(name.lower(), value)
        kind = fields.get("type", "text/plain").strip()
        low = kind.lower()
        if fields.get("disposition", "").lstrip()[:10].lower() == "attachment":
            continue
        if low.startswith("multipart/"):
            parts = _split(body, kind)
            if parts and depth < MAX_DEPTH:
                todo.extend((p, depth + 1) for p in reversed(parts))
            elif not parts:
                out.append(("plain", body))
        elif low.startswith("message/rfc822"):
            if depth < MAX_DEPTH:
                todo.append((body, depth + 1))
        elif low.startswith("text/html"):
            out.append(("html", _decode(body, fields.get("transfer-encoding", "").strip().lower(), kind)))
        elif low.startswith("text/plain") or not low:
            out.append(("plain", _decode(body, fields.get("transfer-encoding", "").strip().lower(), kind)))
    return out


def html_text(markup: str) -> str:
    """Text of HTML: tags and entities resolved; comments, scripts and styles are no text."""
    if "<!--" in markup or "<s" in markup or "<S" in markup:
        markup = _HIDDEN.sub(" ", markup)
    return html.unescape(_TAG.sub("\n", _INLINE.sub("", markup)))


def texts(raw: str | None) -> list[str]:
    """The text of every readable part."""
    return [html_text(t) if kind == "html" else t for kind, t in text_parts(raw)]
