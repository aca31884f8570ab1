"""Mail decoding against the standard library, and on broken mails."""

import email
import email.policy
from email.message import EmailMessage

import pytest

from knotwork.llm.mail import html_text, text_parts, texts


def make(plain, rich=None, attachment=None, encoding=None):
    m = EmailMessage()
    m["From"], m["Subject"] = "a@b.example", "s"
    m.set_content(plain, cte=encoding)
    if rich:
        m.add_alternative(rich, subtype="html", cte=encoding)
    if attachment:
        m.add_attachment(attachment, filename="x.txt")
    return m.as_string()


@pytest.mark.parametrize("encoding", ["quoted-printable", "base64", "8bit"])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_against_standard_library(encoding, ends):
    raw = make("Grüße = an\nalle " + "x" * 90 + "\n", "<p>Gr&uuml;&szlig;e <b>a</b>n</p>", "do not read", encoding).replace("\n", ends)
    m = email.message_from_string(raw, policy=email.policy.default)
    want = [p.get_content() for p in m.walk() if p.get_content_type() in ("text/plain", "text/html") and not p.is_attachment()]
    assert [t.replace("\r\n", "\n").strip() for _, t in text_parts(raw)] == [w.replace("\r\n", "\n").strip() for w in want]


def test_broken():
    assert text_parts(None) == text_parts("") == []
    assert texts("no headers at all") == ["no headers at all"]
    cut = 'Content-Type: multipart/mixed;\n boundary="b"\n\n--b\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQ'
    assert texts(cut) == ["hello world"]
    assert texts("Content-Type: multipart/mixed\n\n--zz\n\nhi\n--zz--\n") == ["hi"]
    assert texts("Content-Type: image/png\n\nabc") == []
    assert texts("Subject: only a head") == [""]
    assert texts('Content-Type: text/plain; charset="no-such"\nContent-Transfer-Encoding: quoted-printable\n\n=C3=A4') == ["ä"]


def test_html():
    assert html_text("a<b>b</b>c<br>d&amp;e<!-- x --><style>y</style>").split() == ["abc", "d&e"]
    assert html_text("1 < 2 and <broken") == "1 < 2 and <broken"
