"""Pages of keywords, links or product tags instead of sentences.

A mail's own text (no quotes, forwards, signature, disclaimer) is cut into blocks of about ``block`` bytes, without
regard to what is in them. A block is compressed against the rest of the mail's own text, so that what is said over
and over shows wherever it stands. Its ratio is measured by that expected of prose for the length of block and text
and the language. A block far below it is redundant to the extreme; it is spam if it also has hardly any sentence
ends, which tells notices that repeat whole sentences from strings of words. A mail is a case if more than half of its own words stand
in such blocks.

The expectation comes from the blocks with sentence ends of all documents: their median ratios by language and length
class, at most languages x classes rows, are aggregated in the cluster, and a power law of the two lengths, with a
factor per language that leans to 1 where there is little prose, is fitted to them. Beyond the lengths that prose
has, what holds for the longest of it is expected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.llm.mail import html_text, text_parts
from knotwork.session import spool

# How mail programs mark earlier mails, in the languages of the archive.
_QUOTED = re.compile(r"[ \t\xa0]*[>|]")
_WROTE = re.compile(
    r"(?:^|\b)(?:On\b.{4,120}\bwrote|Am\b.{4,120}\bschrieb\b.{0,80}|Le\b.{4,120}\ba écrit|El\b.{4,120}\bescribió)[ \t\xa0]*:[ \t\xa0]*$"
)
_FORWARD = re.compile(
    r"^[ \t\xa0]*(?:-{2,}[ \t\xa0]*(?:forwarded message|original message|begin forwarded message|weitergeleitete nachricht|"
    r"ursprüngliche nachricht|message transféré|message d'origine|mensaje reenviado|mensaje original)[ \t\xa0]*-{2,}|_{8,})[ \t\xa0]*$",
    re.I,
)
_HEAD = re.compile(r"^[ \t\xa0]*(?:From|Von|De|Sent|Gesendet|Envoyé|Enviado|Date|Datum|Fecha|To|An|À|Para|Subject|Betreff|Objet|Asunto)[ \t\xa0]?:[ \t\xa0]")
_SIGNATURE = re.compile(r"^--[ \t\xa0]*$")
_HTML_NOTE = re.compile(
    r"\b(?:view|viewed|read|shows?|display|displays|displayed|angezeigt|anzeigen|lesen|afficher|lire|ver|leer)\b.{0,80}\bhtml\b"
    r"|\bhtml\b.{0,80}\b(?:view|viewed|viewer|read|reader|shows?|display|angezeigt|anzeigen|afficher|lire|ver|leer)\b",
    re.I | re.S,
)
_DISCLAIMER = re.compile(
    r"^\s*confidential\b|\baddressee\b|accepts no liability|do not bind|intended recipient|irrtümlich|nur für den empfänger|"
    r"réservé à son destinataire|solo para su destinatario",
    re.I,
)
_SENT_FROM = re.compile(r"^\s*(?:sent from|von unterwegs gesendet|gesendet von|envoyé de|enviado desde)\b", re.I)
_BLOCKQUOTE = re.compile(r"<(/?)blockquote\b[^>]*>", re.I)

_PARAGRAPH = re.compile(r"\n[ \t\r\xa0]*\n")
#: A sentence ends with a mark, closing quotes or brackets, and a gap.
_END = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|\Z)")
_WORD = re.compile(r"[^\W_]+")
#: A word whose letters are set apart, as in "l.o.a.n" or "p.e.t. .f.o.o.d".
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_][.*_-]+(?:[ \xa0\n][.*_-]+)?){2,}[^\W\d_](?![^\W_])")
_MARKS = re.compile(r"[.*_-]")
#: A word with digits for letters; prices and plain numbers have no letter on both sides of it.
_LEET = re.compile(r"\b(?=\w*\d)(?=\w*[a-z])[a-z0-9]+\b")
# The digits that stand for letters.
_LETTERS = str.maketrans("013457", "oieast")

BLOCKS = "doc_id long, lang string, blocks array<struct<words: int, ends: int, size: int, whole: int, ratio: float>>"


@dataclass(frozen=True)
class Spam:
    """Blocks of about ``block`` bytes see ``context`` bytes on either side.

    A block is redundant if its ratio is at most ``below`` times that expected; it has hardly any punctuation with
    fewer than ``ends`` sentence ends a word, others are prose. ``share`` of a mail's own words in such blocks make
    it a case. A language's factor counts fully against ``lean`` blocks of prose that say 1.
    """

    block: int = 192
    context: int = 16384
    below: float = 0.75
    ends: float = 0.04
    share: float = 0.5
    lean: int = 50


def _without_blockquotes(markup: str) -> str:
    out, depth, at = [], 0, 0
    for m in _BLOCKQUOTE.finditer(markup):
        if depth == 0:
            out.append(markup[at : m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        at = m.end()
    if depth == 0:
        out.append(markup[at:])
    return "\n\n".join(out)


def own_text(kind: str, text: str) -> str:
    """The part's text without quoted and forwarded mails, signature, disclaimer and notes of mail programs."""
    if kind == "html":
        text = html_text(_without_blockquotes(text))
    lines = text.replace("\r\n", "\n").split("\n")
    kept: list[str] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if _SIGNATURE.match(line) or _FORWARD.match(line):
            break
        if _HEAD.match(line) and sum(1 for x in lines[i : i + 5] if _HEAD.match(x)) >= 3:
            break
        if _QUOTED.match(line):
            i += 1
            continue
        if line.rstrip(" \t\xa0").endswith(":"):
            joined = line if _WROTE.search(line) else (kept[-1] + " " + line if kept else "")
            if joined and _WROTE.search(joined):
                if joined is not line:
                    kept.pop()
                j = i + 1
                while j < n and not lines[j].strip(" \t\xa0"):
                    j += 1
                if j < n and not _QUOTED.match(lines[j]) and kind == "plain":
                    break  # an unmarked quote runs to the end
                i += 1
                continue
        kept.append(line)
        i += 1
    paragraphs = [
        p
        for p in _PARAGRAPH.split("\n".join(kept))
        if not _SENT_FROM.match(p) and not (_DISCLAIMER.search(p) and _END.search(p)) and not (len(p) < 200 and _HTML_NOTE.search(p))
    ]
    return "\n\n".join(paragraphs)


def _plain_letters(text: str) -> str:
    """Words set apart by marks put together again; the gaps between words stay."""
    return _APART.sub(lambda m: _MARKS.sub("", m[0]), text)


def _pieces(text: str, size: int) -> list[str]:
    """Blocks of whole paragraphs of at least half of ``size`` characters; a long paragraph is cut between words."""
    out: list[str] = []
    held: list[str] = []
    room = size

    def close() -> None:
        nonlocal held, room
        if held:
            out.append(" \n".join(held))
        held, room = [], size

    for paragraph in _PARAGRAPH.split(text):
        paragraph = " ".join(paragraph.split())
        if not paragraph:
            continue
        if room <= size // 2:
            close()
        at = 0
        while len(paragraph) - at > room + size // 2:
            gap = paragraph.rfind(" ", at, at + max(1, room))
            if gap <= at:
                gap = paragraph.find(" ", at + max(0, room))
            if gap < 0:
                break  # one long word
            held.append(paragraph[at:gap])
            at = gap + 1
            close()
        held.append(paragraph[at:])
        room -= len(paragraph) - at + 1
    close()
    if len(out) > 1 and len(out[-1]) < size // 2:
        out[-2:] = [f"{out[-2]} {out[-1]}"]
    return out


def _packed(raw: bytes, rest: bytes) -> int:
    """Compressed size of ``raw`` for one who knows ``rest``."""
    if rest:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, rest)
    else:
        packer = zlib.compressobj(9, zlib.DEFLATED, -15, 9)
    return len(packer.compress(raw)) + len(packer.flush())


def _folded(text: str) -> bytes:
    return _LEET.sub(lambda m: m[0].translate(_LETTERS), " ".join(text.split()).lower()).encode("utf-8", "replace")


def blocks_of(parts: list[tuple[str, str]], spam: Spam) -> list[dict]:
    """The blocks of all parts, with words, sentence ends, size, size of the text around and ratio."""
    out: list[dict] = []
    for kind, text in parts:
        pieces = _pieces(_plain_letters(own_text(kind, text)), spam.block)
        folded = [_folded(x) for x in pieces]
        whole = b" ".join(folded)
        at = 0
        for piece, raw in zip(pieces, folded):
            end = at + len(raw)
            words = len(_WORD.findall(piece))
            if words:
                rest = whole[end + 1 : end + 1 + spam.context] + whole[max(0, at - spam.context) : at]
                out.append({
                    "words": words, "ends": len(_END.findall(piece)), "size": len(raw), "whole": len(raw) + len(rest),
                    "ratio": _packed(raw, rest) / max(1, len(raw)),
                })
            at = end + 1
    return out


def _scanner(spam: Spam):
    schema = arrow_schema(BLOCKS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if doc is not None and raw:
                    rows.append({"doc_id": doc, "lang": lang, "blocks": blocks_of(text_parts(raw), spam)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return scan


@dataclass(frozen=True)
class Expected:
    """Ratio of prose: exp(level + block * ln size + text * ln whole) times the language's factor.

    Lengths beyond those of prose, ``sizes`` and ``wholes``, are taken as the nearest of these: no extrapolation.
    """

    level: float
    block: float
    text: float
    langs: dict[str, float]
    sizes: tuple[float, float] = (1.0, 1.0)
    wholes: tuple[float, float] = (1.0, 1.0)

    def column(self) -> Column:
        size, whole = (
            F.log(F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))) for c, (a, b) in (("size", self.sizes), ("whole", self.wholes))
        )
        factor = F.lit(1.0)
        if self.langs:
            pairs = F.create_map(*(F.lit(x) for pair in sorted(self.langs.items()) for x in pair))
            factor = F.coalesce(F.try_element_at(pairs, F.col("lang")), factor)
        return F.exp(F.lit(self.level) + F.lit(self.block) * size + F.lit(self.text) * whole) * factor


def expected(prose: DataFrame, spam: Spam) -> Expected:
    """The fit to the median ratios of ``prose`` (lang, size, whole, ratio); two length classes to a doubling."""
    classes = [F.floor(F.log2(F.greatest(c, F.lit(1))) * 2).cast("int").alias(c) for c in ("size", "whole")]
    by_class = prose.select("lang", "ratio", *classes).groupBy("lang", "size", "whole")
    found = by_class.agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"), F.count(F.lit(1)).alias("n")).collect()
    if not found:
        return Expected(0.0, 0.0, 0.0, {})
    x = np.array([[(r["size"] + 0.5) / 2, (r["whole"] + 0.5) / 2] for r in found]) * np.log(2)
    y, n = np.log([max(1e-3, r["usual"]) for r in found]), np.array([float(r["n"]) for r in found])
    weight = n
    for _ in range(30):  # towards least absolute deviations, so that a class of repeated notices bends nothing
        mean_x, mean_y = (x * weight[:, None]).sum(axis=0) / weight.sum(), (y * weight).sum() / weight.sum()
        heavy = np.sqrt(weight)
        # about the means: lengths that do not vary get no slope
        slope = np.linalg.lstsq((x - mean_x) * heavy[:, None], (y - mean_y) * heavy, rcond=1e-6)[0]
        level = mean_y - slope @ mean_x
        weight = n / np.maximum(np.abs(y - level - x @ slope), 0.02)
    off = y - level - x @ slope
    langs = {}
    for lang in {r["lang"] for r in found}:
        own = np.array([r["lang"] == lang for r in found])
        langs[lang] = float(np.exp((off[own] * n[own]).sum() / (n[own].sum() + spam.lean)))
    return Expected(float(level), float(slope[0]), float(slope[1]), langs, *(_range(np.exp(x[:, i]), weight) for i in (0, 1)))


def _range(lengths: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Between which lengths all but a hundredth at either end stand."""
    order = np.argsort(lengths)
    upto = np.cumsum(weight[order]) / weight.sum()
    low, high = (lengths[order][min(len(lengths) - 1, int(np.searchsorted(upto, q)))] for q in (0.01, 0.99))
    return float(low), float(high)


def spam_report(
    documents: DataFrame, spam: Spam | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """doc_id, own_words, spam_words, spam_share, is_spam of every document with an id and a text.

    A language is its first two letters, lower case; a null or other one counts as unknown, which has its own
    factor. A document given twice is judged once per row and kept once. A mail without own words is none. Without
    any prose there is nothing to expect and a block's own ratio counts.
    """
    spam = spam or Spam()
    code = F.lower(F.trim(F.col(lang)))
    code = F.when(code.rlike("^[a-z]{2}([-_].*)?$"), F.substring(code, 1, 2)).otherwise(F.lit("un"))
    features = spool(
        documents.select(F.col(doc_id).cast("long"), F.col(text), code.alias("lang")).mapInArrow(_scanner(spam), BLOCKS)
    )
    each = features.select("doc_id", "lang", F.inline("blocks"))
    bare = F.col("ends") < F.col("words") * spam.ends
    usual = expected(each.where(~bare), spam)
    flagged = bare & (F.col("ratio") <= usual.column() * spam.below)
    return (
        each.groupBy("doc_id")
        .agg(F.sum("words").alias("own_words"), F.sum(F.when(flagged, F.col("words")).otherwise(0)).alias("spam_words"))
        .withColumn("spam_share", F.col("spam_words") / F.greatest("own_words", F.lit(1)))
        .withColumn("is_spam", F.col("spam_share") > spam.share)
    )
