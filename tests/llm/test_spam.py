"""Problem 10: pages of keywords, links and tags among ordinary mails."""

import random

import pytest

from knotwork.llm import spam
from knotwork.llm.spam import Spam, blocks_of, own_text

DOCS = "doc_id long, text string, lang string, blocks string, class int"
NAMES = ["Anna", "Boris", "Cleo", "Dario", "Enid", "Farid", "Gwen", "Hugo"]
THINGS = ["ledger", "kettle", "window", "garden", "report", "engine", "bottle", "letter", "carpet", "ticket"]
DOING = ["opened", "sold", "moved", "painted", "lost", "counted", "found", "carried", "watched", "repaired"]


def sentences(rng, n):
    return " ".join(f"{rng.choice(NAMES)} {rng.choice(DOING)} the {rng.choice(THINGS)} near room {rng.randrange(900)} before {rng.choice(NAMES)} called." for _ in range(n))


def keywords(rng, n):
    return " ".join(rng.choice(["cheap", "best", "buy", "free"]) + " " + rng.choice(["lamp", "sofa"]) for _ in range(n))


KINDS = {
    "keywords": keywords,
    "apart": lambda rng, n: " ".join(rng.choice(["l.a.m.p", "S.o.f.a", "cheap s0fa", "BEST LAMP", "b3st l4mp"]) for _ in range(n)),
    "links": lambda rng, n: "\n".join(f"* Buy {rng.choice(['Lamp', 'Sofa'])} - http://shop.test/{rng.choice(['lamp', 'sofa'])}-{rng.randrange(9)}.html" for _ in range(n // 3)),
    "tags": lambda rng, n: " ".join("#" + rng.choice(["cheap_", "best_", ""]) + rng.choice(["lamp", "sofa"]) for _ in range(n)),
    "products": lambda rng, n: "\n".join(f"SKU:{rng.choice(['lamp', 'sofa'])} | sale | M | {rng.choice(['red', 'blue'])} | {rng.randrange(99)},99" for _ in range(n // 4)),
}


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(6)
    head = "Subject: s\nContent-Type: text/plain\n\n"
    rows, want = [], set()
    for i in range(400):
        rows.append((i, head + sentences(rng, rng.randint(2, 9)), rng.choice(["en", "EN-us", None, "?"]), "", 0))
    for j, (name, make) in enumerate(KINDS.items()):
        for i in range(4):
            base = 1000 + 100 * j + 10 * i
            page = make(rng, 80)
            rows.append((base, head + page, "en", "", 0))
            rows.append((base + 1, head + sentences(rng, 2) + "\n\n" + page, "en", "", 0))
            rows.append((base + 2, head + sentences(rng, 4) + "\n\nOn Mon, 1 Jan 2024, Anna wrote:\n" + "\n".join("> " + x for x in page.split("\n")), "en", "", 0))
            rows.append((base + 3, head + sentences(rng, 40) + "\n\n" + make(rng, 20), "en", "", 0))
            want |= {base, base + 1}
    table = "\n".join(f"{i:3d}  {rng.choice('ABC')}{rng.randrange(99)}   {rng.random() * 90:.2f}  {rng.choice(['ok', 'low', 'n/a'])}" for i in range(25))
    rows += [(5000, head + sentences(rng, 2) + "\n" + table, "en", "", 0), (5001, None, "en", "", 0), (5002, "", None, "", 0), (None, head + keywords(rng, 50), "en", "", 0)]
    rows.append((5003, head + "<html><body><div style='display:none'>" + keywords(rng, 60) + "</div></body></html>", "en", "", 0))
    rows.append((5004, head.replace("plain", "html") + "<p>See this.</p><div style='font-size:0'>" + keywords(rng, 60) + "</div>", "en", "", 0))
    rows.append(rows[400])
    want |= {5004}
    report = spam.spam_report(spark.createDataFrame(rows, DOCS)).collect()
    return {r.doc_id: r for r in report}, want, report


def test_found(judged):
    by, want, report = judged
    assert len(by) == len(report)
    assert {d for d, r in by.items() if r.is_spam} - {5003} == want


def test_missing_texts_are_no_cases(judged):
    by, _, _ = judged
    assert not {5001, 5002, None} & set(by)


def test_empty(spark):
    assert spam.spam_report(spark.createDataFrame([], DOCS)).count() == 0


def test_own_text():
    text = "Hi,\nmine.\n\nOn Mon, 1 Jan 2024, Anna wrote:\n> theirs\n> more\n\nalso mine.\n-- \nAnna\n\nnot mine"
    assert own_text("plain", text).split() == ["Hi,", "mine.", "also", "mine."]
    assert own_text("plain", "a.\n\n-----Original Message-----\nFrom: x\nb").split() == ["a."]
    assert own_text("plain", "a.\n\nFrom: x\nSent: y\nSubject: z\n\nb").split() == ["a."]
    assert own_text("html", "<p>a</p><blockquote><p>b<blockquote>c</blockquote></p></blockquote><p>d</p>").split() == ["a", "d"]
    assert own_text("plain", "This mail is best read in a program that shows HTML.") == ""


def test_blocks_count_all_words():
    parts = [("plain", "One sentence here. Another one there.\n\nbuy lamp buy lamp buy lamp buy lamp")]
    blocks = blocks_of(parts, Spam())
    assert [(b["ends"], b["words"]) for b in blocks] == [(2, 14)]
    assert [b["words"] for b in blocks_of(parts, Spam(block=60))] == [6, 8]


def test_long_blocks_where_prose_is_short(spark):
    rng = random.Random(8)
    head = "Subject: s\nContent-Type: text/plain\n\n"
    rows = [(i, head + sentences(rng, rng.randint(2, 9)), "en", "", 0) for i in range(300)]
    notice = "Job 7 on host nine has ended well and needs no further care of yours today. " * 24
    rows += [(1000 + i, head + notice, "en", "", 0) for i in range(3)]
    pages = [keywords(rng, 160) for _ in range(4)]
    assert all(1448 <= len(x) < 2048 for x in [notice, *pages])
    rows += [(2000 + i, head + x, "en", "", 0) for i, x in enumerate(pages)]
    rows.append((2010, head + " ".join(pages * 3), "en", "", 0))  # longer than any prose
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows.append((3000, head + " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(500)), "en", "", 0))
    report = spam.spam_report(spark.createDataFrame(rows, DOCS)).where("is_spam").collect()
    assert {r.doc_id for r in report} == {2000, 2001, 2002, 2003, 2010}


@pytest.mark.parametrize("size", [20, 192, 5000])
def test_pieces_hold_every_word(size):
    rng = random.Random(size)
    text = "\n\n".join(" ".join(rng.choice(["a", "longer", "x" * 300, "word."]) for _ in range(rng.randint(0, 90))) for _ in range(30))
    assert " ".join(spam._pieces(text, size)).split() == text.split()
    assert spam._pieces("", size) == [] and spam._pieces(" \n\n ", size) == []


def test_each_test_matters(spark):
    """Notices that repeat whole sentences are redundant and punctuated, tables neither: only both tests leave the pages."""
    rng = random.Random(12)
    head = "Subject: s\nContent-Type: text/plain\n\n"
    rows = [(i, head + sentences(rng, rng.randint(3, 9)), "en", "", 0) for i in range(300)]
    rows += [(1000 + i, head + "The job has ended well. Nothing is left to do. " * 20, "en", "", 0) for i in range(5)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(2000 + i, head + "\n".join("".join(rng.choice(letters) for _ in range(6)) + f" {rng.randrange(9999)}" for _ in range(60)), "en", "", 0) for i in range(5)]
    rows += [(3000 + i, head + keywords(rng, 90), "en", "", 0) for i in range(5)]
    df = spark.createDataFrame(rows, DOCS)
    cases = lambda **kw: {r.doc_id // 1000 for r in spam.spam_report(df, Spam(**kw)).where("is_spam").collect()}
    assert cases() == {3} and cases(below=99.0) == {2, 3}
    features = spam.spam_report(df, Spam(ends=99.0))  # every block bare: no prose, a block's own ratio counts
    assert {1, 3} <= {r.doc_id // 1000 for r in features.where("is_spam").collect()}


def test_expectation_is_a_smooth_fit(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de"]), s, w, 2.0 * s**-0.1 * w**-0.05) for s in (50, 100, 200, 400) for w in (400, 900, 3000) for _ in range(40)]
    fit = spam.expected(spark.createDataFrame(rows, "lang string, size int, whole int, ratio double"), Spam())
    assert abs(fit.block + 0.1) < 0.03 and abs(fit.text + 0.05) < 0.03 and all(abs(x - 1) < 0.05 for x in fit.langs.values())
    assert spam.expected(spark.createDataFrame([], "lang string, size int, whole int, ratio double"), Spam()).langs == {}
