"""Problem 8: passages of items in mails, against looking at every run of words."""

import random

import numpy as np

from knotwork.llm import leak
from knotwork.llm.leak import lcs_share, words

WORDS = [f"w{i}" for i in range(400)]
DOCS, ITEMS = "doc_id long, text string, codes string", "item_id long, text string, answer string, suite string"


def corpus(seed=5):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(14, 40))), rng.choice([None, "w7 w8"]), "s") for i in range(25)]
    items.append((100, items[0][1].upper() + ".", None, "s"))
    docs = []
    for d in range(160):
        text = [rng.choice(WORDS + ["other", "words"]) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            own = items[rng.randrange(25)][1].split()
            n = rng.choice([11, 12, 13, len(own)])
            at = rng.randint(0, max(0, len(own) - n))
            place = rng.randint(0, len(text))
            text[place:place] = own[at : at + n]
        body = rng.choice([" ", ", ", "\n> "]).join(text)
        docs.append((d, f"Subject: x\n\n{body}", "x"))
    docs += [(900, None, "x"), (None, docs[0][1], "x"), (901, "", "x"), docs[3]]
    return docs, items


def brute(docs, items, run):
    out = set()
    for d, raw, _ in docs:
        if d is None or not raw:
            continue
        own = words(raw.partition("\n\n")[2])
        grams = {tuple(own[i : i + run]) for i in range(len(own) - run + 1)}
        for item, text, *_ in items:
            w = words(text)
            if any(tuple(w[i : i + run]) in grams for i in range(len(w) - run + 1)):
                out.add((d, item))
    return out


def test_against_every_run(spark):
    docs, items = corpus()
    extra = [(200, None, None, "s"), (None, "a b", None, "s"), (201, "too short", None, "s"), items[2]]
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + extra, ITEMS)
    want = brute(docs, items, 12)
    for block in (4096, 7):
        got = leak.find_leaks(df, it, leak.Leak(item_block=block)).where("run > 0").collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        assert all(r.run >= 12 for r in got)


def test_paraphrase_and_answer(spark):
    docs, items = corpus()
    own = items[4][1].split()
    gapped = own[:5] + own[6:12] + own[13:18]  # no run of twelve, most of a passage in order
    docs = docs + [(500, "Subject: y\n\n" + " ".join(gapped) + " and w7, w8", "x")]
    items = [(i, t, "W7 w8" if i == 4 else a, s) for i, t, a, s in items]
    hits = leak.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrases=True)
    row = [r for r in hits.collect() if (r.doc_id, r.item_id) == (500, 4)]
    assert row and row[0].run == 0 and row[0].lcs >= 0.7 and row[0].answered is True


def test_no_items_no_documents(spark):
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leak.find_leaks(df, it.where("false")).count() == 0
    assert leak.find_leaks(df.where("false"), it).count() == 0
    assert leak.find_leaks(df, it.where("false").unionByName(spark.createDataFrame([(1, "a b c", None, "s")], ITEMS))).count() == 0


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((60, 6)) @ rng.standard_normal((6, 40)) + 0.01 * rng.standard_normal((60, 40))
    rows = [(list(range(40)), [float(x) for x in r]) for r in a]
    df = spark.createDataFrame(rows, "words array<int>, weights array<float>").repartition(5)
    basis = leak.randomised_svd(df, 40, leak.Leak(rank=6, oversample=4))
    want = np.linalg.svd(a)[2][:6]
    assert np.linalg.svd(basis.T @ want.T, compute_uv=False).min() > 0.999


def test_lcs():
    x = lambda *v: np.array(v, np.int32)
    assert lcs_share(x(1, 2, 3, 4), x(9, 1, 3, 9, 4)) == 0.75
    assert lcs_share(x(0, 0), x(0, 0)) == 0.0 and lcs_share(x(), x(1)) == 0.0


def test_other_order_hides_no_paraphrase(spark):
    docs, items = corpus()
    own = items[4][1].split()[:12]
    shuffled = own[::-1]  # the same words: the greatest cosine, no common order
    filler = ["other"] * 24
    gapped = own[:5] + ["other"] + own[6:11]  # 10 of 12 in order, no run of twelve
    docs = docs + [(600, "Subject: y\n\n" + " ".join(shuffled + filler + gapped), "x"), (601, "Subject: y\n\n" + " ".join(shuffled + filler), "x")]
    hits = leak.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), paraphrases=True)
    rows = {(r.doc_id, r.item_id): r for r in hits.collect()}
    assert (600, 4) in rows and rows[600, 4].run == 0 and abs(rows[600, 4].lcs - 10 / 12) < 1e-6
    assert (601, 4) not in rows


def test_lcs_together():
    rng = np.random.default_rng(3)
    passages, windows = rng.integers(0, 5, (200, 12)).astype(np.int32), rng.integers(0, 5, (200, 24)).astype(np.int32)
    got = leak.lcs_lengths(passages, windows) / 12
    assert np.allclose(got, [lcs_share(p, w) for p, w in zip(passages, windows)])


def test_rows_come_from_the_retrieval(spark):
    """Every true case is retrieved; without retrieval there are none; most of what is not a case is not retrieved."""
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items, 12)
    hits = leak.find_leaks(df, it, rejected=True).collect()
    retrieved = {(r.doc_id, r.item_id) for r in hits}
    assert len(retrieved & want) >= 0.9 * len(want) and all(r.cosine >= leak.Leak().min_cosine for r in hits)
    assert {(r.doc_id, r.item_id) for r in hits if r.run > 0} == want & retrieved
    assert leak.find_leaks(df, it, leak.Leak(min_cosine=1.01)).count() == 0
    fewer = leak.find_leaks(df, it, leak.Leak(min_cosine=0.8)).where("run > 0").count()
    assert fewer < len(want)


def test_common_runs():
    rng = np.random.default_rng(4)
    windows, others = rng.integers(0, 4, (300, 24)).astype(np.int32), rng.integers(0, 4, (300, 36)).astype(np.int32)
    best, end_w, end_o = leak.common_runs(windows, others)
    for w, o, n, i, j in zip(windows, others, best, end_w, end_o):
        longest = 0
        for a in range(24):
            for b in range(36):
                k = 0
                while a + k < 24 and b + k < 36 and w[a + k] == o[b + k] > 0:
                    k += 1
                longest = max(longest, k)
        assert n == longest and (w[i - n : i] == o[j - n : j]).all()


def test_window_norms_are_those_of_tfidf():
    rng = np.random.default_rng(5)
    windows, idf = rng.integers(-1, 6, (100, 24)).astype(np.int32), rng.uniform(1, 3, 6)
    for window, norm in zip(windows, leak._norms(windows, idf)):
        known = [(window == w).sum() * idf[w] for w in range(1, 6)]
        other = [idf[0]] * int((window == 0).sum())  # each a word of its own
        assert np.isclose(norm, np.sqrt(sum(x * x for x in known + other)))


def test_whole_run_of_a_long_copy(spark):
    item = " ".join(f"q{i}" for i in range(70))
    docs = [(1, "Subject: z\n\nso " + item.upper() + " it ends", "x"), (2, "Subject: z\n\n" + "lorem " * 5000 + item[:60], "x")]
    hits = leak.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item, None, "s")], ITEMS)).collect()
    assert {(r.doc_id, r.item_id, r.run) for r in hits} == {(1, 5, 70), (2, 5, 17)}
