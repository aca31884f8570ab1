"""Held-out passages leaking into a corpus: latent semantic retrieval, then checks of what was retrieved.

1. Words. The items' vocabulary is numbered; every mail is decoded once, whatever the number of items, and written as
   word numbers (0: any other word). The same pass counts in how many documents each word occurs, summed in the cluster.
2. Latent space. The TF-IDF vectors of the items' passages, idf over all documents, are a distributed matrix that is
   decomposed by a randomised SVD: subspace iteration whose products are added up word by word in the cluster. The
   basis is fitted on the items and not on the corpus, in which the items' wording is too rare to get a direction.
3. Search. A document is cut into half-overlapping windows, so that any run of ``run`` words lies in one whole. A
   window's latent vector meets those of all item passages in one matrix product. A window and a passage whose cosine
   reaches ``min_cosine`` are a candidate; nothing else of a document is ever compared with an item.
4. Checks. A candidate's longest common subsequence must hold the part of the passage that a leaked run overlaps; what
   is left is checked for a common run of words around that passage. With ``paraphrases``, a candidate that is near
   enough and has most of the passage as a subsequence counts too, and the answer is looked for.

What a search task holds is bounded by ``item_block`` items; further blocks read the word numbers again, not the mails.
The vocabulary is broadcast: distinct words of the items, which grow far slower than their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.llm.mail import html_text, text_parts
from knotwork.session import spool

_WORD = re.compile(r"[^\W_]+")

CODED = "doc_id long, codes binary, df array<struct<word: int, n: long>>, docs long"
ITEMS = "item_id long, codes binary, answer binary"
PASSAGES = "item_id long, codes binary, answer binary, starts array<int>, latent binary"
HITS = "doc_id long, item_id long, cosine float, run int, lcs float, answered boolean"


def words(text: str) -> list[str]:
    """Runs of letters or digits, regardless of case."""
    return _WORD.findall(text.casefold())


@dataclass(frozen=True)
class Leak:
    """``run`` consecutive words make a leak. ``passage`` words make an item passage, ``stride`` apart."""

    run: int = 12
    passage: int = 12
    stride: int = 4
    rank: int = 64
    oversample: int = 16
    rounds: int = 2
    min_cosine: float = 0.2
    #: Paraphrases must be nearer, and share this much of the passage retrieved as a subsequence.
    paraphrase_cosine: float = 0.4
    min_lcs: float = 0.7
    item_block: int = 4096
    seed: int = 11

    @property
    def overlap(self) -> int:
        """Words that a leaked run has in common, in order, with the passage that lies best along it."""
        return max(1, min(self.run, self.passage) - self.stride // 2)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own: set[str] = set()
        for column in batch.columns:
            for text in column.to_pylist():
                own.update(words(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], names=["word"])


def _numberer(shared):
    schema = arrow_schema(ITEMS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = shared.value
        for batch in batches:
            texts, answers = (
                [np.array([vocabulary[w] for w in words(x or "")], np.int32).tobytes() for x in batch.column(i).to_pylist()] for i in (1, 2)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(texts, pa.binary()), pa.array(answers, pa.binary())], schema=schema
            )

    return number


def _coder(shared):
    schema = arrow_schema(CODED)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = shared.value
        get = vocabulary.get
        df = np.zeros(len(vocabulary) + 1, np.int64)
        docs = 0
        for batch in batches:
            ids, coded = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not raw:
                    continue
                numbers: list[int] = []
                for kind, text in text_parts(raw):
                    numbers += [get(w, 0) for w in words(html_text(text) if kind == "html" else text)]
                    numbers.append(0)  # nothing runs on from one part to the next
                codes = np.asarray(numbers, np.int32)
                docs += 1
                df[np.unique(codes)] += 1
                ids.append(doc)
                coded.append(codes.tobytes())
            nothing = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(coded, pa.binary()), nothing.cast(schema.field(2).type), nothing.cast(pa.int64())],
                schema=schema,
            )
        held = np.flatnonzero(df)
        counts = [{"word": int(w), "n": int(df[w])} for w in held]
        yield pa.RecordBatch.from_pylist([{"doc_id": None, "codes": None, "df": counts, "docs": docs}], schema)

    return code


def _windows(codes: np.ndarray, size: int, stride: int) -> list[tuple[int, int]]:
    """Windows from the start, the last one flush with the end; one for a short text."""
    if len(codes) <= size:
        return [(0, len(codes))]
    starts = list(range(0, len(codes) - size + 1, stride))
    if starts[-1] != len(codes) - size:
        starts.append(len(codes) - size)
    return [(s, s + size) for s in starts]


def _tfidf(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a passage and their weights, of length 1."""
    own, counts = np.unique(codes[codes > 0], return_counts=True)
    weights = counts * idf[own]
    norm = np.sqrt((weights**2).sum())
    return own, weights / norm if norm > 0 else weights


def _item_passages(codes: np.ndarray, leak: Leak) -> list[tuple[int, int]]:
    """An item's passages; one that is too short to leak has none."""
    return _windows(codes, leak.passage, leak.stride) if len(codes) >= leak.run else []


def _passage_rows(shared, leak: Leak):
    """Rows of the passage matrix: word numbers and weights."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            held, weights = [], []
            for raw in batch.column(0).to_pylist():
                codes = np.frombuffer(raw, np.int32)
                for a, b in _item_passages(codes, leak):
                    own, w = _tfidf(codes[a:b], idf)
                    held.append(own)
                    weights.append(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32()))], names=["words", "weights"]
            )

    return rows


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the same word added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for word, share in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = np.frombuffer(share)
            total[word] = total[word] + row if word in total else row
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["word", "share"]
    )


def randomised_svd(passages: DataFrame, width: int, leak: Leak) -> np.ndarray:
    """The leading right singular vectors (width x rank) of the matrix whose rows are ``passages``.

    ``passages`` has columns words array<int> and weights array<float>. Each round multiplies the current basis by
    AᵀA: every partition adds up its rows' share of each word, the shares of a word meet in one task, and the driver
    gets each word's sum once (width x (rank + oversample) numbers), to make the columns orthonormal.
    """
    sc = passages.sparkSession.sparkContext
    rng = np.random.default_rng(leak.seed)
    basis = rng.standard_normal((width, leak.rank + leak.oversample))
    for _ in range(leak.rounds + 1):
        shared = sc.broadcast(basis)

        def multiply(batches, shared=shared):
            b = shared.value
            total = np.zeros_like(b)
            touched = np.zeros(len(b), bool)
            for batch in batches:
                for own, weights in zip(batch.column(0), batch.column(1)):
                    own, weights = np.asarray(own.values), np.asarray(weights.values, dtype=np.float64)
                    if len(own):
                        total[own] += weights[:, None] * (weights @ b[own])[None, :]
                        touched[own] = True
            held = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.astype(np.int32)), pa.array([total[w].tobytes() for w in held], pa.binary())], names=["word", "share"]
            )

        shares = passages.select("words", "weights").mapInArrow(multiply, "word int, share binary")
        summed = shares.repartition("word").mapInArrow(_added, "word int, share binary").toArrow()
        total = np.zeros_like(basis)
        for word, share in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
            total[word] = np.frombuffer(share)
        left, size, _ = np.linalg.svd(total, full_matrices=False)
        keep = size > size[0] * 1e-10 if len(size) and size[0] > 0 else np.zeros(len(size), bool)
        basis = left[:, keep] if keep.any() else left[:, :1] * 0
        shared.unpersist()
    return np.ascontiguousarray(basis[:, : leak.rank], dtype=np.float32)


def _projector(shared, leak: Leak):
    """Items with the places and latent vectors (of length 1) of their passages."""
    schema = arrow_schema(PASSAGES)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        for batch in batches:
            starts, latent = [], []
            for raw in batch.column(1).to_pylist():
                codes = np.frombuffer(raw, np.int32)
                places = _item_passages(codes, leak)
                rows = np.zeros((len(places), basis.shape[1]), np.float32)
                for row, (a, b) in zip(rows, places):
                    own, weights = _tfidf(codes[a:b], idf)
                    row[:] = (weights[:, None] * basis[own]).sum(axis=0)
                norms = np.sqrt((rows**2).sum(axis=1))
                starts.append([a for a, _ in places])
                latent.append((rows / np.where(norms > 0, norms, 1)[:, None]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(starts, pa.list_(pa.int32())), pa.array(latent, pa.binary())],
                schema=schema,
            )

    return project


@dataclass(frozen=True)
class Model:
    """What a search task holds for a block of items."""

    ids: np.ndarray
    codes: list[np.ndarray]
    answers: list[tuple[int, ...] | None]
    idf: np.ndarray
    embedding: np.ndarray  # word number -> latent vector, idf applied
    passages: np.ndarray  # latent passages of length 1, each wording once
    wordings: np.ndarray  # the passages' word numbers, filled up with -1
    lengths: np.ndarray
    fan_starts: np.ndarray  # passage -> where its occurrences begin in fan_items and fan_places
    fan_items: np.ndarray
    fan_places: np.ndarray


def build_model(block: list, idf: np.ndarray, embedding: np.ndarray, leak: Leak) -> Model:
    """The model of a block of item rows (PASSAGES); a passage that several items share is searched once."""
    seen: dict[bytes, int] = {}
    fans: list[list[tuple[int, int]]] = []
    latent, wordings, codes = [], [], []
    for at, row in enumerate(block):
        own = np.frombuffer(row.codes, np.int32)
        codes.append(own)
        rows = np.frombuffer(row.latent, np.float32).reshape(len(row.starts), -1) if row.starts else []
        for start, vector in zip(row.starts, rows):
            wording = own[start : start + leak.passage]
            p = seen.setdefault(wording.tobytes(), len(fans))
            if p == len(fans):
                fans.append([])
                latent.append(vector)
                wordings.append(wording)
            fans[p].append((at, start))
    lengths = np.array([len(x) for x in wordings], np.int64)
    table = np.full((len(lengths), int(lengths.max(initial=0))), -1, np.int32)
    for row, wording in zip(table, wordings):
        row[: len(wording)] = wording
    flat = np.array([x for fan in fans for x in fan], np.int64).reshape(-1, 2)
    return Model(
        np.array([r.item_id for r in block], np.int64), codes,
        [tuple(np.frombuffer(r.answer, np.int32).tolist()) or None for r in block],
        idf, embedding, np.array(latent, np.float32).reshape(len(latent), embedding.shape[1]), table, lengths,
        np.concatenate([[0], np.cumsum([len(f) for f in fans])]).astype(np.int64), flat[:, 0], flat[:, 1],
    )


def lcs_share(passage: np.ndarray, window: np.ndarray) -> float:
    """Longest common subsequence as a share of the passage; number 0, any unknown word, equals nothing."""
    if len(passage) == 0:
        return 0.0
    row = np.zeros(len(window) + 1, np.int32)
    for word in passage:
        grown = np.maximum(row[1:], np.where((window == word) & (word > 0), row[:-1] + 1, 0))
        row = np.concatenate([[0], np.maximum.accumulate(grown)])
    return float(row[-1]) / len(passage)


def lcs_lengths(passages: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Longest common subsequence of every passage with the window beside it, row by row; number 0 equals nothing."""
    row = np.zeros((len(windows), windows.shape[1] + 1), np.int16)
    for word in passages.T:
        same = (windows == word[:, None]) & (word > 0)[:, None]
        grown = np.maximum(row[:, 1:], np.where(same, row[:, :-1] + 1, 0))
        row[:, 1:] = np.maximum.accumulate(grown, axis=1)
    return row[:, -1].astype(np.int64)


def _words_inside(passages: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """How many words of every passage stand in the window beside it, in whatever order."""
    inside = np.zeros(len(windows), np.int16)
    for word in passages.T:
        inside += (windows == word[:, None]).any(axis=1) & (word > 0)
    return inside


def _contains(codes: np.ndarray, part: tuple[int, ...]) -> bool:
    n = len(codes) - len(part) + 1
    if n <= 0:
        return False
    hit = np.ones(n, bool)
    for i, word in enumerate(part):
        hit &= codes[i : i + n] == word
    return bool(hit.any())


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` of them."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def common_runs(windows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common run of every window with the words beside it: its length and where it ends in either.

    Numbers up to 0 equal nothing.
    """
    n, width = others.shape
    rows = np.arange(n)
    run = np.zeros((n, width + 1), np.int16)
    best, end_w, end_o = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, word in enumerate(windows.T):
        same = (others == word[:, None]) & (word > 0)[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        top = run.argmax(axis=1)
        length = run[rows, top]
        longer = length > best
        best, end_w, end_o = np.where(longer, length, best), np.where(longer, i + 1, end_w), np.where(longer, top, end_o)
    return best, end_w, end_o


def _norms(windows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the windows' TF-IDF vectors over all words, those that no item has included, each as a word of its own."""
    order = np.sort(windows, axis=1)
    weight = np.where(order == _NONE, 0, idf[np.maximum(order, 0)]) ** 2
    total = weight.sum(axis=1)
    # a word that stands n times counts n² times: the pairs of its places come on top
    for gap in range(1, order.shape[1]):
        same = (order[:, gap:] == order[:, :-gap]) & (order[:, gap:] > 0)
        if not same.any():
            break
        total += 2 * (weight[:, gap:] * same).sum(axis=1)
    return np.sqrt(total)


#: Fills up where a document has no more words.
_NONE = -1
#: Words looked at together, and candidates whose words are compared together; they bound the memory of a search task.
_FLAT, _HITS = 1 << 17, 1 << 14


def _searcher(shared, leak: Leak, paraphrases: bool, rejected: bool):
    schema = arrow_schema(HITS)
    half = leak.run  # windows of two halves; any run of so many words lies in one of them whole

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        ids, codes, total = [], [], 0
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            codes.append(np.frombuffer(raw, np.int32))
            total += len(codes[-1])
            if total >= _FLAT:
                yield ids, codes
                ids, codes, total = [], [], 0
        if ids:
            yield ids, codes

    def retrieve(model: Model, halves: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, passages and cosines of the candidates."""
        sums = np.zeros((len(halves) - 1, model.embedding.shape[1]), np.float32)
        at = np.flatnonzero((halves[:-1] > 0).any(axis=1))
        sums[at] = model.embedding[np.maximum(halves[at], 0)].sum(axis=1)
        window = sums.copy()
        joined = np.flatnonzero(after < len(sums))
        window[joined] += sums[joined + 1]
        live = np.flatnonzero((window != 0).any(axis=1))
        norms = _norms(np.concatenate([halves[live], halves[after[live]]], axis=1), model.idf)
        # no passage, of length 1, can be nearer to a window than the length of its latent vector says
        able = np.sqrt((window[live] ** 2).sum(axis=1)) >= norms * (leak.min_cosine - 1e-4)
        live, norms = live[able], norms[able]
        step = max(1, (1 << 22) // len(model.passages))
        for s in range(0, len(live), step):
            part = live[s : s + step]
            cosines = (window[part] / norms[s : s + step, None]) @ model.passages.T
            w, p = np.nonzero(cosines >= leak.min_cosine)
            near = cosines[w, p]
            for h in range(0, len(w), _HITS):
                yield part[w[h : h + _HITS]], p[h : h + _HITS], near[h : h + _HITS]

    def stretch(own: np.ndarray, i: int, other: np.ndarray, j: int, length: int) -> int:
        """A common run that ends before ``own[i]`` and ``other[j]``, with what goes on beyond its window."""
        a, b = i - length, j - length
        while a > 0 and b > 0 and own[a - 1] == other[b - 1]:
            a, b = a - 1, b - 1
        while i < len(own) and j < len(other) and own[i] == other[j]:
            i, j = i + 1, j + 1
        return i - a

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n_items = len(model.ids)
        around = 2 * leak.run + leak.passage
        least = np.minimum(leak.overlap, model.lengths)  # what a candidate must have in common with its passage
        if paraphrases:
            least = np.minimum(least, np.ceil(leak.min_lcs * model.lengths - 1e-9).astype(np.int64))
        for batch in batches:
            out: list[tuple] = []
            for ids, codes in groups(batch) if len(model.passages) else ():
                # halves of `half` words, each document padded to whole halves
                sizes = np.array([max(1, -(-len(c) // half)) for c in codes])
                flat = np.full(int(sizes.sum()) * half, _NONE, np.int32)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for c, s in zip(codes, starts):
                    flat[s * half : s * half + len(c)] = c
                owner = np.repeat(np.arange(len(ids)), sizes)
                joined = np.flatnonzero(owner[:-1] == owner[1:])
                halves = np.concatenate([flat.reshape(-1, half), np.full((1, half), _NONE, np.int32)])
                after = np.full(len(owner), len(owner))  # the half that follows; none at a document's end
                after[joined] = joined + 1
                runs: dict[tuple[int, int], int] = {}
                parts: dict[tuple[int, int], float] = {}  # greatest share of a passage in a window
                nearest: dict[tuple[int, int], float] = {}
                for w, p, cosine in retrieve(model, halves, after):
                    if rejected:
                        _keep_greatest(nearest, owner[w], p, cosine, model)
                    windows = np.concatenate([halves[w], halves[after[w]]], axis=1)
                    # no subsequence is longer than the words of the passage that stand in the window at all
                    able = np.flatnonzero(_words_inside(model.wordings[p], windows) >= least[p])
                    w, p, cosine, windows = w[able], p[able], cosine[able], windows[able]
                    common = lcs_lengths(model.wordings[p], windows)
                    if paraphrases:
                        share = common / model.lengths[p]
                        near = np.flatnonzero((cosine >= leak.paraphrase_cosine) & (share >= leak.min_lcs))
                        _keep_greatest(parts, owner[w[near]], p[near], share[near], model)
                    hold = np.flatnonzero(common >= np.minimum(leak.overlap, model.lengths[p]))
                    if len(hold) == 0:
                        continue
                    # each occurrence of the passage, with the words around it
                    fans = np.diff(model.fan_starts)[p[hold]]
                    at = _spans(model.fan_starts[p[hold]], fans)
                    hold = np.repeat(hold, fans)
                    item, begin = model.fan_items[at], np.maximum(0, model.fan_places[at] - leak.run)
                    region = np.zeros((len(at), around), np.int32)
                    for row, i, b in zip(region, item, begin):
                        piece = model.codes[i][b : b + around]
                        row[: len(piece)] = piece
                    length, end_w, end_r = common_runs(windows[hold], region)
                    for x in np.flatnonzero(length >= leak.run).tolist():
                        doc, i = int(owner[w[hold[x]]]), int(item[x])
                        place = int((w[hold[x]] - starts[doc]) * half + end_w[x])
                        whole = stretch(codes[doc], place, model.codes[i], int(begin[x] + end_r[x]), int(length[x]))
                        runs[doc, i] = max(runs.get((doc, i), 0), whole)
                for doc, item in runs.keys() | parts.keys() | nearest.keys():
                    run, share = runs.get((doc, item), 0), parts.get((doc, item))
                    answer = model.answers[item]
                    said = None if answer is None or not paraphrases else _contains(codes[doc], answer)
                    out.append((ids[doc], int(model.ids[item]), nearest.get((doc, item)), run, share, said))
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return search


def _keep_greatest(best: dict[tuple[int, int], float], docs: np.ndarray, p: np.ndarray, value: np.ndarray, model: Model) -> None:
    """The greatest value of every document and item of these passages."""
    fans = np.diff(model.fan_starts)[p]
    key = np.repeat(docs, fans) * len(model.ids) + model.fan_items[_spans(model.fan_starts[p], fans)]
    value = np.repeat(value, fans)
    order = np.lexsort((-value, key))
    key, value = key[order], value[order]
    for k, v in zip(*(x[np.flatnonzero(np.diff(key, prepend=-1))] for x in (key, value))):
        pair = divmod(int(k), len(model.ids))
        best[pair] = max(best.get(pair, 0.0), float(v))


def find_leaks(
    documents: DataFrame, items: DataFrame, leak: Leak | None = None, paraphrases: bool = False,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer",
    rejected: bool = False,
) -> DataFrame:
    """doc_id, item_id, cosine, run, lcs, answered of every document that gives an item away.

    ``run`` is the longest common run of words where it has at least ``leak.run`` words; else 0. With
    ``paraphrases`` ``lcs`` says what share of an item's passage is a subsequence of the document's window and
    ``answered`` whether the answer (null: the item has none) occurs in the document. With ``rejected`` every
    document and item that was retrieved has a row, its greatest ``cosine``, and run 0 where the checks failed.
    Documents without id or text and items without id or with fewer than ``leak.run`` words match nothing. A
    document or item given twice is one.
    """
    leak = leak or Leak()
    spark = documents.sparkSession
    sc = spark.sparkContext
    own = items.select(F.col(item_id).cast("long"), F.col(item_text), F.col(answer)).where(F.col(item_id).isNotNull()).distinct()
    names = own.select(F.col(item_text).alias("a"), F.col(answer).alias("b")).mapInArrow(_item_words, "word string").distinct()
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(names.toArrow().column(0).to_pylist()))}
    shared = sc.broadcast(vocabulary)
    numbered = spool(own.mapInArrow(_numberer(shared), ITEMS))
    coded = spool(documents.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_coder(shared), CODED))
    counts = coded.where("df is not null").select("docs", "df")
    docs = counts.agg(F.sum("docs")).first()[0] or 0
    df = np.zeros(len(vocabulary) + 1, np.int64)
    summed = counts.select(F.inline("df")).groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row per word at most
    df[np.asarray(summed.column(0))] = np.asarray(summed.column(1))
    idf = np.log((docs + 1) / (df + 1)) + 1
    idf[0] = np.median(idf[1:]) if len(vocabulary) else 1.0  # any other word weighs as much as one of the items' does
    weights = sc.broadcast(idf)
    matrix = numbered.select("codes").mapInArrow(_passage_rows(weights, leak), "words array<int>, weights array<float>")
    basis = randomised_svd(matrix, len(idf), leak)
    embedding = (idf[:, None] * basis).astype(np.float32)
    embedding[0] = 0
    projected = spool(numbered.mapInArrow(_projector(sc.broadcast((idf, basis)), leak), PASSAGES))
    corpus = coded.where("codes is not null").select("doc_id", "codes")
    parts, block = [], []

    def search() -> None:
        model = sc.broadcast(build_model(block, idf, embedding, leak))
        parts.append(corpus.mapInArrow(_searcher(model, leak, paraphrases, rejected), HITS))

    for row in projected.where(F.size("starts") > 0).toLocalIterator():
        block.append(row)
        if len(block) == leak.item_block:
            search()
            block = []
    if block:
        search()
    if not parts:
        return spark.createDataFrame([], HITS)
    hits = reduce(DataFrame.unionByName, parts)
    return hits.groupBy("doc_id", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.bool_or("answered").alias("answered")
    )
