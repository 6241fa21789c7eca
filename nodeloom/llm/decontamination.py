"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed into 2**18 terms; how many documents have a term is counted over the whole corpus (fixed-size counts,
   summed by block of terms).
2. Documents are read as passages of 64 words, one every 32. A randomised SVD of their TF-IDF vectors over the terms of
   the benchmark gives the latent space: tasks multiply their passages by a random matrix and back (A^T A Omega), the
   products are summed by block of terms, and their orthonormal basis together with the benchmark's own rows spans the
   space. Every passage of every document takes part.
3. Every passage of every document is scored against every benchmark item (in blocks of items) by the cosine in that
   space, words outside it counting in the passage's norm. Passages of cosine 0.35 or more, or that hold 0.6 of an item's
   weight, are candidates. So is every passage that shares enough words with an item for step 4, by an exact bound on its
   rarest words: weights say nothing of an item that stands in a fifth of the documents or has lost its rarest words.
4. A candidate is confirmed by the longest common subsequence of the item's words and the passage with half an item on
   either side: 0.8 of the item, or 0.6 and as much of its answer (the answer column, or the last sentence). Items of
   fewer than eight words must occur word for word.

No passage that step 4 would confirm is missed by step 3; the tests hold it against brute force. Words are runs of
letters and digits, case folded, so punctuation and case don't hide a leak.

Defined cases: null texts are empty, texts and items without words match nothing; repeated rows are reported as often as
they occur, items with the same words each under their own id; very long texts are searched whole, passage by passage,
and very long items by the passages around their middle; a corpus of a few documents is searched like any other; an
empty corpus or benchmark gives an empty result; further columns, whatever their names, are ignored by
:func:`find_leaks` and pass through :func:`decontaminate`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nodeloom.llm.common import LETTERS, U64, chunks, texts_of, words

BITS, BLOCK, PER_PASSAGE, STEP = 18, 16, 4, 2
#: Of an item's rarest words so many must stand in a passage before it is looked at, whatever its cosine.
HITS = 4
_TERMS = 1 << BITS
_GROUPS = 64


def _fold_latin(data: np.ndarray) -> np.ndarray:
    """Upper-case letters of the Latin-1 supplement in UTF-8 become lower-case; A-Z are folded by the word hash."""
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
    if not len(upper):
        return data
    out = data.copy()
    out[upper] += 0x20
    return out


def _word_lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, hashes of its words, where each row's begin."""
    for i, j, part, at in chunks(*texts_of(column)):
        _, _, row, hashed = words(_fold_latin(part), at, LETTERS)
        yield i, hashed, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=j - i))))


def _term(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U64(64 - BITS)).astype(np.int64)


def term_counts(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that have each term, and documents in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(_TERMS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, hashed, begin in _word_lists(b.column(0)):
                row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                once = np.unique((row << BITS) | _term(hashed))
                total += np.bincount(once & (_TERMS - 1), minlength=_TERMS)
        if rows:
            width = _TERMS // _GROUPS
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_GROUPS), pa.int32()), pa.array([total[k * width : (k + 1) * width].astype(np.int32).tobytes() for k in range(_GROUPS)], pa.binary()), pa.array([rows if k == 0 else 0 for k in range(_GROUPS)], pa.int64())], names=["block", "data", "rows"])

    def merge(table: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in table["data"]], axis=0)
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "data": pa.array([data.tobytes()], pa.binary()), "rows": pa.array([sum(table["rows"].to_pylist())], pa.int64())})

    schema = "block int, data binary, rows long"
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema).collect()
    out = np.zeros(_TERMS, np.int64)
    width = _TERMS // _GROUPS
    for r in parts:
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["data"], np.int64)
    return out, sum(r["rows"] for r in parts)


@dataclass
class Items:
    """A block of benchmark items: ids, words, answers, and their terms."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[str], answers: list[str | None]) -> Items:
        def lists(x: list[str]) -> list[np.ndarray]:
            return [hashed[a:b] for _, hashed, begin in _word_lists(pa.array(x, pa.large_string())) for a, b in zip(begin[:-1], begin[1:], strict=True)]

        last = [a if a is not None else re.split(r"(?<=[.!?])\s+", t.strip())[-1] for t, a in zip(texts, answers, strict=True)]
        return cls(ids, lists(texts), lists(last))

    def terms(self) -> np.ndarray:
        return np.unique(_term(np.concatenate([*self.words, np.zeros(0, U64)])))


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class SharedWords:
    """Finds the passages that share as many words with an item as ``confirm`` asks for, whatever the words weigh.

    Where ``least`` of an item's n words stand in a passage, HITS or more of its n - least + HITS rarest do. Which words
    count as rarest decides the work only, never what is found.
    """

    def __init__(self, items: Items, counts: np.ndarray) -> None:
        size = np.array([len(w) for w in items.words], np.int64)
        self.least = np.where(size < 8, size, -(-6 * size // 10))
        self.hits, self.half = np.minimum(HITS, self.least), size // 2
        self.times = [Counter(w.tolist()) for w in items.words]
        rare = [np.unique(w[np.argsort(counts[_term(w)], kind="stable")[: n - t + h]]) for w, n, t, h in zip(items.words, size, self.least, self.hits, strict=True)]
        word = np.concatenate([*rare, np.zeros(0, U64)])
        order = np.argsort(word, kind="stable")
        self.item = np.repeat(np.arange(len(rare)), [len(w) for w in rare])[order]
        self.word, first = np.unique(word[order], return_index=True)
        self.first = np.append(first, len(word))
        self.listed = np.zeros(_TERMS, bool)
        self.listed[_term(self.word)] = True

    def enough(self, text: np.ndarray, k: int) -> bool:
        """Could ``text`` have as many words of item ``k`` in common as a confirmation needs?"""
        times = self.times[k]
        return sum(map(times.__getitem__, times.keys() & set(text.tolist()))) >= self.least[k]

    def find(self, hashed: np.ndarray, begin: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item); ``passages`` says where each row's begin in ``_windows``."""
        at = np.flatnonzero(self.listed[_term(hashed)])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.minimum(np.searchsorted(self.word, hashed[at]), len(self.word) - 1)
        same = self.word[word] == hashed[at]
        at, word = at[same], word[same]
        n = self.first[word + 1] - self.first[word]
        at, item = np.repeat(at, n), self.item[_spread(self.first[word], n)]
        row = np.searchsorted(begin, at, "right") - 1
        pair = row * len(self.hits) + item
        order = np.argsort(pair, kind="stable")
        at, item, row, pair = at[order] - begin[row[order]], item[order], row[order], pair[order]
        # runs of HITS words of the same item in the same row, and the passages (with half an item either side) they fit in
        end = np.arange(len(at)) + self.hits[item] - 1
        run = np.flatnonzero(end < len(at))
        run = run[pair[end[run]] == pair[run]]
        item, row, half = item[run], row[run], self.half[item[run]]
        step, width = BLOCK * STEP, BLOCK * PER_PASSAGE
        lo = np.maximum(0, -((width - 1 + half - at[end[run]]) // step))
        hi = np.minimum(passages[row + 1] - passages[row] - 1, (at[run] + half) // step)
        n = np.maximum(0, hi - lo + 1)
        both = np.unique((passages[row[np.repeat(np.arange(len(n)), n)]] + _spread(lo, n)) * len(self.hits) + np.repeat(item, n))
        return both // len(self.hits), both % len(self.hits)


class Space:
    """The latent space: which terms it has, their weights, its basis and the items in it."""

    def __init__(self, items: Items, counts: np.ndarray, total: int) -> None:
        self.items = items
        self.shared = SharedWords(items, counts)
        self.weight = np.log((total + 1) / (counts + 1)).astype(np.float32)
        self.weight[counts > 0.2 * max(total, 1)] = 0  # stop words
        terms = items.terms()
        self.terms = terms[self.weight[terms] > 0]
        self.place = np.full(_TERMS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        self.rows = np.zeros((len(items.ids), len(self.terms)), np.float32)
        for k, w in enumerate(items.words):
            at = self.place[_term(w)]
            np.add.at(self.rows[k], at[at >= 0], self.weight[self.terms[at[at >= 0]]])
        self.basis = np.zeros((len(self.terms), 0), np.float32)

    def passages(self, hashed: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """Blocks' (first word, row), and per word in the space: (block, place, weight); per block the norm's square."""
        n = np.diff(begin)
        blocks = (n + BLOCK - 1) // BLOCK
        row = np.repeat(np.arange(len(n)), n)
        first_block = np.concatenate(([0], np.cumsum(blocks)))
        block = first_block[row] + (np.arange(len(hashed)) - begin[row]) // BLOCK
        term = _term(hashed)
        weight = self.weight[term]
        mass = np.bincount(block, weight.astype(np.float64) ** 2, minlength=first_block[-1])
        use = np.flatnonzero(self.place[term] >= 0)
        return first_block, block[use], self.place[term[use]], weight[use], mass


def _windows(first_block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first block and end block of each passage."""
    blocks = np.diff(first_block)
    n = np.where(blocks > 0, np.maximum(0, (blocks - PER_PASSAGE + STEP - 1) // STEP) + 1, 0)
    row = np.repeat(np.arange(len(blocks)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = first_block[row] + k * STEP
    return row, begin, np.minimum(begin + PER_PASSAGE, first_block[row + 1])


#: With at most so many terms a task adds up half of A^T A itself (32 MB), pair by pair of words that stand together.
_GRAM_TERMS = 4096


def _entries(space: Space, hashed: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term's place and value of the entries of A that are not 0, by passage and place; passages have length 1."""
    first_block, block, place, weight, _ = space.passages(hashed, begin)
    _, a, e = _windows(first_block)
    lo = np.searchsorted(block, a)
    n = np.searchsorted(block, e) - lo
    at, d = _spread(lo, n), max(1, len(space.terms))
    key = np.repeat(np.arange(len(n)) * d, n) + place[at]
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    value = np.add.reduceat(weight[at[order]].astype(np.float64), first) if len(first) else np.zeros(0)
    row = key // d
    length = np.sqrt(np.bincount(row, value**2, minlength=len(n)))
    return row, key - row * d, (value / np.maximum(length[row], 1e-6)).astype(np.float32)


def _add_pairs(half: np.ndarray, d: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
    """Adds the products of all two entries of a passage to the upper half of A^T A, whose rows stand end to end."""
    count = np.bincount(row)
    left = np.cumsum(count)[row] - np.arange(len(row)) if len(row) else row  # entries of the passage from here on
    base = place * d - place * (place + 1) // 2
    for k in range(int(count.max(initial=0))):
        at = np.flatnonzero(left > k)
        np.add.at(half, base[at] + place[at + k], value[at] * value[at + k])


def _times(half: np.ndarray, omega: np.ndarray, step: int = 256) -> np.ndarray:
    """The symmetric matrix with this upper half times ``omega``, some rows at a time."""
    d, out = len(omega), np.zeros_like(omega)
    for i in range(0, d, step):
        rows = np.arange(i, min(i + step, d))
        part = np.zeros((len(rows), d), np.float32)
        for r in rows.tolist():
            first = r * d - r * (r + 1) // 2
            part[r - i, r:] = half[first + r : first + d]
        out[rows] += part @ omega
        part[rows - i, rows] = 0
        out += part.T @ omega[rows]
    return out


def fit_space(space: Space, docs: DataFrame, total: int, text_col: str = "text", rank: int = 256, seed: int = 5) -> None:
    """Sets ``space.basis`` by a distributed randomised SVD over every passage of ``docs``, ``total`` rows."""
    d = len(space.terms)
    if not d:
        return
    omega = np.random.default_rng(seed).standard_normal((d, min(rank, d))).astype(np.float32)
    step = max(1, (d + 15) // 16)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, half = np.zeros_like(omega), np.zeros(d * (d + 1) // 2 if d <= _GRAM_TERMS else 0, np.float32)
        for b in batches:
            for _, hashed, begin in _word_lists(b.column(0)):
                row, place, value = _entries(space, hashed, begin)
                if len(half):
                    _add_pairs(half, d, row, place, value)
                    continue
                for i in range(0, int(row[-1]) + 1 if len(row) else 0, 512):  # dense passages, some at a time
                    p, q = np.searchsorted(row, (i, i + 512))
                    x = np.zeros((512, d), np.float32)
                    x[row[p:q] - i, place[p:q]] = value[p:q]
                    out += x.T @ (x @ omega)
        if len(half):
            out = _times(half, omega)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([out[k * step : (k + 1) * step].tobytes() for k in range(16)], pa.binary())], names=["block", "data"])

    def merge(table: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x.as_py(), np.float32) for x in table["data"]], axis=0, dtype=np.float64).astype(np.float32)
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # a product each: with more there is only more to send
    parts = docs.select(F.col(text_col).cast("string")).coalesce(tasks).mapInArrow(multiply, "block int, data binary").groupBy("block").applyInArrow(merge, "block int, data binary").collect()
    product = np.zeros_like(omega)
    for r in parts:
        got = np.frombuffer(r["data"], np.float32).reshape(-1, omega.shape[1])
        product[r["block"] * step : r["block"] * step + len(got)] = got
    own = space.rows / np.maximum(np.linalg.norm(space.rows, axis=1, keepdims=True), 1e-6)
    product += 100.0 * max(1.0, total / 2000) * (own.T @ (own @ omega))  # the items' own rows count most, however many documents there are
    space.basis = np.linalg.qr(product)[0].astype(np.float32)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one step on a bit vector per word of ``text``."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for w in text.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _holds(text: np.ndarray, item: np.ndarray) -> bool:
    at = np.flatnonzero(text[: len(text) - len(item) + 1] == item[0]) if len(text) >= len(item) else []
    return any((text[a : a + len(item)] == item).all() for a in at)


def confirm(text: np.ndarray, item: np.ndarray, answer: np.ndarray) -> tuple[bool, float, float]:
    """(leak?, share of the item, share of the answer) in ``text``."""
    if len(item) < 8:
        return (True, 1.0, 1.0) if _holds(text, item) else (False, 0.0, 0.0)
    share = common_subsequence(item, text) / len(item)
    if share < 0.6:
        return False, share, 0.0
    told = common_subsequence(answer, text) / len(answer) if len(answer) else 1.0
    return share >= 0.8 or told >= 0.6, share, told


class Searcher:
    def __init__(self, space: Space, cosine: float = 0.35, held: float = 0.6) -> None:
        self.space, self.cosine, self.held = space, cosine, held
        latent = space.rows @ space.basis  # items x rank
        self.table = np.ascontiguousarray(space.basis @ latent.T)  # terms x items: a word's part in each inner product
        self.norm = np.linalg.norm(latent, axis=1)

    def candidates(self, hashed: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first word, end word, item, cosine) of passages that may hold an item."""
        s = self.space
        first_block, block, place, weight, mass = s.passages(hashed, begin)
        row, a, e = _windows(first_block)
        known = np.concatenate(([0.0], np.cumsum(np.bincount(block, weight.astype(np.float64) ** 2, minlength=first_block[-1]))))
        all_ = np.concatenate(([0.0], np.cumsum(mass)))
        own, whole = known[e] - known[a], all_[e] - all_[a]
        least = float(self.norm[self.norm > 0].min()) if (self.norm > 0).any() else np.inf
        # neither measure can be reached unless enough of the passage's weight lies in the space
        use = np.flatnonzero((own > 0) & ((own >= self.cosine**2 * 0.8 * whole) | (np.sqrt(own) >= 0.5 * self.held * least)))
        lo, hi = np.searchsorted(block, a[use]), np.searchsorted(block, e[use])
        rows: list[np.ndarray] = []
        cols: list[np.ndarray] = []
        cos: list[np.ndarray] = []
        for i in range(0, len(use), 256):
            p, q = int(lo[i]), int(hi[min(i + 256, len(use)) - 1])
            each = np.zeros((q - p + 1, self.table.shape[1]), np.float32)
            np.cumsum(self.table[place[p:q]] * weight[p:q, None], axis=0, out=each[1:])
            dot = each[hi[i : i + 256] - p] - each[lo[i : i + 256] - p]
            cosine = dot / np.maximum(np.sqrt(whole[use[i : i + 256]])[:, None] * self.norm[None, :], 1e-6)
            held = dot / np.maximum(self.norm[None, :] ** 2, 1e-6)
            r, c = np.nonzero(((cosine >= self.cosine) | (held >= self.held)) & (self.norm > 0)[None, :])
            rows.append(use[i + r])
            cols.append(c)
            cos.append(cosine[r, c])
        at = np.concatenate([*rows, np.zeros(0, np.int64)])
        item = np.concatenate([*cols, np.zeros(0, np.int64)])
        more, items = s.shared.find(hashed, begin, np.searchsorted(row, np.arange(len(begin))))
        new = ~np.isin(more * len(self.norm) + items, at * len(self.norm) + item)
        more, items = more[new], items[new]
        lo = np.searchsorted(block, a[more])
        n = np.searchsorted(block, e[more]) - lo
        word = _spread(lo, n)
        dot = np.bincount(np.repeat(np.arange(len(n)), n), self.table[place[word], np.repeat(items, n)] * weight[word], minlength=len(n))
        cos.append(dot / np.maximum(np.sqrt(whole[more]) * self.norm[items], 1e-6))
        at, item = np.concatenate([at, more]), np.concatenate([item, items])
        order = np.lexsort((item, at))
        at, item, cos = at[order], item[order], [np.concatenate(cos)[order]]
        r = row[at]
        first = begin[r] + (a[at] - first_block[r]) * BLOCK
        return r, first, np.minimum(first + BLOCK * (e[at] - a[at]), begin[r + 1]), item, np.concatenate([*cos, np.zeros(0)])

    def hits(self, column: pa.Array) -> Iterator[tuple[int, object, float, float, float]]:
        """(row, item id, cosine, share of the item, share of the answer), the best passage of each pair."""
        items = self.space.items
        for i, hashed, begin in _word_lists(column):
            row, first, end, item, cosine = self.candidates(hashed, begin)
            best: dict[tuple[int, int], tuple] = {}
            for r, a, b, k, c in zip(row.tolist(), first.tolist(), end.tolist(), item.tolist(), cosine.tolist(), strict=True):
                if (r, k) in best and best[r, k][1] >= 0.999:
                    continue
                half = len(items.words[k]) // 2
                text = hashed[max(begin[r], a - half) : min(begin[r + 1], b + half)]
                if not self.space.shared.enough(text, k):
                    continue
                leak, share, told = confirm(text, items.words[k], items.answers[k])
                if leak and (share, c) > (best.get((r, k), (0, 0))[1], best.get((r, k), (0, 0))[0]):
                    best[r, k] = (c, share, told)
            for (r, k), (c, share, told) in sorted(best.items()):
                yield i + r, items.ids[k], float(c), share, told


#: A block of items ends before its table, words x items in single precision, could take more than 64 MB (or at one item).
_TABLE = 1 << 24


def _searchers(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, answer_col: str | None, block: int) -> Iterator[Broadcast]:
    """A searcher for each block of items; what is broadcast is bounded by ``block`` and by :data:`_TABLE`."""
    rows = benchmark.select(F.col(item_col), F.coalesce(F.col("text").cast("string"), F.lit("")), (F.col(answer_col) if answer_col else F.lit(None)).cast("string")).orderBy(item_col, "text")
    counts, total = term_counts(docs, text_col)
    held: list = []
    total_words = 0

    def ready() -> Broadcast:
        space = Space(Items.of([r[0] for r in held], [r[1] for r in held], [r[2] for r in held]), counts, total)
        fit_space(space, docs, total, text_col)
        return docs.sparkSession.sparkContext.broadcast(Searcher(space))

    for r in rows.toLocalIterator():
        more = min(_TERMS, len(r[1].split()))
        if held and (len(held) == block or min(_TERMS, total_words + more) * (len(held) + 1) > _TABLE):
            yield ready()
            held, total_words = [], 0
        held.append(r)
        total_words += more
    if held:
        yield ready()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None, block: int = 1000) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer double"

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = list(shared.value.hits(b.column(1)))
                take = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), *[pa.array([h[k] for h in hits], t) for k, t in ((1, arrow), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]], names=["doc_id", "item_id", "cosine", "lcs", "answer"])

        return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)

    found = [search(s) for s in _searchers(docs, benchmark, text_col, item_col, answer_col, block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None, block: int = 1000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they were; rows are filtered where they are."""
    out = docs
    for shared in _searchers(docs, benchmark, text_col, item_col, answer_col, block):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in shared.value.hits(b.column(b.schema.get_field_index(text_col)))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
