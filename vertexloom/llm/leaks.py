"""Evaluation texts inside training text (SimHash windows, multi-index Hamming blocks, exact check).

Item texts are cut into windows of ``WINDOW`` words at every offset, documents into windows at every
``WINDOW``-th word: any shared run of at least 2 * WINDOW - 1 words holds a whole document window.
Windows get a 64-bit SimHash over five-word shingles. With radius 3 the fingerprint is cut into four
blocks of 16 bits: fingerprints within the radius agree in at least one block, so the block index
misses none. Candidates are verified by the weighted similarity of their shingles, and the shared run
is then measured word by word.

That serves runs. Merely similar windows (``min_run`` 0) differ by more bits than the radius, so they
are found without fingerprints: document windows at every word, against every item window that shares
a shingle with them. Their ``longest_run`` is 0 where no whole window is the same.

Defined results: words are the maximal runs of ASCII letters and digits after lower-casing; NULL and
empty texts share nothing; repeated rows give the same pair once; items shorter than a window or
documents shorter than the run give no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, SHINGLE, RADIUS, BLOCKS = 15, 5, 3, 4
SIMILARITY = 0.8
#: So many (document window, item window) entries are compared at once.
ENTRIES = 1 << 20
#: So many items are matched at once; more items take further passes over the documents.
ITEMS_A_PASS = 5000
_WORD = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(code: np.ndarray) -> np.ndarray:
    """Hash of the five words that begin at each place of the last axis."""
    n = code.shape[-1] - SHINGLE + 1
    h = np.zeros((*code.shape[:-1], n), dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[..., k : k + n].astype(np.uint64) + np.uint64(1)
    return _mix(h)


def _simhash(shingles: np.ndarray) -> np.ndarray:
    """One fingerprint a row of shingle hashes: the majority of each bit."""
    rows, k = shingles.shape
    out = np.empty(rows, dtype=np.uint64)
    for lo in range(0, rows, 1 << 14):  # bounds the unpacked bits to some ten megabytes
        part = np.ascontiguousarray(shingles[lo : lo + (1 << 14)])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), k, 8), axis=2)
        out[lo : lo + (1 << 14)] = np.packbits(2 * bits.sum(axis=1, dtype=np.uint8) > k, axis=1).view(np.uint64).ravel()
    return out


def _distinct(rows: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of each value in sorted rows; row and number of those that are known."""
    first = np.ones(rows.shape, dtype=bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    row, value = np.nonzero(first)[0], rows[first]
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    there = known[at] == value
    return first, row[there], at[there]


class ItemIndex:
    """Windows of the items, by each 16-bit block of their fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        texts = [(i, words(t)) for i, t in items]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.items = [(i, np.array([self.vocabulary[w] for w in ws], dtype=np.int64)) for i, ws in texts]
        where = [(n, k) for n, (_, c) in enumerate(self.items) for k in range(len(c) - WINDOW + 1)]
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)
        rows = np.array([self.items[n][1][k : k + WINDOW] for n, k in where], dtype=np.int64).reshape(-1, WINDOW)
        self.words = rows
        self.shingles = np.sort(_shingles(rows), axis=1)
        self.prints = _simhash(_shingles(rows))
        self.blocks = []
        for b in range(BLOCKS):
            part = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            self.blocks.append((order, np.searchsorted(part[order], np.arange(0x10001))))
        # Shingles common to many items say less: weight 1 / number of items that hold it.
        owner = np.repeat(self.where[:, 0], self.shingles.shape[1])
        pairs = np.unique(np.stack([self.shingles.ravel(), owner.astype(np.uint64)]), axis=1)
        known, count = np.unique(pairs[0], return_counts=True)
        self.known, self.weight = known, 1.0 / count

    def invert(self) -> None:
        """Item windows by shingle, and the weight of each window."""
        row, known = _distinct(self.shingles, self.known)[1:]
        order = np.argsort(known, kind="stable")
        self.held, self.start = row[order], np.searchsorted(known[order], np.arange(len(self.known) + 1))
        self.total = np.bincount(row, self.weight[known], len(self.where))

    def similar(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document window, item window, similarity) of all pairs that reach it, by rising document window."""
        every, per = _shingles(code), WINDOW - SHINGLE + 1
        at = np.minimum(np.searchsorted(self.known, every), len(self.known) - 1)
        held = np.concatenate([[0], np.cumsum(self.known[at] == every)])
        # A shingle of no item weighs 1 and none weighs more, so known ones must outnumber it.
        maybe = np.flatnonzero(held[per:] - held[:-per] >= int(SIMILARITY / (1 - SIMILARITY)))
        for lo in range(0, len(maybe), 1 << 15):
            q = maybe[lo : lo + (1 << 15)]
            rows = np.sort(np.lib.stride_tricks.sliding_window_view(every, per)[q], axis=1)
            first, row, known = _distinct(rows, self.known)
            own = (self.weights(rows) * first).sum(axis=1)
            keep = np.bincount(row, self.weight[known], len(q)) >= (SIMILARITY - 1e-9) * own
            row, known = row[keep[row]], known[keep[row]]
            n = self.start[known + 1] - self.start[known]
            cut = np.cumsum(np.bincount(row, n, len(q))).astype(np.int64) // ENTRIES  # rises with the row
            for part in np.unique(cut[row]):
                r, k, m = (x[cut[row] == part] for x in (row, known, n))
                w = self.held[np.repeat(self.start[k] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                pairs, where = np.unique(np.repeat(r, m) * len(self.where) + w, return_inverse=True)
                shared = np.bincount(where, np.repeat(self.weight[k], m))
                r, w = pairs // len(self.where), pairs % len(self.where)
                score = shared / (own[r] + self.total[w] - shared)
                good = score >= SIMILARITY - 1e-9
                yield q[r[good]], w[good], score[good]

    def near(self, code: np.ndarray) -> dict[int, list]:
        """item: [longest run of at least a window, best similarity] of a document's words."""
        owner, rows = self.where[:, 0], np.lib.stride_tricks.sliding_window_view(code, WINDOW)
        best, runs = np.zeros(len(self.items)), np.zeros(len(self.items), dtype=np.int64)
        last, carry = -2, np.zeros(len(owner), dtype=np.int64)  # runs that end at the last window of the part before
        for q, w, score in self.similar(code):
            np.maximum.at(best, owner[w], score)
            same = (rows[q] == self.words[w]).all(axis=1)
            q, w = q[same], w[same]
            if not len(q):
                continue
            order = np.lexsort((q, w - q))
            q, w = q[order], w[order]
            new = np.ones(len(q), dtype=bool)
            new[1:] = (np.diff(q) != 1) | (np.diff(w) != 1) | (np.diff(owner[w]) != 0)
            begin = np.flatnonzero(new)
            before = np.where((q[begin] == last + 1) & (w[begin] > 0) & (owner[w[begin] - 1] == owner[w[begin]]), carry[w[begin] - 1], 0)
            chain = np.cumsum(new) - 1
            length = np.arange(len(q)) - begin[chain] + 1 + before[chain]
            np.maximum.at(runs, owner[w], length + WINDOW - 1)
            last, carry = q.max(), np.zeros(len(owner), dtype=np.int64)
            carry[w[q == last]] = length[q == last]
        return {int(n): [int(runs[n]), float(best[n])] for n in np.flatnonzero(best)}

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, item window) pairs within the radius, each once."""
        found = []
        for b, (order, start) in enumerate(self.blocks):
            part = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = start[part + 1] - start[part]
            q = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[part], n)
            w = order[at]
            near = np.bitwise_count(prints[q] ^ self.prints[w]) <= RADIUS
            found.append(np.stack([q[near], w[near]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """Weight of each shingle; one that no item holds weighs as much as one of a single item."""
        if not len(self.known):
            return np.ones(shingles.shape)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], 1.0)

    def similarity(self, query: np.ndarray, window: int) -> float:
        """Weighted Jaccard similarity of two windows' shingles."""
        a, b = np.unique(query), np.unique(self.shingles[window])
        both = np.intersect1d(a, b)
        shared = self.weights(both).sum()
        return float(shared / (self.weights(a).sum() + self.weights(b).sum() - shared))


def _matches(index: ItemIndex, batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    get = index.vocabulary.get
    if not min_run and len(index.where):
        index.invert()
    for batch in batches:
        out = set()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = words(text)
            if len(ws) < WINDOW or not len(index.where):
                continue
            code = np.fromiter(map(get, ws, repeat(0)), dtype=np.int64, count=len(ws))
            if not min_run:
                out.update((index.items[n][0], doc, run, round(score, 6)) for n, (run, score) in index.near(code).items())
                continue
            rows = code[: len(code) // WINDOW * WINDOW].reshape(-1, WINDOW)
            # A window with two foreign words lacks two of its eleven shingles or more: below the similarity.
            hot = np.flatnonzero((rows == 0).sum(axis=1) <= 1)
            if not len(hot):
                continue
            shingles = _shingles(rows[hot])
            best: dict[int, list] = {}
            for q, w in zip(*index.candidates(_simhash(shingles))):
                score = index.similarity(shingles[q], w)
                if score < SIMILARITY:
                    continue
                n, at = index.where[w]
                item = index.items[n][1]
                k = int(hot[q]) * WINDOW
                run = 0
                if np.array_equal(rows[hot[q]], item[at : at + WINDOW]):
                    lo = min(k, at)
                    back = code[k - lo : k][::-1] == item[at - lo : at][::-1]
                    hi = min(len(code) - k, len(item) - at)
                    ahead = code[k : k + hi] == item[at : at + hi]
                    run = (len(back) if back.all() else int(back.argmin())) + (len(ahead) if ahead.all() else int(ahead.argmin()))
                got = best.setdefault(n, [0, 0.0])
                got[0], got[1] = max(got[0], run), max(got[1], score)
            out.update((index.items[n][0], doc, run, round(score, 6)) for n, (run, score) in best.items() if run >= min_run)
        if out:
            cols = list(zip(*sorted(out, key=str)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())],
                names=["item_id", "doc_id", "longest_run", "similarity"],
            )


def leaks(documents: DataFrame, items: DataFrame, min_run: int = 30) -> DataFrame:
    """(item_id, doc_id, longest_run, similarity) of documents with a window of an item.

    ``min_run`` keeps pairs that share so many consecutive words; 0 keeps every pair with similar windows.
    The items are a stated query set: they are matched in passes of at most ``ITEMS_A_PASS``.
    """
    if min_run and min_run < 2 * WINDOW - 1:
        raise ValueError(f"runs below {2 * WINDOW - 1} words need smaller windows")
    source = documents.select("doc_id", "text")
    schema = "item_id bigint, doc_id bigint, longest_run int, similarity double"
    result = None
    rows = items.select("item_id", "text").dropna(subset=["item_id"]).toLocalIterator()
    block: list[tuple[int, str | None]] = []

    def one_pass(block: list) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _matches(ItemIndex(sent.value), batches, min_run)

        return source.mapInArrow(run, schema)

    for r in rows:
        block.append((r["item_id"], r["text"]))
        if len(block) == ITEMS_A_PASS:
            result, block = (one_pass(block) if result is None else result.unionByName(one_pass(block))), []
    if block or result is None:
        result = one_pass(block) if result is None else result.unionByName(one_pass(block))
    return result.distinct()
