"""Texts into containers of fixed capacity (Martello-Toth dominance reduction, then best fit).

Only the histogram of sizes, at most one row per size up to the largest capacity, decides the
packing; it is bounded by the capacity, not by the data. The plan lists container patterns with
multiplicities. Rows are then numbered inside their size by partition prefix sums and each takes the
slot of its number, so no task holds more than its own rows.

Kinds are filled from the largest down. Sizes above the next smaller capacity must go into the kind;
smaller ones fill what is left there, the others go on to the next kind.

Defined results: a text above the largest capacity becomes full pieces and a rest; NULL and empty
texts have size 0, take no space and get no container (NULL kind and number); repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.durable import durable
from vertexloom.operators.hotkeys import number_rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: A rank file is sent to all tasks; no public one is larger.
MAX_BYTES = 64 << 20

_encoders: dict = {}


def encoder(name: str, ranks: bytes):
    """The tokenizer of a rank file's content, built once per process."""
    if name not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): sizes of the whole texts; NULL counts as empty.

    Only the driver needs the rank file: its content goes to the tasks.
    """
    ranks = Path(tokenizer).read_bytes()
    if len(ranks) > MAX_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, sent.value).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(count, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


class Stock:
    """Sizes with counts, in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items when one item of size ``without`` is set aside."""
        out: list[int] = []
        for s in self.sizes:
            n = self.count[s] - (s == without)
            out += [s] * min(n, k - len(out))
            if len(out) == k:
                break
        return out


def _dominant(stock: Stock, j: int, c: int) -> tuple[int, ...] | None:
    """A set with j, of at most three items, that dominates every feasible set with j; None if unproven."""
    room = c - j
    small = stock.smallest(3, j)
    if not small or small[0] > room:
        return (j,)
    at = bisect_right(stock.sizes, room) - 1
    if stock.sizes[at] == j and stock.count[j] == 1:
        at -= 1
    k = stock.sizes[at]
    if k == room or len(small) == 1 or small[0] + small[1] > room:
        return (j, k)
    sizes = np.array(stock.sizes[: at + 1])
    partner = np.searchsorted(sizes, room - sizes, side="right") - 1
    partner = np.minimum(partner, np.arange(len(sizes)))
    for i in np.flatnonzero((partner >= 0) & (partner == np.arange(len(sizes)))):
        if stock.count[int(sizes[i])] - (int(sizes[i]) == j) < 2:
            partner[i] -= 1
    total = np.where(partner >= 0, sizes + sizes[np.maximum(partner, 0)], -1)
    best = int(total.max())
    only_two = len(small) < 3 or sum(small) > room
    if only_two and k >= best:
        return (j, k)
    if only_two and partner[at] >= 0 and total[at] == best:
        b = int(sizes[partner[at]])
        above = [s for s in stock.sizes[bisect_right(stock.sizes, b) :][:3] for _ in range(min(2, stock.count[s] - (s == j)))][:2]
        if len(above) < 2 or sum(above) > room:  # every feasible pair has a member up to b and one up to k
            return (j, k, b)
    return None


def reduce_dominated(stock: Stock, c: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix proven sets for the sizes above ``least``, largest first, and remove them from the stock."""
    fixed = []
    j = stock.sizes[bisect_right(stock.sizes, c) - 1] if stock.sizes and stock.sizes[0] <= c else 0
    while j > least:
        found = _dominant(stock, j, c)
        if found:
            need = {s: found.count(s) for s in found}
            n = min(stock.count[s] // q for s, q in need.items())
            for s, q in need.items():
                stock.take(s, q * n)
            fixed.append((found, n))
        if not found or j not in stock.count:
            at = bisect_left(stock.sizes, j) - 1
            if at < 0:
                break
            j = stock.sizes[at]
    return fixed


def best_fit(stock: Stock, c: int, least: int, open_bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by groups of equal containers. Sizes up to ``least`` only fill open ones."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rest: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        r = c - sum(pattern)
        if r not in groups:
            groups[r] = []
            insort(rest, r)
        groups[r].append((pattern, n))

    for p, n in open_bins:
        put(p, n)
    for s in [x for x in reversed(stock.sizes) if x <= c]:
        left = stock.count[s]
        while left:
            at = bisect_left(rest, s)
            if at == len(rest):
                if s <= least:
                    break
                per, room, (pattern, n) = c // s, None, ((), -(-left // (c // s)))
            else:
                room = rest[at]
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rest.pop(at)
                per = room // s
            full = min(n, left // per)
            odd = min(left - full * per, per) if full < n else 0
            for pat, m in ((pattern + (s,) * per, full), (pattern + (s,) * odd, 1 if odd else 0), (pattern, n - full - (1 if odd else 0))):
                if m and pat:
                    put(pat, m)
            stock.take(s, full * per + odd)
            left -= full * per + odd
    return [g for r in rest for g in groups[r]]


def plan(histogram: dict[int, int], kinds: list[tuple[str, int]]) -> list[tuple[str, tuple[int, ...], int]]:
    """(kind, sizes in the container, number of such containers) for all items of the histogram."""
    stock = Stock(histogram)
    out: list[tuple[str, tuple[int, ...], int]] = []
    order = sorted(kinds, key=lambda k: -k[1])
    for (kind, c), (_, below) in zip(order, [*order[1:], ("", 0)]):
        fixed = reduce_dominated(stock, c, below)
        out += [(kind, p, n) for p, n in best_fit(stock, c, below, fixed)]
    return out


def pack(sizes: DataFrame, key: str, size: str, kinds: list[tuple[str, int]]) -> DataFrame:
    """(key, piece, n_tokens, container_kind, container_no) with every piece of every row in one container."""
    most = max(c for _, c in kinds)
    pieces = F.greatest(F.ceil(F.col(size) / F.lit(most)).cast("int"), F.lit(1))
    rows = sizes.select(F.col(key), F.col(size).alias("__s"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    rows = durable(rows.select(key, "piece", F.least(F.col("__s") - (F.col("piece") - 1) * F.lit(most), F.lit(most)).cast("bigint").alias("n_tokens")))
    histogram = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = {kind: 0 for kind, _ in kinds}
    code = {kind: i for i, (kind, _) in enumerate(kinds)}
    for kind, pattern, n in plan(histogram, kinds):
        for s in set(pattern):
            per = pattern.count(s)
            slots.setdefault(s, []).append((used.get(s, 0), per, base[kind], code[kind]))
            used[s] = used.get(s, 0) + per * n
        base[kind] += n
    table = {s: np.array(v, dtype=np.int64).T for s, v in slots.items()}
    names = [kind for kind, _ in kinds]
    numbered = number_rows(rows, ["n_tokens"], "__nth").select(key, "piece", "n_tokens", "__nth")
    kind_of = sizes.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size_, nth = b.column(2).to_numpy(), b.column(3).to_numpy()
            which, number = np.full(len(nth), -1, dtype=np.int64), np.zeros(len(nth), dtype=np.int64)
            for s in np.unique(size_):
                if int(s) in table:
                    start, per, first, kind = table[int(s)]
                    own = size_ == s
                    at = np.searchsorted(start, nth[own], side="right") - 1
                    number[own] = first[at] + (nth[own] - start[at]) // per[at]
                    which[own] = kind[at]
            missing = which < 0
            kinds_ = pa.array([None if w < 0 else names[w] for w in which], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], kinds_, pa.array(number, mask=missing)], names=[key, "piece", "n_tokens", "container_kind", "container_no"])

    return numbered.mapInArrow(assign, f"`{key}` {kind_of}, piece int, n_tokens bigint, container_kind string, container_no bigint")
