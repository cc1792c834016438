"""Periodic runs of words: maximal stretches that repeat with a period, by difference-cover LCE.

Documents stay in the tasks that read them; a task sets the words of many documents in one row of numbers, with a
number of its own after each document, and finds the runs of all of them at once.

For each period q the places k * q of a document form a grid. A run of at least 2 * q words with period q covers
some i and i + q of it, so extending such pairs of equal words to both sides gives all runs; the pairs of all periods are n * ln(n).
Extensions that outlast a few words are answered by an index: only suffixes at the places of a difference cover modulo 13
are sorted, any two places need at most 12 further words to be in the cover both, and from there on a sparse
table of least common prefixes answers.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty

#: Differences of these are all residues modulo 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Words that are set in one row (a longer document is a row by itself), and pairs that are looked at together.
TOGETHER, PAIRS = 100_000, 1_000_000

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class CoverIndex:
    """Longest common extensions to the right in a row of numbers whose last one stands nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, n = symbols, len(symbols)
        member, steps = np.isin(np.arange(MODULUS), COVER), np.arange(MODULUS)
        # fewest steps after which places with two residues are both in the cover
        self.shift = (member[np.add.outer(steps, steps) % MODULUS][:, None, :] & member[np.add.outer(steps, steps) % MODULUS][None, :, :]).argmax(axis=2)
        by_residue = [np.arange(d, n, MODULUS) for d in COVER]
        self.sampled = np.concatenate(by_residue)
        self.sample_at = np.full(n, -1, np.int64)
        self.sample_at[self.sampled] = np.arange(len(self.sampled))
        self._sort()

    def _sort(self) -> None:
        """Order of the sampled suffixes: by their first MODULUS words, then by doubling over the samples MODULUS words on."""
        m, n = len(self.sampled), len(self.symbols)
        window = np.append(self.symbols, np.full(MODULUS, -1))[self.sampled[:, None] + np.arange(MODULUS)]
        beyond = self.sampled + MODULUS
        following = np.where(beyond < n, self.sample_at[np.minimum(beyond, n - 1)], -1)
        order = np.lexsort(window.T[::-1])
        new = np.append(False, (window[order[1:]] != window[order[:-1]]).any(axis=1))
        levels = []  # (rank by so many words, the sample so many words on, words)
        width = MODULUS
        while True:
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == m - 1:
                break
            levels.append((rank, following, width))
            second = np.where(following >= 0, rank[following], -1)
            order = np.lexsort((second, rank))
            new = np.append(False, (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
            following = np.where(following >= 0, following[following], -1)
            width *= 2
        self.rank = rank
        self.table = [self._neighbours(order, levels)]
        width = 1
        while 2 * width <= m - 1:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _neighbours(self, order: np.ndarray, levels: list) -> np.ndarray:
        """Words that neighbours in the order share, from the ranks of the sort: widest stretches first, the last few words one by one."""
        x, y = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(x), np.int64)
        for rank, following, width in reversed(levels):
            same = np.flatnonzero(rank[x] == rank[y])
            common[same] += width
            x[same], y[same] = following[x[same]], following[y[same]]  # both exist: an equal stretch has no end in it
        return common + few_equal(self.symbols, self.sampled[x], self.sampled[y], MODULUS, 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b on (which differ) are equal."""
        need = self.shift[a % MODULUS, b % MODULUS]
        out = few_equal(self.symbols, a, b, need, 1)
        at = np.flatnonzero(out == need)
        x, y = self.rank[self.sample_at[a[at] + need[at]]], self.rank[self.sample_at[b[at] + need[at]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the binary logarithm
        for k in range(len(self.table)):
            now = np.flatnonzero(level == k)
            out[at[now]] += np.minimum(self.table[k][low[now]], self.table[k][high[now] - (1 << k)])
        return out


def few_equal(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int, step: int) -> np.ndarray:
    """Equal symbols from a and b on (step 1) or back (-1), counted one by one up to ``most``."""
    out = np.zeros(len(a), np.int64)
    most = np.broadcast_to(most, len(a))
    going = np.flatnonzero(most > 0)
    while len(going):
        x, y = a[going] + step * out[going], b[going] + step * out[going]
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(symbols))
        going, x, y = going[inside], x[inside], y[inside]
        going = going[symbols[x] == symbols[y]]
        out[going] += 1
        going = going[out[going] < most[going]]
    return out


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all pairs of the grids, some PAIRS at a time."""
    halves = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), halves)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    pairs = (sizes[doc] - 1) // period
    cut = np.searchsorted(np.cumsum(pairs), np.arange(PAIRS, pairs.sum() + PAIRS, PAIRS), side="right")
    for low, high in zip(np.append(0, cut), np.append(cut, len(doc)), strict=True):
        if low < high:
            n = pairs[low:high]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            d, q = np.repeat(doc[low:high], n), np.repeat(period[low:high], n)
            yield d, starts[d] + nth * q, q


def find_runs(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Rows (document, start in the row, length, period) of all runs, in order of start and period.

    ``symbols`` holds the documents' words one document after another, each followed by a number that stands nowhere else.
    """
    settled, open_ = [np.empty((0, 4), np.int64)], []
    for doc, a, q in _grid(starts, sizes):
        same = symbols[a] == symbols[a + q]
        doc, a, q = doc[same], a[same], q[same]
        right, left = few_equal(symbols, a, a + q, MODULUS, 1), few_equal(symbols, a - 1, a + q - 1, MODULUS, -1)
        more = (right == MODULUS) | (left == MODULUS)
        open_.append(np.stack([doc[more], a[more], q[more]], axis=1))
        settled.append(_rows(doc[~more], a[~more], q[~more], left[~more], right[~more], least))
    pending = np.concatenate(open_) if open_ else np.empty((0, 3), np.int64)
    if len(pending):
        settled.append(_by_index(symbols, starts, sizes, pending, least))
    rows = np.concatenate(settled)
    # the same stretch with several periods: its smallest one
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    first = np.append(True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1))[: len(rows)]
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1]))]


def _rows(doc, a, q, left, right, least: int) -> np.ndarray:
    rows = np.stack([doc, a - left, left + right + q, q], axis=1)
    return rows[rows[:, 2] >= np.maximum(least, 2 * q)]


def _by_index(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pending: np.ndarray, least: int) -> np.ndarray:
    """Pairs whose extensions outlast a few words: only their documents are indexed, in both directions."""
    docs = np.flatnonzero(np.bincount(pending[:, 0]))
    lengths = sizes[docs] + 1  # with what follows the document
    inner = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat(starts[docs] - inner, lengths)
    row = symbols[at]
    forth, back = CoverIndex(row), CoverIndex(np.append(row[:-1][::-1], row[-1]))
    out, last = [], len(row) - 2
    for k in range(0, len(pending), PAIRS):
        doc, a, q = pending[k : k + PAIRS].T
        x = a - starts[doc] + inner[np.searchsorted(docs, doc)]
        left = np.zeros(len(x), np.int64)
        inside = np.flatnonzero(x > 0)
        left[inside] = back.extension(last - (x[inside] - 1), last - (x[inside] + q[inside] - 1))
        out.append(_rows(doc, a, q, left, forth.extension(x, x + q), least))
    return np.concatenate(out)


def _blocks(ids: list, texts: pa.Array) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents with about TOGETHER words; ``bytes.split`` cuts at ASCII white space, which no other letter's bytes contain."""
    some_ids, some, size = [], [], 0
    for doc, text in zip(ids, texts, strict=True):
        words = text.as_buffer().to_pybytes().split()
        if some and size + len(words) > TOGETHER:
            yield some_ids, some
            some_ids, some, size = [], [], 0
        some_ids.append(doc)
        some.append(words)
        size += len(words)
    yield some_ids, some


def _examined(ids: list, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    sizes = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    known: dict[bytes, int] = defaultdict(itertools.count().__next__)
    symbols = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    for words, at in zip(texts, starts.tolist(), strict=True):
        symbols[at : at + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    symbols[starts + sizes] = len(known) + np.arange(len(sizes))
    rows = find_runs(symbols, starts, sizes, least)
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, rows[:, 1] + rows[:, 3], 1)
    np.add.at(edge, rows[:, 1] + rows[:, 2], -1)
    dropped = np.cumsum(edge) > 0
    bounds = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
    collapsed = []
    for k, (words, at) in enumerate(zip(texts, starts.tolist(), strict=True)):
        keep = words if bounds[k] == bounds[k + 1] else [w for w, gone in zip(words, dropped[at : at + len(words)].tolist(), strict=True) if not gone]
        collapsed.append(b" ".join(keep))
    values = pa.StructArray.from_arrays([pa.array(c) for c in (rows[:, 1] - starts[rows[:, 0]], rows[:, 2], rows[:, 3])], fields=list(RUN))
    runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in order of start and period) and collapsed of each row of ``docs``.

    docs: doc_id (integer, may be null or repeat) and text (null counts as empty); other columns are ignored. Words are runs
    of anything but ASCII white space and are told apart as they are written. A run is a stretch of at least ``least``
    words, and of at least two of its smallest period, that no neighbour extends. ``collapsed`` joins, by one space, the words
    that no run contains after its first period. Texts without words have no runs and an empty ``collapsed``; an empty
    table gives no rows. Nothing is shuffled; a document is looked at whole in one task, in memory linear in its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _blocks(batch.column(0).to_pylist(), batch.column(1)):
                if ids:
                    yield _examined(ids, texts, least)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, FOUND)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, repeat a stretch of their words from some place on to the end.

    Rows without an id, or without words, stay as they are.
    """
    h, n, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("_words").cast("bigint"), F.col("_words")
    g = F.floor(h / 10).cast("bigint")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")

    def word(w: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), w).otherwise(F.get(words, (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))

    rows = docs.select("doc_id", text_or_empty().alias("text"), (F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(WORD)).alias("_chosen"))
    chosen = rows.where("_chosen").withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumns({"_a": a, "_p": p})
    # both branches read the table; neither shuffles it
    return chosen.select("doc_id", F.array_join(F.transform("_words", word), " ").alias("text")).unionByName(rows.where("not coalesce(_chosen, false)").select("doc_id", "text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document (ties: the first, then the shortest period) and digests of all runs and of what is kept."""
    runs = F.col("runs")
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).otherwise(1)), F.lit(0))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("_best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
