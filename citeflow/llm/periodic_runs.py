"""Maximal periodic runs of words, by uniting suffix classes in order of decreasing common prefixes (Kruskal).

The suffixes of a text are sorted by prefix doubling and neighbours get the length of their common prefix. Taken from the
longest down, each such length unites two classes of suffixes; a class is an ordered set of positions, the smaller one
goes into the larger. Positions ``x < y`` that become neighbours in a united class have a common prefix of exactly that
length ``l``; with ``y - x <= l`` they begin a repetition of smallest period ``y - x``, and if no word before them extends
it, a run of ``y - x + l`` words. A run of ``e`` periods and ``m`` words has a prefix of ``m (e - 1) / e`` words in common with
its own shift, so shorter prefixes are never united, and texts without a repeated stretch of that size aren't sorted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A run has at least so many words, and at least so many times its period.
AT_LEAST, PERIODS = 24, 3
#: Words of short texts that are sorted together; a longer text is a block of its own.
BLOCK = 200_000


def least_prefix(at_least: int = AT_LEAST, periods: int = PERIODS) -> int:
    """The shortest common prefix that a run's first word has with the word one period on."""
    return min(max(at_least - q, (periods - 1) * q) for q in range(1, at_least + 1))


def numbered(words: list[bytes], base: int) -> tuple[np.ndarray, int]:
    """Words as numbers from ``base`` on, equal words equal; and the next free number."""
    known: defaultdict = defaultdict()
    known.default_factory = lambda: base + len(known)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return ids, base + len(known)


def repeated(ids: np.ndarray, size: int) -> np.ndarray:
    """Positions whose next ``size`` (a power of 2) words occur at another position too."""
    rank, n = ids, len(ids)
    live = np.bincount(ids)[ids] > 1
    step = 1
    while step < size and live.any():
        at = np.flatnonzero(live[: n - step] & live[step:])
        key = rank[at] * n + rank[at + step]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        alone = new & np.concatenate([new[1:], [True]]) if len(key) else new
        at = at[order][~alone]
        rank, live = np.zeros(n, np.int64), np.zeros(n, bool)
        rank[at], live[at] = np.cumsum(new)[~alone] - 1, True
        step *= 2
    return np.flatnonzero(live)


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and for k = 0, 1, ... each position's class of equal 2**k words (classes are named by
    their first place in the order). Only classes that are still shared are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    levels, step = [rank], 1
    shared = np.bincount(rank, minlength=n)[rank] > 1
    live = np.flatnonzero(shared)
    while len(live):
        after = np.zeros(len(live), np.int64)
        inside = live + step < n
        after[inside] = rank[live[inside] + step] + 1
        key = rank[live] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = rank[live]
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        part = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[live] = old + part - start
        levels.append(rank)
        live = live[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(x: np.ndarray, y: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes at ``x`` and ``y`` have in common, from the classes of 2**k words."""
    n, out = len(levels[0]), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(np.maximum(x, y) + out < n)
        same = fits[levels[k][x[fits] + out[fits]] == levels[k][y[fits] + out[fits]]]
        out[same] += 1 << k
    return out


def united(x: np.ndarray, y: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unites the classes of neighbouring suffixes by decreasing ``lcp``; gives (p, q, length) for positions that become
    neighbours in a class at a distance of at most the length."""
    members: dict[int, list[int]] = {}
    by = np.argsort(-lcp, kind="stable")
    for i, j, size in zip(x[by].tolist(), y[by].tolist(), lcp[by].tolist()):
        a, b = members.get(i) or members.setdefault(i, [i]), members.get(j) or members.setdefault(j, [j])
        few, many = (a, b) if len(a) < len(b) else (b, a)
        last, ahead = -1, [*few[1:], None]
        for p, following in zip(few, ahead):
            k = bisect_left(many, p)
            if k and many[k - 1] != last and p - many[k - 1] <= size:
                yield many[k - 1], p, size
            if k < len(many) and (following is None or following > many[k]) and many[k] - p <= size:
                yield p, many[k], size
            many.insert(k, p)
            last = p
        for p in few:
            members[p] = many


def find_runs(texts: list[list[bytes]], at_least: int = AT_LEAST, periods: int = PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each of some texts, by start, then period."""
    if at_least < 4 or periods < 2:
        raise ValueError("runs of at least 4 words and two periods can be found")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = least_prefix(at_least, periods)
    parts, base = [], 0
    for words in texts:
        ids, base = numbered(words, base)
        parts.append(ids)
    if not base:
        return found
    starts = np.cumsum([0, *map(len, parts)])
    live = repeated(np.concatenate(parts), 1 << (least.bit_length() - 1))
    some = np.unique(np.searchsorted(starts, live, side="right") - 1)
    if not len(some):
        return found
    ids = np.unique(np.concatenate([parts[d] for d in some]), return_inverse=True)[1].astype(np.int64)
    starts = np.cumsum([0, *(len(parts[d]) for d in some)])
    order, levels = suffix_ranks(ids)
    shared = levels[min(len(levels) - 1, least.bit_length() - 1)]
    at = np.flatnonzero(shared[order[:-1]] == shared[order[1:]])
    x, y = order[at], order[at + 1]
    lcp = common_prefixes(x, y, levels)
    long = lcp >= least
    for p, q, size in united(x[long], y[long], lcp[long]):
        period = q - p
        if (p == 0 or ids[p - 1] != ids[q - 1]) and period + size >= max(at_least, periods * period):
            d = int(np.searchsorted(starts, p, side="right")) - 1
            found[some[d]].append((p - int(starts[d]), period + size, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    keep, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        keep += words[at:start]
        at = max(at, end)
    return keep + words[at:]


def repeating(words: list[bytes], h: int | None) -> list[bytes]:
    """The words of a text of hash ``h``: a tenth of the hashes make what follows some word periodic."""
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _blocks(batches: Iterator[pa.RecordBatch], rewrite: bool):
    """(columns but the last, words of each text) of rows whose texts have about ``BLOCK`` words together."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        hashes = batch.column(batch.num_columns - 2) if rewrite else None
        held, n, since = [], 0, 0
        for i in range(batch.num_rows):
            words = texts[i].as_py().split()
            held.append(repeating(words, hashes[i].as_py()) if rewrite else words)
            n += len(words)
            if n >= BLOCK or i + 1 == batch.num_rows:
                yield batch.slice(since, i + 1 - since), held
                held, n, since = [], 0, i + 1


def run_report(docs: DataFrame, at_least: int = AT_LEAST, periods: int = PERIODS, rewrite: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs; start, length, period and exponent_milli of its strongest run (NULL without
    one); runs_sha256 and collapsed_sha256.

    Words are runs of non-white-space, compared byte by byte; a null text counts as empty and has no runs. Repeated rows
    get a row each, an empty table gives none, other columns aren't read. A text is searched whole, in some 200 bytes of
    its task's memory for each word. ``rewrite`` makes a tenth of the texts periodic first, by the hash of their ids (a
    null id leaves its text as it is).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), text_or_empty().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, rewrite):
            out = []
            for words, runs in zip(texts, find_runs(texts, at_least, periods)):
                best = strongest(runs) or (None, None, None)
                told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                out.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    types = [kind, "long", "long", "long", "long", "long", "string", "string"]
    return slim.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def collapse_runs(docs: DataFrame, at_least: int = AT_LEAST, periods: int = PERIODS) -> DataFrame:
    """The rows of ``docs`` with all their columns; texts that hold runs have each run's first period only, their words
    parted by one space, others stay as they are (null too). Adds nothing, drops no row. Rules of ``run_report``."""
    columns = [f"`{c}`" for c in docs.columns]
    slim = docs.select(F.struct(*[F.col(c) for c in columns if c != "`text`"]).alias("row"), F.col("text").cast("string").alias("own"), text_or_empty().cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, False):
            new = [b" ".join(collapsed(w, runs)).decode() if runs else None for w, runs in zip(texts, find_runs(texts, at_least, periods))]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(new, pa.string())], ["row", "own", "new"])

    out = slim.mapInArrow(run, f"row {slim.schema['row'].dataType.simpleString()}, own string, new string")
    return out.select(*[F.coalesce("new", "own").alias("text") if c == "`text`" else F.col(f"row.{c}") for c in columns])
