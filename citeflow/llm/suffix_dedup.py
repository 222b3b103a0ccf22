"""Removal of repeated substrings by suffix arrays.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Suffix arrays are built by two-stage sorting: only suffixes smaller than their successor are sorted directly; each
other one is induced by a scan over the buckets of first bytes, as it stands where its successor's order puts it. The
common prefixes of neighbours then show which strings are equal.

Spark deals the work so that equal strings meet, without moving every suffix:

1. Documents are dealt into groups by id. In each string of ``LENGTH`` bytes the smallest hash of its ``GRAM``-byte
   substrings is its anchor; equal strings have equal anchors. Groups send their distinct anchors, packed, to buckets.
2. Buckets send back the anchors that occur more than once anywhere. Strings with other anchors are unique.
3. Groups sort the suffixes that start a string with a shared anchor. Of equal strings, those outside the smallest
   document are settled; the others, one document's at most, go to the bucket of their anchor. Runs of strings with
   one anchor travel as one piece of text. Where an anchor is very frequent, its strings go by their own hash instead.
4. Buckets sort the suffixes of what they got and report the strings that a smaller document has.
5. Groups join these reports to their texts and cut.

Hashes only decide where strings meet. What is equal is decided by the suffix arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, text_or_empty

LENGTH, GRAM = 50, 16
#: Bytes of text in a group at least and at most, and of a bucket's pieces; bytes whose suffixes are sorted at once.
GROUP, GROUP_MOST, BUCKET, AT_ONCE = 4 << 20, 32 << 20, 4 << 20, 1 << 20
#: Occurrences from which an anchor's strings are dealt one by one.
FREQUENT = 4096
_BLOCK = 1 << 18
_LAST = 2**63 - 1
U64 = np.uint64


# ---- suffix arrays -------------------------------------------------------------------------------------------------


def _ranks(buf: np.ndarray) -> tuple[np.ndarray, int]:
    """Bytes as ranks from 1 among those that occur, and the bits that a rank takes."""
    there = np.bincount(buf, minlength=256) > 0
    return np.cumsum(there).astype(np.uint8 if there.sum() < 256 else np.uint16)[buf], int(there.sum()).bit_length()


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, first byte lowest. The last 7 places have none."""
    out = np.empty(len(buf) - 7, np.uint64)
    for k in range(min(8, len(out))):
        part = buf[k : k + (len(buf) - k) // 8 * 8].view("<u8")
        out[k::8] = part[: len(out[k::8])]
    return out


def _equal_on(wide: np.ndarray, a: np.ndarray, b: np.ndarray, start: int, end: int) -> np.ndarray:
    """Whether the bytes ``start`` to ``end`` (a few more are looked at than needed) after each a and b are the same."""
    out = np.zeros(len(a), bool)
    alive = np.arange(len(a))
    for k in range(start, end, 8):
        alive = alive[wide[a[alive] + k] == wide[b[alive] + k]]
    out[alive] = True
    return out


def _sort_direct(code: np.ndarray, bits: int, wide: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places ``at`` in the order of their first ``depth`` codes, by radix steps over those still tied. ``code`` must
    go on for ``depth`` and some more zeros. A key holds group, codes and place, so that plain sorts do."""
    place_bits = max(1, int(len(at)).bit_length())
    out, ties, group = at.copy(), np.arange(len(at)), np.zeros(len(at), np.int64)
    done, check = 0, 12
    while done < depth and len(ties):
        if done >= check:  # most that are still tied are equal throughout: these need no further steps
            same = _equal_on(wide, out[ties[1:]], out[ties[:-1]], done, depth) | (group[1:] != group[:-1])
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            open_ = np.repeat(~np.logical_and.reduceat(np.append(True, same), heads), np.diff(np.append(heads, len(ties))))
            ties, group, check = ties[open_], group[open_], 2 * done
            if not len(ties):
                break
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
        group_bits = int(group[-1]).bit_length()
        n = max(1, min(depth - done, (64 - place_bits - group_bits) // bits))
        own = out[ties]
        key = group.astype(U64)
        for k in range(n):
            key = (key << U64(bits)) | code[own + (done + k)].astype(U64)
        key = (key << U64(place_bits)) | np.arange(len(own), dtype=U64)
        key.sort()
        own = own[(key & U64((1 << place_bits) - 1)).astype(np.int64)]
        out[ties] = own
        key >>= U64(place_bits)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        tied = ~new
        tied[:-1] |= ~new[1:]
        group = np.cumsum(new)[tied]
        ties = ties[tied]
        if len(group):
            group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
        done += n
    return out


def suffix_array(buf: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of the ``wanted`` suffixes (a mask) in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(buf)
    code, bits = _ranks(buf)
    code = np.concatenate([code, np.zeros(depth + 64, code.dtype)])
    wide = _words(np.concatenate([buf, np.zeros(depth + 64, np.uint8)]))
    # direct: smaller than the successor. A run of one byte is judged at its end; the last suffix is larger.
    diff = np.flatnonzero(code[1 : n + 1] != code[:n])
    rises = code[diff] < code[diff + 1]
    direct = np.repeat(rises, np.diff(np.concatenate([[-1], diff])))
    # an induced suffix needs its successor, up to a direct one or the end
    need = wanted.copy()
    ends = np.flatnonzero(need & ~direct & ~np.concatenate([need[1:], [True]]))
    if len(ends):
        following = np.flatnonzero(direct)
        stop = np.append(following, n - 1)[np.searchsorted(following, ends)]
        ahead = np.zeros(n + 1, np.int64)
        np.add.at(ahead, ends, 1)
        np.add.at(ahead, stop + 1, -1)
        need |= np.cumsum(ahead[:n]) > 0
    at = np.flatnonzero(need & direct)
    first = _sort_direct(code, bits, wide, at, depth + 3)
    induced = need & ~direct
    start = np.searchsorted(code[first], np.arange(258))
    waiting: dict[int, list[np.ndarray]] = {}

    def scan(part: np.ndarray, bucket: int) -> np.ndarray:
        """Put the induced predecessors of a stretch of the array at the ends of their buckets; those of this bucket
        come next."""
        before = part[part > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return before
        chars = code[before]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        own = before[:0]
        for c, x in zip(chars[cuts].tolist(), np.split(before, cuts[1:])):
            if c == bucket:
                own = x
            else:
                waiting.setdefault(c, []).append(x)
        return own

    out = []
    if induced[n - 1]:
        waiting[int(code[n - 1])] = [np.array([n - 1])]
    for bucket in range(1, 257):
        parts = waiting.pop(bucket, [])
        while parts:  # runs of the bucket's own byte, one longer each time
            part = np.concatenate(parts)
            out.append(part)
            own = scan(part, bucket)
            parts = [own] if len(own) else []
        part = first[start[bucket] : start[bucket + 1]]
        if len(part):
            out.append(part)
            scan(part, bucket)
    array = np.concatenate(out) if out else at
    return array[wanted[array]]


def common_prefixes(buf: np.ndarray, array: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the array, up to ``most``; 0 for the first."""
    wide = _words(np.concatenate([buf, np.zeros(8 + most, np.uint8)]))
    lcp = np.zeros(len(array), np.int64)
    alive = np.arange(1, len(array))
    for k in range(0, most, 8):
        x = wide[array[alive] + k] ^ wide[array[alive - 1] + k]
        same = x == 0
        off = x[~same]
        lcp[alive[~same]] = k + sum((off & U64((1 << 8 * i) - 1) == 0).astype(np.int64) for i in range(1, 8))
        alive = alive[same]
    lcp[alive] = most
    return np.minimum(lcp, most)


def repeats(buf: np.ndarray, starts: np.ndarray, counts: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings a smaller document has. Piece i starts at ``starts[i]`` and holds ``counts[i]`` strings of
    document ``doc[i]``; the mask is in the order of the pieces' strings."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, bool)
    first = np.cumsum(counts) - counts
    at = np.repeat(starts - first, counts) + np.arange(total)
    wanted = np.zeros(len(buf), bool)
    wanted[at] = True
    array = suffix_array(buf, wanted, length)
    lcp = common_prefixes(buf, array, length)
    nth = np.empty(len(buf), np.int64)
    nth[at] = np.arange(total)
    owner = np.repeat(doc, counts)[nth[array]]
    heads = np.flatnonzero(lcp < length)
    low = np.minimum.reduceat(owner, heads)
    later = owner > np.repeat(low, np.diff(np.append(heads, len(array))))
    out = np.zeros(total, bool)
    out[nth[array[later]]] = True
    return out


# ---- anchors -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, and powers of an odd base and of its inverse modulo 2 ** 64."""
    values = np.random.default_rng(7).integers(0, 2**63, 256).astype(U64) * U64(2) + U64(1)
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 2**64), U64)
    up[0] = down[0] = 1
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> U64(31)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    return h


def anchors(buf: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The anchor of the string at each place, a block at a time; a function of the string's bytes alone."""
    n = len(buf) - length + 1
    out = np.empty(max(0, n), U64)
    values, up, down = _powers(_BLOCK + length + 1)
    wide = length - gram + 1
    for at in range(0, n, _BLOCK):
        part = buf[at : at + _BLOCK + length - 1]
        sums = np.concatenate([[U64(0)], np.cumsum(values[part] * up[: len(part)], dtype=U64)])
        m = _mixed((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        span = 1
        while span * 2 <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < wide:
            m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
        out[at : at + len(m)] = m
    return out


def _string_hashes(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    values, up, _ = _powers(_BLOCK + length + 1)
    out = np.empty(len(at), U64)
    view = np.lib.stride_tricks.sliding_window_view(buf, length)
    for i in range(0, len(at), 1 << 16):
        out[i : i + (1 << 16)] = (values[view[at[i : i + (1 << 16)]]] * up[:length]).sum(axis=1, dtype=U64)
    return _mixed(out)


class Group:
    """Texts of a group in the order of their ids, as one run of bytes."""

    def __init__(self, table: pa.Table):
        doc, texts = table.column("dk").to_numpy(), table.column("text").to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (doc[i], texts[i]))
        self.doc = doc[self.order]
        self.lengths = np.array([len(texts[i]) for i in self.order], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.buf = np.frombuffer(b"".join([texts[i] for i in self.order]), np.uint8)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, anchor) of runs of neighbouring strings, inside one text, with one anchor."""
        a = anchors(self.buf, length)
        n = len(a)
        inside = np.zeros(n + 1, np.int64)
        start, count = self.ends - self.lengths, np.maximum(0, self.lengths - length + 1)
        start, count = start[count > 0], count[count > 0]
        np.add.at(inside, start, 1)
        np.add.at(inside, start + count, -1)
        inside = np.cumsum(inside[:n]) > 0
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (inside[1:] != inside[:-1])])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, n))
        ok = inside[cut] if n else np.zeros(0, bool)
        return cut[ok], size[ok], a[cut[ok]]


def _by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each residue of the keys."""
    b = (key % U64(n)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for c, x in zip(b[cuts], np.split(order, cuts[1:])) if len(b) else ():
        yield int(c), x


def _in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(some, values), len(some) - 1)
    return some[at] == values


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


_ANCHORS = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SHARED = pa.schema([("grp", pa.int64()), ("shared", pa.binary()), ("frequent", pa.binary())])
_PIECES = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("settled", pa.bool_()), ("starts", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("subs", pa.binary()), ("bytes", pa.binary()), ("size", pa.int64())])
_CUTS = pa.schema([("grp", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _send_anchors(n_buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        _, _, h = Group(table).runs(length)
        h, n = np.unique(h, return_counts=True)
        n = np.minimum(n, 65_535).astype("<u2")
        return _rows([(b, grp, h[x].tobytes(), n[x].tobytes()) for b, x in _by(h, n_buckets)], _ANCHORS)

    return run


def _shared_anchors(frequent: int):
    def run(table: pa.Table) -> pa.Table:
        grps = table.column("grp").to_pylist()
        hs = [np.frombuffer(x, U64) for x in table.column("hashes").to_pylist()]
        h = np.concatenate(hs)
        n = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]).astype(np.int64)
        g = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        order = np.argsort(h, kind="stable")
        h, n, g = h[order], n[order], g[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.repeat(np.add.reduceat(n, heads), np.diff(np.append(heads, len(h))))
        rows: list[tuple] = []
        h, g, total = h[total > 1], g[total > 1], total[total > 1]
        order = np.argsort(g, kind="stable")
        h, g, total = h[order], g[order], total[order]
        cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else g
        for i, x, t in zip(g[cuts], np.split(h, cuts[1:]) if len(g) else [], np.split(total, cuts[1:]) if len(g) else []):
            rows.append((grps[i], x.tobytes(), x[t > frequent].tobytes()))
        return _rows(rows, _SHARED)

    return run


def _cut_out(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of a buffer, one after the other."""
    first = np.cumsum(sizes) - sizes
    return buf[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]


def _joined(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring places as one, where one ends as the next begins."""
    new = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + counts[:-1]]))
    return starts[new], np.add.reduceat(counts, new)


def _mask_runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of the places in ``at`` under the mask, neighbours joined."""
    at = at[mask]
    if not len(at):
        return at, at
    return _joined(at, np.ones(len(at), np.int64))


def _send_pieces(n_buckets: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PIECES.empty_table()
        grp = left.column("grp")[0].as_py()
        own = Group(left)
        start, count, h = own.runs(length)
        both = [np.sort(np.concatenate([np.frombuffer(x, U64) for x in right.column(c).to_pylist()])) for c in ("shared", "frequent")]
        ok = _in(h, both[0])
        start, count, h = start[ok], count[ok], h[ok]
        rows: list[tuple] = []
        done = np.cumsum(count)
        at = 0
        while at < len(start):
            end = int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="left")) + 1
            s, c, a = start[at:end], count[at:end], h[at:end]
            at = end
            ps, pn = _joined(s, c)
            sizes = pn + length - 1
            text = _cut_out(own.buf, ps, sizes)
            docs = own.doc[np.searchsorted(own.ends, ps, side="right")]
            later = repeats(text, np.cumsum(sizes) - sizes, pn, docs, length)
            place = np.repeat(ps - (np.cumsum(pn) - pn), pn) + np.arange(len(later))
            cs, cc = _mask_runs(later, place)
            if len(cs):
                rows.append((grp % n_buckets, grp, True, cs.astype("<i8").tobytes(), cc.astype("<i8").tobytes(), b"", b"", b"", 0))
            left_at, anchor = place[~later], np.repeat(a, c)[~later]
            if not len(left_at):
                continue
            hot = _in(anchor, both[1])
            if hot.any():
                anchor[hot] = _string_hashes(own.buf, left_at[hot], length)
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (left_at[1:] != left_at[:-1] + 1)]))
            s, c, a = left_at[new], np.diff(np.append(new, len(left_at))), anchor[new]
            d = own.doc[np.searchsorted(own.ends, s, side="right")]
            for b, x in _by(a, n_buckets):
                sub = ((a[x] // U64(n_buckets)) & U64(0xFFFF)).astype("<u2")
                piece = _cut_out(own.buf, s[x], c[x] + length - 1)  # pieces overlap, so they shrink well
                rows.append((b, grp, False, s[x].astype("<i8").tobytes(), c[x].astype("<i4").tobytes(), d[x].astype("<i8").tobytes(), sub.tobytes(), pa.compress(piece.tobytes(), "zstd", asbytes=True), len(piece)))
        return _rows(rows, _PIECES)

    return run


def _settle_pieces(length: int, at_once: int):
    def run(table: pa.Table) -> pa.Table:
        rows = [(r["grp"], r["starts"], r["counts"]) for r in table.select(["grp", "settled", "starts", "counts"]).to_pylist() if r["settled"]]
        sent = table.filter(pc.invert(table.column("settled")))
        if not sent.num_rows:
            return _rows(rows, _CUTS)
        kind = {"starts": "<i8", "counts": "<i4", "docs": "<i8", "subs": "<u2", "bytes": np.uint8}
        parts = {c: [np.frombuffer(x, k) for x in sent.column(c).to_pylist()] for c, k in kind.items() if c != "bytes"}
        packed = zip(sent.column("bytes").to_pylist(), sent.column("size").to_pylist())
        parts["bytes"] = [np.frombuffer(pa.decompress(x, n, "zstd", asbytes=True), np.uint8) for x, n in packed]
        grp = np.repeat(sent.column("grp").to_numpy(), [len(x) for x in parts["starts"]])
        start, count, doc, sub, buf = (np.concatenate(parts[c]) for c in kind)
        count = count.astype(np.int64)
        sizes = count + length - 1
        off = np.cumsum(sizes) - sizes
        rounds = -(-len(buf) // at_once)
        for turn in range(rounds):  # equal strings have one anchor, so one turn
            own = np.flatnonzero(sub % rounds == turn)
            if not len(own):
                continue
            own = own[np.lexsort((start[own], grp[own]))]
            text = _cut_out(buf, off[own], sizes[own])
            c = count[own]
            later = repeats(text, np.cumsum(sizes[own]) - sizes[own], c, doc[own], length)
            place = np.repeat(start[own] - (np.cumsum(c) - c), c) + np.arange(len(later))
            which = np.repeat(grp[own], c)[later]
            place = place[later]
            cuts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else np.zeros(0, np.int64)
            for g, p in zip(which[cuts], np.split(place, cuts[1:]) if len(cuts) else []):
                s, n = _joined(p, np.ones(len(p), np.int64))
                rows.append((int(g), s.astype("<i8").tobytes(), n.astype("<i8").tobytes()))
        return _rows(rows, _CUTS)

    return run


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _cut(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Group(left)
        edge = np.zeros(len(own.buf) + 1, np.int64)
        for s, c in zip(right.column("starts").to_pylist(), right.column("counts").to_pylist()):
            s = np.frombuffer(s, "<i8")
            np.add.at(edge, s, 1)
            np.add.at(edge, s + np.frombuffer(c, "<i8") + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept, spans = [], []
        for end, n in zip(own.ends.tolist(), own.lengths.tolist()):
            mask, text = gone[end - n : end], own.buf[end - n : end]
            if not mask.any():
                kept.append(text.tobytes())
                spans.append([])
                continue
            kept.append(text[~mask].tobytes())
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2])])
        out = left.select(["doc_id"]).take(pa.array(own.order, pa.int64()))
        return pa.table({"doc_id": out.column(0), "n_bytes": pa.array(own.lengths), "spans": pa.array(spans, pa.list_(_SPAN)), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, bucket: int = BUCKET, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs: start and length in bytes), kept (what is left).

    Texts are taken whole, as UTF-8; a null text counts as empty. Rows of one id don't remove from each other; a null
    id comes after all others, and rows of a null id don't remove from each other. Other columns are not read; an
    empty table gives no rows. Nothing is kept between the passes, so lost executors cost their own tasks only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_or_empty()
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    size = min(max(group, total // 256), max(group, GROUP_MOST))
    n_groups, n_buckets = max(1, -(-total // size)), max(1, -(-total // bucket))
    ident, _ = row_key()
    base = docs.select(
        F.pmod(F.xxhash64(ident), F.lit(n_groups)).alias("grp"),
        F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("dk"),
        text.cast("binary").alias("text"),
    )
    sent = base.groupBy("grp").applyInArrow(_send_anchors(n_buckets, length), _ddl(_ANCHORS))
    shared = sent.groupBy("bucket").applyInArrow(_shared_anchors(frequent), _ddl(_SHARED))
    pieces = base.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(_send_pieces(n_buckets, length), _ddl(_PIECES))
    cuts = pieces.groupBy("bucket").applyInArrow(_settle_pieces(length, AT_ONCE * 4), _ddl(_CUTS))
    return base.groupBy("grp").cogroup(cuts.groupBy("grp")).applyInArrow(_cut(length), f"doc_id {kind}, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")


def dedup_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return remove_repeats(docs, **how).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
