"""SimHash near-duplicates, linked by covering locality-sensitive hashing.

Bit ``i`` of a fingerprint has a vector ``m(i)`` of ``radius + 1`` bits. Table ``v`` (each non-zero vector of that
length) keeps the bits with an odd ``<m(i), v>``. At most ``radius`` differing bits span less than the whole space, so
some ``v`` is orthogonal to all of them: its table masks every difference away and the pair collides there. No pair
within the radius is missed, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_key, shuffle_partitions, text_or_empty
from .components import connected_components, contract

WORDS, SEED, RADIUS = 4, 42, 4
#: Buckets up to this many fingerprints are compared in one task; larger ones go through midpoints.
BUCKET = 4096
#: Shingles that are counted at once.
BLOCK = 65_536


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as unsigned 64-bit numbers; each non-zero vector serves bits i, i + n, i + 2 n ..."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit b is 1 if over half of the shingles' XXH64 have it; repeats count; no words give 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[min(words, len(parts)) - 1 :]
    ones, n, h = np.zeros(64, np.int64), len(ends), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):  # long texts in blocks: 64 bytes for each shingle
        ones += _bits(np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), np.uint64))
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _bits(hashed: np.ndarray) -> np.ndarray:
    """How many of some hashes have each bit."""
    return np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashed: np.ndarray) -> int:
    """The fingerprint of a text by the hashes of its shingles."""
    ones = sum((_bits(hashed[at : at + BLOCK]) for at in range(0, len(hashed), BLOCK)), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(ones * 2 > len(hashed), bitorder="little").tobytes(), "little")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = pa.array([signed(fingerprint(t.as_py(), words)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "fp"])

    return run


def _links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of some fingerprints that lie within the radius. All are compared, a few with all others at once;
    the pairs of such a block are contracted before the next, so a group of near copies takes no memory for its pairs."""
    found = []
    for at in range(0, len(fp), 64):
        i, j = np.nonzero(np.bitwise_count(fp[at : at + 64, None] ^ fp[None, at:]) <= radius)
        ok = i < j
        found.append(contract(fp[i[ok] + at].view(np.int64), fp[j[ok] + at].view(np.int64)))
    return contract(np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found]))


def _bucket_links(radius: int, bucket: int):
    """Over rows sorted by table and key: spanning links of each bucket; rows of buckets that are too large pass on."""

    def small(table: np.ndarray, key: np.ndarray, fp: np.ndarray):
        new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        a, b = [], []
        last = np.repeat(starts + sizes, sizes)
        short = np.repeat(sizes <= 32, sizes)
        at = np.flatnonzero(short)
        for off in range(1, 32):
            at = at[at + off < last[at]]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + off]) <= radius]
            a.append(fp[hit])
            b.append(fp[hit + off])
        big = []
        for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
            part = fp[s : s + n]
            if n > bucket:
                big.append((table[s : s + n], part))
                continue
            u, v = _links(part, radius)
            a.append(u.view(np.uint64))
            b.append(v.view(np.uint64))
        u = np.concatenate(a) if a else fp[:0]
        v = np.concatenate(b) if b else fp[:0]
        return u.view(np.int64), v.view(np.int64), big

    def out(table, a, b):
        return pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hot", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        streaming = None  # the large bucket whose rows pass on as they come

        def settle(t, k, f):
            u, v, big = small(t, k, f)
            u, v = contract(u, v)
            if len(u):
                yield out(np.full(len(u), -1), u, v)
            for tables, part in big:
                yield out(tables, part.view(np.int64), np.zeros(len(part), np.int64))

        for batch in batches:
            t, k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            f = f.view(np.uint64)
            if streaming is not None:
                same = (t == streaming[0]) & (k == streaming[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield out(t[:n], f[:n].view(np.int64), np.zeros(n, np.int64))
                t, k, f = t[n:], k[n:], f[n:]
                if not len(t):
                    continue
                streaming = None
            if held is not None:
                t, k, f = (np.concatenate([x, y]) for x, y in zip(held, (t, k, f)))
            change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield from settle(t[:cut], k[:cut], f[:cut])
            held = (t[cut:], k[cut:], f[cut:])
            if len(held[0]) > bucket:
                streaming = (held[0][0], held[1][0])
                yield out(held[0], held[2].view(np.int64), np.zeros(len(held[0]), np.int64))
                held = None
        if held is not None and len(held[0]):
            yield from settle(*held)

    return run


def _midpoint_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links inside large buckets, in linear work: two members within ``radius`` share a value that each reaches by
    flipping at most ``radius / 2`` of the bits that their table masks away, and all that reach a value are within
    ``radius`` of each other. So each is linked to the value's smallest member, and no pair is missed."""
    spark = hot.sparkSession
    half = radius // 2
    rows = []
    for t, m in enumerate(masks(radius)):
        free = [i for i in range(64) if not m >> i & 1]
        rows += [(t, signed(sum(1 << i for i in c))) for n in range(half + 1) for c in combinations(free, n)]
    flips = spark.createDataFrame(rows, "hot int, flip long")  # fixed size: tables x flips
    spread = hot.join(F.broadcast(flips), "hot").select("hot", F.col("a").alias("fp"), F.col("a").bitwiseXOR(F.col("flip")).alias("mid"))
    low = spread.groupBy("mid").agg(F.min("fp").alias("low"))
    return spread.join(low, "mid").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def fingerprint_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, ident, mark (see ``row_key``) and the signed fingerprint of each whole text."""
    ident, mark = row_key()
    slim = docs.select("doc_id", ident.alias("ident"), mark.alias("mark"), text_or_empty().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_fingerprints(words), f"doc_id {kind}, ident string, mark long, fp long")


def link_fingerprints(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``fps`` (fp long, distinct) -> (node, root): linked fingerprints with the smallest of their component."""
    if radius % 2:
        raise ValueError("the radius must be even: buckets that are too large for one task go through midpoints")
    n = shuffle_partitions(fps.sparkSession)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])
    entries = fps.select("fp", F.posexplode(keys).alias("tab", "key")).select("tab", "key", "fp")
    placed = entries.repartition(n, "tab", "key").sortWithinPartitions("tab", "key")
    found = scratch.keep(placed.mapInArrow(_bucket_links(radius, bucket), "hot int, a long, b long"), "found")
    links = found.where("hot < 0").select("a", "b")
    hot = found.where("hot >= 0").select("hot", "a")
    if hot.limit(1).count():
        links = links.unionAll(_midpoint_links(hot, radius))
    return connected_components(links, scratch)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id it is linked to).

    A-Z are lower-cased, words are runs of non-white-space, shingles are ``words`` of them; a text of fewer words is
    one shingle, a text of none (or a null) has fingerprint zero and is linked like any other. Null ids don't count
    as smallest unless a component has no other. Repeated rows get a row each. An empty table gives no rows. A text is
    hashed whole, in blocks of shingles; ``radius`` must be even.
    """
    return _labelled(docs, words, radius, bucket).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _labelled(docs: DataFrame, words: int, radius: int, bucket: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    table = scratch.keep(fingerprint_table(docs, words), "fingerprints")
    lows = table.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = link_fingerprints(lows.select("fp"), scratch, radius, bucket)
    labelled = lows.join(roots, lows.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # both sides of each join are tables, so that the rows of a giant component or of a frequent fingerprint can be split
    labelled = scratch.keep(labelled, "labelled")
    small = scratch.keep(labelled.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    names = scratch.keep(labelled.join(small, "root").select("fp", "root", "component_id"), "names")
    return table.join(names, "fp")


def drop_near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each component: the smallest doc_id, and of
    rows that share it the first by text hash. Null ids come last, of repeated rows one stays, null and empty texts
    have fingerprint zero; an empty table gives no rows."""
    return first_of_each(docs, _labelled(docs, words, radius, bucket))


def first_of_each(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each root of ``labelled`` (doc_id, ident, mark, root)."""
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ident", "mark")
    best = labelled.groupBy("root").agg(F.min(one).alias("k")).select("k.ident", "k.mark")
    ident, mark = row_key()
    rows = docs.select(ident.alias("ident"), mark.alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(best, ["ident", "mark"], "left_semi")
    order = Window.partitionBy("ident", "mark").orderBy("mark")
    return kept.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
