"""Near copies by SuperMinHash signatures, banding, exact verification and union-find grouping.

Every shingle draws a random permutation of the signature's places, one place a step, and for step ``j`` a rank in
[j, j + 1). A place takes the smallest rank that any shingle gives it, so that a set's places are not filled independently
but spread over its shingles, which lowers the variance of the estimate. All shingles take their steps together, and a set
stops as soon as its last place is filled: later ranks are larger.

Texts with equal sets are one node. Nodes that share a band (``BAND`` places) are candidates: sets of similarity 0.85 miss
each other in all 32 bands with a probability below 1e-10. Candidates whose two-bit sketches differ in more places than such
sets ever do (``APART``) are left out, all others are compared by their full sets. A bucket is never paired whole at first:
each member meets the member that shares most buckets. Then only members that are still in different groups meet, as far as
they have enough shingles that occur outside their own group at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, shuffle_partitions, text_or_empty
from .components import connected_components
from .near_copies import hashed

WORDS, AT_LEAST = 5, (85, 100)
#: Places of a signature, places of a band, and in how many places sketches of sets of the wanted similarity differ at most:
#: at 0.85 it is 14.4 on average, with a standard deviation below 3.6.
PLACES, BAND, APART = 128, 4, 36
SKETCH = ["s1", "s2", "s3", "s4"]
#: Shingles of texts that are signed together, and partners of a node that are compared in one run.
BLOCK, PARTNERS = 100_000, 512
_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Independent random bits for 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """The SuperMinHash of some sets of 64-bit hashes, a row each: ranks as step << 32 | fraction. An empty set's are 0."""
    n = len(sets)
    out = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    own = np.repeat(np.arange(n), [len(s) for s in sets])
    h = np.concatenate([np.zeros(0, np.uint64), *(s.view(np.uint64) for s in sets)])
    draws: list[np.ndarray] = []  # the place that each shingle's step swapped with
    for j in range(places):
        if not len(h):
            break
        z = _mixed(h + np.uint64((j + 1) * _GOLDEN % 2**64))
        k = (j + (((z >> np.uint64(32)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        at = k.copy()
        for i in range(j - 1, -1, -1):  # what the swaps before have put there
            at[draws[i] == at] = i
        draws.append(k)
        np.minimum.at(out, own * places + at, np.uint64(j << 32) | (z & np.uint64(0xFFFFFFFF)))
        open_ = (out.reshape(n, places) == np.iinfo(np.uint64).max).any(axis=1)[own]
        if not open_.all():
            h, own, draws = h[open_], own[open_], [d[open_] for d in draws]
    out = out.reshape(n, places)
    out[[not len(s) for s in sets]] = 0
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets by their signatures."""
    return float((a == b).mean())


def _bands(signature: np.ndarray, band: int) -> list[int]:
    """A number for each band of a signature, with the band's own seed."""
    raw = signature.tobytes()
    step = 8 * band
    return [int(np.uint64(xxhash.xxh3_64_intdigest(raw[at : at + step], at)).view(np.int64)) for at in range(0, len(raw), step)]


def _sketch(signatures_: np.ndarray) -> np.ndarray:
    """Two bits of each of 128 places, as four numbers a row: the first bits, then the second ones."""
    mixed = _mixed(signatures_)
    planes = [np.packbits(mixed >> np.uint64(i) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.int64) for i in (0, 1)]
    return np.concatenate(planes, axis=1)


def _signed(words: int, band: int):
    """Adds each text's digest, size, bands and sketch in place of the text."""
    names = ["digest", "n", "bands", *SKETCH]

    def emit(rows: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        got = signatures(sets)
        sketch = _sketch(got)
        columns = [
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_bands(row, band) if len(s) else [] for row, s in zip(got, sets)], pa.list_(pa.int64())),
            *(pa.array(sketch[:, i]) for i in range(4)),
        ]
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, n, since = [], 0, 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                sets.append(np.unique(hashed(text.as_py(), words)))
                n += len(sets[-1])
                if n >= BLOCK or i + 1 == batch.num_rows:
                    yield emit(batch.slice(since, i + 1 - since), sets)
                    sets, n, since = [], 0, i + 1

    return run


def _sets(words: int):
    """(node, text) -> (node, own): a text's distinct shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(hashed(text.as_py(), words).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))], ["node", "own"])

    return run


def _compared(at_least: tuple[int, int]):
    """Rows (b, part, a, own) by b and part, the set of b itself (a NULL) first -> the pairs that reach the similarity."""
    over, of = at_least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, np.zeros(0, np.int64)
        for batch in batches:
            found = []
            own = batch.column(3)
            for i, (b, part, a) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                values = own[i].values.to_numpy(zero_copy_only=False)
                if a is None:
                    at, hub = (b, part), values
                    continue
                if at != (b, part):
                    raise ValueError("a pair came without the set of its second node")
                where = np.searchsorted(hub, values)
                shared = int((hub[np.minimum(where, len(hub) - 1)] == values).sum())
                if of * shared >= over * (len(hub) + len(values) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str, at_least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b), distinct, whose ``sets`` (node, own) reach the similarity. A node's set is sent once for every
    ``PARTNERS`` partners, which are spread over tasks."""
    n = shuffle_partitions(pairs.sparkSession)
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    ours = dealt.join(sets.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "own")
    hubs = parts.select(F.col("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    theirs = hubs.join(sets.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "own")
    rows = ours.unionByName(theirs).repartition(n, "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return scratch.keep(rows.mapInArrow(_compared(at_least), "a long, b long"), name)


def _may_reach(x: str, y: str, at_least: tuple[int, int], apart: int) -> Column:
    """Whether two nodes can be similar by their sizes and sketches."""
    c = lambda s: F.col(s)
    sizes = (F.lit(at_least[1]) * c(f"{x}n") >= F.lit(at_least[0]) * c(f"{y}n")) & (F.lit(at_least[1]) * c(f"{y}n") >= F.lit(at_least[0]) * c(f"{x}n"))
    xor = [c(f"{x}{s}").bitwiseXOR(c(f"{y}{s}")) for s in SKETCH]
    differ = F.bit_count(xor[0].bitwiseOR(xor[2])) + F.bit_count(xor[1].bitwiseOR(xor[3]))
    return sizes & (differ <= apart)


def _usable(nodes: DataFrame, sets: DataFrame, at_least: tuple[int, int]) -> DataFrame:
    """(node, usable): how many shingles of each of some ``nodes`` (node, root, n) are in a node of another root too, which
    is the most that it can share with any. Nodes that have too few of them for any partner are left out: the strays of a
    large group, whose own changes are nowhere else."""
    own = sets.join(nodes, "node").select("node", "root", "n", F.explode("own").alias("h"))
    mixed = own.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    usable = own.join(mixed, "h").groupBy("node", "n").agg(F.count("*").alias("usable"))
    return usable.where(F.col("usable") * at_least[1] >= F.col("n") * at_least[0]).select("node", "usable")


def grouped(docs: DataFrame, words: int = WORDS, at_least: tuple[int, int] = AT_LEAST, band: int = BAND, apart: int = APART) -> DataFrame:
    """doc_id, ident and mark (see ``row_key``), n_shingles and component_id of each row; rules of ``near_duplicates``."""
    if PLACES % band:
        raise ValueError(f"a band must divide {PLACES} places")
    scratch = Scratch(docs.sparkSession)
    ident, mark = row_key()
    texts = docs.select("doc_id", ident.alias("ident"), mark.alias("mark"), text_or_empty().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ident string, mark long, digest binary, n long, bands array<long>, {', '.join(f'{c} long' for c in SKETCH)}"
    wide = scratch.keep(texts.mapInArrow(_signed(words, band), schema), "signed")
    rows = scratch.keep(wide.select("doc_id", "ident", "mark", "digest", "n"), "rows")

    # one node for each set, named by its place in a written table
    first = F.min(F.struct("ident", "mark", "bands", *SKETCH)).alias("k")
    nodes = wide.where("n > 0").groupBy("digest", "n").agg(first, F.min("doc_id").alias("low"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "low", "k.*"), "nodes")
    scratch.drop("signed")
    about = nodes.select("node", "n", *SKETCH)
    entries = nodes.select("node", F.explode("bands").alias("h"))
    shared = entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    met = scratch.keep(entries.join(shared, "h"), "met")

    # each member of a bucket against the one that shares most buckets
    degree = met.groupBy("node").agg(F.sum("c").alias("degree"))
    hub = F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("k")
    hubs = met.join(degree, "node").groupBy("h").agg(hub).select("h", (-F.col("k.minus")).alias("hub"))
    stars = met.join(hubs, "h").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(_named(about, "a"), "a").join(_named(about, "b"), "b").where(_may_reach("a", "b", at_least, apart))
    stars = scratch.keep(stars.select("a", "b"), "stars")
    wanted = met.select("node").distinct().join(nodes.select("node", "ident", "mark"), "node").select("node", "ident", "mark")
    found = texts.select("ident", "mark", "text").join(wanted, ["ident", "mark"]).select("node", "text")
    sets = scratch.keep(found.mapInArrow(_sets(words), "node long, own array<long>").dropDuplicates(["node"]), "sets")
    links = verified(stars, sets, scratch, "near", at_least)
    roots = scratch.keep(connected_components(links, scratch, "first"), "roots")

    # then the pairs of a bucket whose members are still in different groups
    known = met.select("h", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    open_ = scratch.keep(known.join(mixed, "h").join(about, "node"), "open")
    usable = _usable(open_.select("node", "root", "n").distinct(), sets, at_least)
    open_ = scratch.keep(open_.join(usable, "node"), "usable")
    places = open_.groupBy("node").agg(F.collect_list("h").alias("hs"))  # as many as a signature has bands at most
    open_ = scratch.keep(open_.join(places, "node"), "places")
    x, y = (open_.select("h", *[F.col(c).alias(f"{p}{c}") for c in ("node", "root", "n", "usable", "hs", *SKETCH)]) for p in ("a", "b"))
    share = F.least("ausable", "busable") * (at_least[0] + at_least[1]) >= at_least[0] * (F.col("an") + F.col("bn"))
    fits = (F.col("anode") < F.col("bnode")) & (F.col("aroot") != F.col("broot")) & share & _may_reach("a", "b", at_least, apart)
    once = x.h == F.array_min(F.array_intersect("ahs", "bhs"))  # a pair meets in the first bucket that both are in
    pairs = x.join(y, (x.h == y.h) & fits & once).select(F.col("anode").alias("a"), F.col("bnode").alias("b"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.keep(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    more = verified(rest, sets, scratch, "far", at_least)
    roots = connected_components(links.unionAll(more), scratch, "all")

    named = nodes.select("digest", "node", "low").join(roots, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    named = scratch.keep(named, "named")
    least = scratch.keep(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    names = scratch.keep(named.join(least, "root").select("digest", "component_id"), "names")
    out = rows.join(names, "digest", "left").select("doc_id", "ident", "mark", F.col("n").alias("n_shingles"), "digest", "component_id")
    out = scratch.keep(out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))), "grouped")
    for name in ("rows", "nodes", "met", "stars", "sets", "near", "roots", "open", "usable", "places", "rest", "far", "named", "least", "names"):
        scratch.drop(name)
    return out


def _named(about: DataFrame, prefix: str) -> DataFrame:
    return about.select(F.col("node").alias(prefix), *[F.col(c).alias(f"{prefix}{c}") for c in ("n", *SKETCH)])


def near_duplicates(docs: DataFrame, words: int = WORDS, at_least: tuple[int, int] = AT_LEAST, band: int = BAND, apart: int = APART) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id it is linked to), kept.

    A-Z are lower-cased, words are runs of non-white-space; a document's set is its distinct shingles of ``words`` words,
    fewer words are one shingle. Sets are linked if ``at_least[1] * shared >= at_least[0] * all``; the decision is on full
    sets (of 64-bit hashes). A text without words, or a null, is linked with nothing and stays. Equal sets are one node and
    always linked. Null ids count as smallest only where a component has no other. Repeated rows get a row each, an empty
    table gives no rows, other columns aren't read. A text is hashed whole, in some 100 bytes of memory for each shingle.
    """
    rows = grouped(docs, words, at_least, band, apart)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
