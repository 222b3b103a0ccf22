"""Near copies by word shingles of a Jaccard similarity, for SimHash fingerprints that no bounded family of masks covers.

Texts whose fingerprints differ in at most ``RADIUS`` bits meet by covering masks and are compared exactly. At a similarity
of 0.8 fingerprints of 64 bits differ in about ten bits, up to sixteen or more, and covering these would take over
100,000 tables. So the pairs beyond the radius are found by their rarest shingles, without loss: shingles have one order
for all texts, the rarest first. Two sets of similarity ``t`` share at least ``ceil(t n)`` elements, of which the first
``k`` are among the first ``n - ceil(t n) + k`` shingles of each. The order only decides how many pairs are compared:
frequent shingles are found in a sample, and no pair is missed whatever the sample holds. Members of a large group are
paired only if enough of their shingles occur outside the group that they are linked to already, which is counted over
all sets, not over a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, text_or_empty
from .components import connected_components
from .simhash import first_of_each, link_fingerprints, majority, signed

WORDS, SEED, AT_LEAST = 5, 42, 0.8
#: Documents that the frequent shingles are counted in, and how many of these are told to every task at most.
SAMPLE, FREQUENT = 40_000, 500_000
#: How many of their first shingles a pair must share to be compared: a tenth of a set, up to this.
SHARED = 8
#: Nodes that meet on a shingle of up to so many are paired as they are; those of larger crowds must have enough in common first.
CROWD = 64


def hashed(text: bytes, words: int = WORDS) -> np.ndarray:
    """The XXH64 of a text's shingles in order; fewer words are one shingle, no words none."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[min(words, len(parts)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(hashed(text, words).view(np.int64))


def shared_first(n: int) -> int:
    """How many of its first shingles a set of n is asked to share."""
    return min(SHARED, max(1, n // 10))


def prefix_length(n: int, at_least: float) -> int:
    """How many of ``n`` elements hold the first ``shared_first(n)`` that are common with any set of that similarity."""
    return min(n, n - math.ceil(at_least * n - 1e-9) + shared_first(n))


def _digest(own: np.ndarray) -> bytes:
    """128 bits that name a set of shingles: texts with equal sets have one name."""
    return xxhash.xxh3_128_digest(own.tobytes())


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), pa.int64()))


def _prefixes(words: int, at_least: float, common: np.ndarray, counts: np.ndarray):
    """Adds the digest of each text's set, its size, fingerprint and first shingles; ``common`` (sorted) are the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, prints, firsts = [], [], [], []
            for t in batch.column(batch.num_columns - 1):
                every = hashed(t.as_py(), words)
                prints.append(signed(majority(every)))
                own = np.unique(every.view(np.int64))
                often = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    often = np.where(common[at] == own, counts[at], 0)
                digests.append(_digest(own))
                sizes.append(len(own))
                firsts.append(own[np.lexsort((own, often))][: prefix_length(len(own), at_least)])
            added = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), _lists(firsts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "digest", "n", "fp", "first"])

    return run


def _sets(words: int):
    """Rows (node, text) -> (node, own), the set of each text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(own)], ["node", "own"])

    return run


def _frequent(texts: DataFrame, words: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several documents of a sample, and in how many; of bounded number."""
    every = max(1, texts.count() // sample)
    some = texts.where(F.pmod("mark", F.lit(every)) == 0).select("mark", "text").mapInArrow(_sets(words), "node long, own array<long>")
    counted = some.select(F.explode("own").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow().sort_by("h")
    return found["h"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)


def _similar(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.where(F.col("shared") >= F.lit(at_least) * (F.col("n") + F.col("m") - F.col("shared")) - 1e-9).select("a", "b")


def _first_shared(n: Column) -> Column:
    return F.least(F.lit(SHARED), F.greatest(F.lit(1), F.floor(n / 10))).cast("int")


def _least_overlap(n: Column, m: Column, at_least: float) -> Column:
    """How many elements sets of n and m of that similarity share at least."""
    return F.lit(at_least / (1 + at_least)) * (n + m) - 1e-9


def _with_usable(met: DataFrame, at_least: float) -> DataFrame:
    """``met`` with ``usable``: how many elements a node can share with any partner at most. What stands before its
    k-th met shingle and is not met is in no partner, with k for the smallest partner's size. Nodes that can have no
    partner are left out."""
    k = _first_shared(F.ceil(F.lit(at_least) * F.col("n") - 1e-9))
    places = met.groupBy("node", "n").agg(F.sort_array(F.collect_list("at")).alias("places"))
    kth = F.try_element_at("places", k)
    usable = places.select("node", (F.col("n") - (kth - k)).alias("usable"), "n").where(F.col("usable") >= F.lit(at_least) * F.col("n") - 1e-9)
    return met.join(usable.select("node", "usable"), "node")


def _usable_outside(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, outside): how many shingles of each of ``nodes`` (node, root) are in a node of another root too, which is the
    most that it can share with any of them. The strays of a large group, whose own changes are nowhere else, have few."""
    own = sets.join(nodes, "node").select("node", "root", F.explode("own").alias("h"))
    mixed = own.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    outside = own.join(mixed, "h").groupBy("node").agg(F.count("*").alias("outside"))
    return nodes.select("node").join(outside, "node", "left").select("node", F.coalesce("outside", F.lit(0)).alias("outside"))


def _pairs_within_radius(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): nodes with the first node of their fingerprint's component, by covering masks."""
    nodes = table.select("fp", "node")
    fps = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprints")
    roots = link_fingerprints(fps.select("fp"), scratch)
    leads = fps.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    leads = leads.join(fps.select(F.col("fp").alias("root"), "lead"), "root").select("fp", "lead")
    return nodes.join(leads, "fp").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


def labelled(docs: DataFrame, words: int = WORDS, at_least: float = AT_LEAST, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ident, mark (see ``row_key``) and root, one for each component of documents whose shingles have
    a Jaccard similarity of ``at_least``. Texts without words (nulls too) count as equal; repeated rows get a row each;
    an empty table gives no rows. A text is hashed whole, with some 20 bytes for each of its shingles."""
    scratch = Scratch(docs.sparkSession)
    ident, mark = row_key()
    texts = docs.select("doc_id", ident.alias("ident"), mark.alias("mark"), text_or_empty().cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = _prefixes(words, at_least, *_frequent(texts, words, sample))
    wide = scratch.keep(texts.mapInArrow(run, f"doc_id {kind}, ident string, mark long, digest binary, n int, fp long, first array<long>"), "prefixes")

    rows = scratch.keep(wide.select("doc_id", "ident", "mark", "digest"), "rows")
    # one node for each set, named by its place in a written table
    nodes = wide.groupBy("digest").agg(F.min(F.struct("ident", "mark", "n", "fp", "first")).alias("k"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "k.*"), "nodes")
    scratch.drop("prefixes")
    entries = nodes.select("node", "n", F.posexplode("first").alias("at", "h")).select("h", "node", "n", (F.col("at") + 1).alias("at"))
    shared = entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    met = scratch.keep(entries.join(shared, "h"), "met")
    met = scratch.keep(_with_usable(met, at_least), "usable")
    scratch.drop("met")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        keys = nodes.join(wanted, "node", "left_semi").select("node", "ident", "mark")
        found = texts.select("ident", "mark", "text").join(keys, ["ident", "mark"]).dropDuplicates(["ident", "mark"]).select("node", "text")
        return scratch.keep(found.mapInArrow(_sets(words), "node long, own array<long>"), f"{name}-sets")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        links = scratch.keep(_similar(pairs, sets_of(ends, name), at_least), name)
        scratch.drop(f"{name}-sets")
        return links

    # First against one node of each shingle, the one with most to share: a large group of near copies is linked to what
    # it was copied from, in linear work.
    hubs = met.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("usable")).alias("own"), "node", "n", "usable")).alias("hub"))
    to_hub = met.join(hubs, "h").where("node <> hub.node").where(_may_share(F.col("n"), F.col("hub.n"), F.col("usable"), F.col("hub.usable"), at_least))
    stars = to_hub.groupBy(F.col("node").alias("a"), F.col("hub.node").alias("b"), "n", F.col("hub.n").alias("m")).agg(F.count("*").alias("c"))
    stars = stars.where(F.col("c") >= F.least(_first_shared(F.col("n")), _first_shared(F.col("m"))))
    links = similar(stars.select("a", "b").unionAll(_pairs_within_radius(nodes, scratch)), "near")
    roots = scratch.keep(connected_components(links, scratch, "first"), "roots")
    # Then every other pair that can share enough and is not linked yet; of nodes in crowds, by what they share outside
    # their own groups. What sets of n and m must share decides among how many of the first shingles of each one is common.
    known = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    open_ = scratch.keep(known.join(mixed, "h", "left_semi"), "open")
    scratch.drop("usable")
    crowds = open_.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("h", F.lit(True).alias("crowded"))
    open_ = scratch.keep(open_.join(crowds, "h", "left"), "crowds")
    strays = open_.where("crowded").select("node", "root").distinct()
    open_ = open_.join(_usable_outside(strays, sets_of(strays.select("node"), "open")), "node", "left")
    enough = F.col("crowded").isNull() | (F.col("outside") >= F.lit(at_least) * F.col("n") - 1e-9)  # all of a crowd have a count
    open_ = scratch.keep(open_.where(enough), "outside")
    x, y = open_.alias("x"), open_.alias("y")
    fits = _may_share(F.col("x.n"), F.col("y.n"), F.col("x.usable"), F.col("y.usable"), at_least)
    fits &= F.isnull("x.outside") | F.isnull("y.outside") | (F.least("x.outside", "y.outside") >= _least_overlap(F.col("x.n"), F.col("y.n"), at_least))
    need = F.ceil(_least_overlap(F.col("x.n"), F.col("y.n"), at_least))
    early = (F.col("x.at") <= F.col("x.n") - need + 1) & (F.col("y.at") <= F.col("y.n") - need + 1)
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits & early)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = similar(pairs, "rest")
    roots = connected_components(links.unionAll(more), scratch, "all")
    named = scratch.keep(nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "named")
    out = scratch.keep(rows.join(named, "digest").select("doc_id", "ident", "mark", "root"), "labelled")
    for name in ("rows", "nodes", "open", "crowds", "open-sets", "outside", "near", "near-pairs", "rest", "rest-pairs", "roots", "named"):
        scratch.drop(name)
    return out


def _may_share(n: Column, m: Column, usable: Column, other: Column, at_least: float) -> Column:
    return F.least(usable, other) >= _least_overlap(n, m, at_least)


def drop_near_copies(docs: DataFrame, words: int = WORDS, at_least: float = AT_LEAST, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with all their columns, one document of each component: the smallest doc_id, and of
    rows that share it the first by text hash. Null ids come last; of repeated rows one stays. Rules of ``labelled``."""
    return first_of_each(docs, labelled(docs, words, at_least, sample))
