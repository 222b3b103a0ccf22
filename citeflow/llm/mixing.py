"""Mixing sources to target weights, with DataFrame expressions only.

1. Targets: one row per source; weights share out the total and caps are met by water-filling, in closed form.
2. Blocks: a keyed hash deals each source's documents into blocks of about ``block_words`` words. A source's whole
   passes take every block; the rest of its quota takes blocks in a permuted order until the words are reached. The
   block in which they are reached is filled document by document.
3. Splitting tree: the drawn blocks are the colours of an urn. At each of the tree's levels a shard range is halved:
   the left half's count of each source is drawn from the multivariate hypergeometric law, the right half keeps the
   rest. So every shard gets exact, disjoint quotas, and consecutive permuted blocks fill them.
4. Within a shard rows are ordered by another keyed hash.

All randomness is a hash of the seed and of stable keys, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACES, Scratch, row_key, shuffle_partitions

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, SEED = 50_000, 20_000_000, 20_240_601
#: Tasks that write one shard; each holds a random part of it in random order.
PIECES = 8
#: Most blocks of a source: these are numbered in one task, so beyond that blocks grow instead.
BLOCKS = 100_000
#: Level of the splitting tree at which its ranges are dealt to tasks.
SPREAD = 8
#: Groups of repeated rows, of some 20 bytes each, that are told to every task at most.
FEW = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(NOT_SPACES)), F.lit(0)).cast("long")


def source_key(name: str = "source") -> Column:
    """A source's name as a non-null key: null is told apart from any string."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(name).cast("string")))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """skey, place, source_size, target for (skey, size): one row per source, the only rows that meet in one task.

    Sources take the weights in turn, in code-point order with null last. A source's target is its weight's part of
    ``share`` times all sizes, but at most ``cap`` times its own size; what is cut off goes to the others by weight.
    """
    ratio = Window.orderBy("full_at", "skey")
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("skey") == "n", "skey")
    placed = sums.withColumn("place", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    one = placed.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("full_at", F.col("most") / F.col("w"))
    every = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    levels = one.withColumn("level", level)
    # the first source that isn't full at the level it would get sets the level of all that follow
    found = levels.withColumn("rise", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))).over(every)["level"])
    target = F.when(F.col("rise").isNull() | (F.col("rise") * F.col("w") > F.col("most")), F.col("most")).otherwise(F.col("rise") * F.col("w"))
    return found.select("skey", "place", "source_size", target.alias("target"))


def _uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total``, ``good`` of them marked, are marked: by inversion at ``u``.

    Probabilities are summed upwards over twelve standard deviations round the mean, which all but 1e-30 lies in.
    """
    g, n, d = good.cast("double"), total.cast("double"), draws.cast("double")
    mean = F.when(n > 0, d * g / n).otherwise(F.lit(0.0))
    spread = F.when(n > 1, F.sqrt(mean * (n - g) / n * (n - d) / (n - 1))).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0.0), d - (n - g), F.floor(mean - spread * 12 - 12)).cast("long")
    high = F.greatest(low, F.least(g, d, F.ceil(mean + spread * 12 + 12)).cast("long"))

    def walk(until: Column) -> Column:
        """Sum of the probabilities, as multiples of the first, and how many partial sums stay below ``until``."""

        def step(acc: Column, k: Column) -> Column:
            x = k.cast("double")
            p = F.when(k == low, F.lit(1.0)).otherwise(acc["p"] * (g - x + 1) * (d - x + 1) / (x * (n - g - d + x)))
            return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), (acc["below"] + (acc["sum"] + p < until).cast("long")).alias("below"))

        start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))
        return F.aggregate(F.sequence(low, high), start, step)

    below = F.aggregate(F.array(walk(F.lit(0.0))["sum"]), F.lit(0).cast("long"), lambda _, whole: walk(u * whole)["below"])
    return F.when(low >= high, low).otherwise(F.least(high, low + below))


def split_tree(counts: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(place, draws) of each source -> (shard, place, quota) for ``2 ** levels`` shards.

    Quotas of a source add up to its draws, and a shard's totals differ by at most one from an even share. A row holds
    one number for each source. From level ``SPREAD`` on, each task works on the subtrees of its own shard ranges.
    """
    urn = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "draws"))), lambda s: s["draws"]).alias("urn"))
    tree = urn.where(F.size("urn") > 0).select(F.lit(0).cast("long").alias("shard"), "urn")
    for level in range(levels):
        if level == SPREAD:
            tree = tree.repartition(shuffle_partitions(counts.sparkSession), "shard")

        def draw(acc: Column, n: Column) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), acc["shard"], F.size(acc["got"]))
            k = F.when(acc["left"] >= acc["rest"], n).otherwise(_hypergeometric(n, acc["rest"], acc["left"], u))
            # folding over the one draw names it, so that it is made once
            return F.aggregate(
                F.array(k),
                acc,
                lambda a, x: F.struct(
                    (a["left"] - x).alias("left"), (a["rest"] - n).alias("rest"), a["shard"].alias("shard"), F.concat(a["got"], F.array(x)).alias("got")
                ),
            )

        total = F.aggregate("urn", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(F.floor(total / 2).cast("long").alias("left"), total.alias("rest"), F.col("shard").alias("shard"), F.array().cast("array<bigint>").alias("got"))
        halves = tree.select("shard", "urn", F.aggregate("urn", start, draw)["got"].alias("left"))
        both = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("urn")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("urn", "left", lambda a, b: a - b).alias("urn")),
        )
        tree = halves.select(F.explode(both).alias("h")).select("h.shard", "h.urn")
    return tree.select("shard", F.posexplode("urn").alias("place", "quota"))


def _repeats_dealt(sized: DataFrame, scratch: Scratch, block_words: int) -> DataFrame:
    """Repeats of a row share a hash and so a block. Where they would fill one by themselves, each is hashed with its
    uid; such groups are no more than there are blocks."""
    many = sized.groupBy("h").agg(F.sum("size").alias("all"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("all") > block_words))
    many = scratch.keep(many.select("h", F.lit(True).alias("often")), "repeats")
    n = many.count()
    if not n:
        return sized
    rows = sized.join(F.broadcast(many) if n <= FEW else many, "h", "left")
    return scratch.keep(rows.withColumn("h", F.when(F.col("often"), F.xxhash64("h", "uid")).otherwise(F.col("h"))).drop("often"), "dealt")


def plan_mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` (uid, doc_id, source, text) -> uid, doc_id, size, source_size, target, taken, shards.

    ``shards`` has one entry for each time the mix takes the document. ``uid`` must be unique and stable.
    """
    ident, mark = row_key()
    sized = scratch.keep(docs.select("uid", "doc_id", source_key().alias("skey"), words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), ident, mark).alias("h")), "sized")
    sized = _repeats_dealt(sized, scratch, block_words)
    goals = scratch.keep(targets(sized, weights, share, cap), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("full", full).withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
    in_block = F.greatest(F.lit(block_words), F.ceil(F.col("source_size") / BLOCKS))
    goals = goals.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / in_block)).cast("long"))
    dealt = sized.join(goals.select("skey", "n_blocks", "place"), "skey").withColumn("block", F.pmod("h", "n_blocks")).drop("n_blocks", "skey")

    sums = dealt.groupBy("place", "block").agg(F.sum("size").alias("in_block")).withColumn("order", F.xxhash64(F.lit(seed + 1), "place", "block"))
    by_order = Window.partitionBy("place").orderBy("order", "block")
    blocks = sums.withColumn("to", F.sum("in_block").over(by_order)).withColumn("nth", F.row_number().over(by_order) - 1)
    blocks = blocks.join(goals.select("place", "full", "left", "n_blocks"), "place").withColumn("from", F.col("to") - F.col("in_block"))
    rest = F.when(F.col("to") <= F.col("left"), F.lit("all")).when(F.col("from") < F.col("left"), F.lit("part")).otherwise(F.lit("none"))
    blocks = scratch.keep(blocks.withColumn("rest", rest), "blocks")

    # the block in which a quota ends: largest documents first, each that still fits; its size bounds the array
    part = dealt.where("size > 0").join(blocks.where("rest = 'part'").select("place", "block", (F.col("left") - F.col("from")).alias("room")), ["place", "block"])
    lists = part.groupBy("place", "room").agg(F.sort_array(F.collect_list(F.struct("size", "h", "uid")), asc=False).alias("own"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("got"))

    def fit(acc: Column, d: Column) -> Column:
        return F.when(d["size"] <= acc["room"], F.struct((acc["room"] - d["size"]).alias("room"), F.concat(acc["got"], F.array(d["uid"])).alias("got"))).otherwise(acc)

    picked = lists.select(F.explode(F.aggregate("own", start, fit)["got"]).alias("uid"), F.lit(True).alias("picked"))

    # draws: the blocks of each whole pass, then those of the rest, in permuted order
    passes = F.when(F.col("rest") == "none", F.col("full")).otherwise(F.col("full") + 1)
    draws = blocks.where(passes > 0).select("place", "block", "nth", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"))
    draws = draws.withColumn("draw", F.row_number().over(Window.partitionBy("place").orderBy("epoch", "nth")))
    draws = scratch.keep(draws, "draws")
    total = goals.agg(F.sum("target")).first()[0] or 0
    levels = max(1, int(total // shard_words).bit_length())
    quotas = split_tree(draws.groupBy("place").agg(F.count("*").alias("draws")), levels, seed)
    ends = quotas.withColumn("to", F.sum("quota").over(Window.partitionBy("place").orderBy("shard"))).where("quota > 0")
    slots = ends.select("place", "shard", F.explode(F.sequence(F.col("to") - F.col("quota") + 1, F.col("to"))).alias("draw"))
    homes = draws.join(slots, ["place", "draw"]).groupBy("place", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("homes"))

    fates = blocks.select("place", "block", "rest", "full").join(homes, ["place", "block"], "left")
    out = dealt.join(fates, ["place", "block"]).join(picked, "uid", "left").join(goals.select("place", "source_size", "target"), "place")
    times = F.col("full") + F.when((F.col("rest") == "all") | ((F.col("rest") == "part") & F.col("picked")), 1).otherwise(0)
    shards = F.transform(F.slice(F.coalesce("homes", F.array().cast("array<struct<epoch:bigint,shard:bigint>>")), F.lit(1), times.cast("int")), lambda s: s["shard"])
    return out.select("uid", "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), shards.alias("shards"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards. See ``plan_mix`` for the parameters.

    Sizes are words (null text: none). Each document of a source is taken ``full`` times, some once more; documents
    of no words add nothing to ``taken``. Null sources are one source, the last; repeated rows are documents of their
    own; other columns are not read; an empty table gives no rows. Texts of any length are counted whole and don't
    move; a text that is larger than its source's rest is passed over for smaller ones. Sources are rows of one task
    (a number each), documents never are.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", "text")
    return plan_mix(rows, scratch, **how).drop("uid")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken, dealt to their
    shards and shuffled within them. Rules of ``mix_report``: null sources are one source, null and empty texts have
    no words (such rows go with the blocks they fall in), an empty table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = scratch.keep(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    plan = plan_mix(whole.select("uid", "row.doc_id", "row.source", "row.text"), scratch, **how)
    copies = plan.select("uid", F.posexplode("shards").alias("copy", "shard"))
    rows = whole.join(copies, "uid").withColumn("order", F.xxhash64("uid", "copy"))
    return rows.repartition("shard", F.pmod("order", F.lit(PIECES))).sortWithinPartitions("shard", "order").select("row.*")
