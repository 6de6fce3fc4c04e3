"""Mixing sources to target weights by Pfair scheduling.

A source of weight w has for its block j (from 1) the window of slots [floor((j-1)/w), ceil(j/w)). One slot runs one
block; the released block with the earliest deadline runs. Weights are whole parts of a period, exactly as they are given, so
all windows repeat after a period of as many slots as there are parts: one period, whose length depends on the weights and not on the data,
is scheduled by an SQL fold, and blocks get their slot from it by arithmetic. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from fractions import Fraction
from numbers import Integral, Rational, Real

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents per block, documents per numbering bucket, buckets per group.
BLOCK_ROWS, BUCKET_ROWS, GROUP = 16, 2000, 1000
#: Parts that default weights are out of, about; slots per inner fold; slots of a period at most.
DEFAULT_PARTS, FOLD, MOST_PERIOD = 512, 512, 1 << 20
#: Slots of a period that are broadcast; beyond, the join with blocks shuffles.
MOST_BROADCAST = 200_000


def default_parts(counts: dict[str, int], parts: int = DEFAULT_PARTS) -> dict[str, int]:
    """The default target weights: whole parts in proportion to the square roots of counts, about `parts` in all, one each at least."""
    total = sum(n**0.5 for n in counts.values())
    return {s: max(1, math.floor(n**0.5 / total * parts + 0.5)) for s, n in counts.items()}


def whole_parts(weights: dict[str, float], most: int = MOST_PERIOD) -> dict[str, int]:
    """Weights as whole parts of one period, in lowest terms: exact (a float counts as the decimal number that it prints as), unless
    the period would be longer than `most` slots; then the nearest parts out of `most`, one each at least, so that a share is off by
    1 / most at the utmost. A weight that is not a positive finite number is an error."""
    for s, w in weights.items():
        if not (isinstance(w, Real) and math.isfinite(w) and w > 0):
            raise ValueError(f"the weight of {s!r} is not a positive number: {w!r}")
    exact = {s: Fraction(int(w)) if isinstance(w, Integral) else Fraction(w) if isinstance(w, Rational) else Fraction(str(float(w))) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values())) if exact else 1
    parts = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*parts.values()) if parts else 1
    parts = {s: n // common for s, n in parts.items()}
    total = sum(parts.values())
    return parts if total <= most else {s: max(1, round(Fraction(n * most, total))) for s, n in parts.items()}


def pfair_period(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """(source, nth, slot) for one period of sum(parts) slots: earliest deadline first among released blocks, ties by
    source. After any number of slots of repeated periods each source has run less than one block more or less than its weight's share.

    Sources of equal parts have equal windows, so they run in turn, by name: the fold's state is a number per distinct part, of
    which there are at most sqrt(2 * period), and its choice the source whose turn it is. All of it is in exact longs."""
    names, period = sorted(parts), sum(parts.values())
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(names):
        groups.setdefault(parts[s], []).append(i)
    sizes = sorted(groups)
    data = [(sizes, [groups[p] for p in sizes])] if names else []
    one = spark.createDataFrame(data, "p array<long>, who array<array<int>>")
    div = lambda x, y: F.call_function("div", x, y)
    whole = F.lit(period).cast("long")

    def step(state: Column, t: Column) -> Column:
        # of a group's next block: floor(done / w) <= t releases it, ceil((done + 1) / w) is its deadline; w = part / period
        def next_block(p: Column, g: Column) -> Column:
            ran, members = F.get(state["ran"], g), F.get(F.col("who"), g)
            done = div(ran, F.size(members).cast("long"))
            turn = F.get(members, (ran % F.size(members)).cast("int"))
            return F.when(div(done * whole, p) <= t, F.struct(div((done + 1) * whole + p - 1, p).alias("deadline"), turn.alias("source"), g.alias("g")))

        live = F.transform("p", next_block)
        # an array of one binds the choice, so that it is made once a slot and not once a group
        best = F.array(F.array_min(F.filter(live, lambda x: x.isNotNull())))
        moved = lambda k: F.transform(state["ran"], lambda r, g: F.when(g == k["g"], r + 1).otherwise(r))
        return F.transform(best, lambda k: F.struct(moved(k).alias("ran"), F.concat(state["order"], F.array(k["source"])).alias("order")))[0]

    def run(state: Column, at: Column) -> Column:
        # an inner fold per FOLD slots: its order is copied once
        start = F.struct(state["ran"].alias("ran"), F.array().cast("array<int>").alias("order"))
        slots = F.sequence(at, F.least(at + FOLD, whole) - 1)
        return F.aggregate(slots, start, step, lambda x: F.struct(x["ran"].alias("ran"), F.concat(state["orders"], F.array(x["order"])).alias("orders")))

    zero = F.struct(F.transform("p", lambda x: F.lit(0).cast("long")).alias("ran"), F.array().cast("array<array<int>>").alias("orders"))
    folds = F.sequence(F.lit(0).cast("long"), F.greatest(whole, F.lit(1)) - 1, F.lit(FOLD).cast("long"))
    done = one.select(F.flatten(F.aggregate(folds, zero, run, lambda x: x["orders"])).alias("order"))
    slots = done.select(F.posexplode("order").alias("slot", "i"))
    named = spark.createDataFrame(list(enumerate(names)), "i int, source string")
    return slots.join(named, "i").select("source", (F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1).alias("nth"), "slot")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """docs with mix_block (long, from 0 within its source), mix_slot (long, one per block) and mix_pos (int in the
    block): the order (mix_slot, mix_pos) interleaves the sources' blocks to their target weights.

    weights: target weight per source, exact (whole_parts); by default whole parts near to the square root of its number of rows
    (default_parts). While all sources last, each has at any slot less than one block more or less than its weight's
    share of the slots. When one is used up, its slots stay empty and the rest go on in their proportions. Every row has
    its place exactly once. Inside a source the order is that of the MD5 of the id (of the whole row, where the id is null), then the id, then a
    hash of the row; blocks are full but the last. Only rows that are equal in all columns are interchangeable, so a task that runs
    again gives the same places. Null sources are one source ''. Sources without a weight count as the smallest weight
    given; weights of sources that are not there count for nothing. Columns of docs named mix_* are replaced. Numbering a source takes no sorted pass over it: ids are hashed
    to buckets of about bucket_rows rows, and bucket sizes are added up in two levels. There may be any number of sources; their
    sizes are read to the driver, and the fold takes a period's slots times distinct parts steps, in one task; neither grows with the rows of a source."""
    docs = docs.drop("mix_block", "mix_slot", "mix_pos")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    found = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n"), F.count(id_col).alias("known")).collect()
    sizes, rows = {r["s"]: r["n"] for r in found}, sum(r["n"] for r in found)
    if weights:
        least = min(weights.values())
        parts = whole_parts({s: weights.get(s, least) for s in sizes})
    else:
        parts = whole_parts(default_parts(sizes))
    period = sum(parts.values()) or 1
    buckets = max(1, -(-rows // bucket_rows))
    slots = pfair_period(docs.sparkSession, parts).select(F.col("source").alias("__s"), F.col("nth").alias("__nth"), F.col("slot").alias("__slot"))
    shares = docs.sparkSession.createDataFrame(sorted(parts.items()) or [("", 1)], "__s string, __share long")

    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.xxhash64(*hashed) if hashed else F.lit(0)
    name = F.col(id_col).cast("string")
    if any(r["known"] < r["n"] for r in found):
        name = F.coalesce(name, whole.cast("string"))
    key = docs.withColumn("__s", source).withColumn("__b", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % buckets)
    # rows of the source in earlier buckets: sums within groups of buckets, and of earlier groups
    count = key.groupBy("__s", "__b").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("__b") / GROUP))
    group = count.groupBy("__s", "g").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("__s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    group = group.select("__s", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("__s", "g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = count.withColumn("skip", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(group, ["__s", "g"]).select("__s", "__b", (F.col("base") + F.col("skip")).alias("__start"))
    number = F.row_number().over(Window.partitionBy("__s", "__b").orderBy(id_col, whole)) - 1
    at = key.withColumn("__i", number).join(start, ["__s", "__b"]).withColumn("__n", F.col("__start") + F.col("__i"))
    block = at.withColumn("mix_block", F.floor(F.col("__n") / block_rows)).withColumn("mix_pos", (F.col("__n") % block_rows).cast("int"))
    near = lambda x, n: F.broadcast(x) if n <= most_broadcast else x
    weighed = block.join(near(shares, len(parts)), "__s")
    placed = weighed.withColumn("__nth", F.col("mix_block") % F.col("__share")).join(near(slots, period), ["__s", "__nth"])
    return placed.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("__share")) * period + F.col("__slot")).select(*docs.columns, "mix_block", "mix_slot", "mix_pos")
