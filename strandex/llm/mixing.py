"""Mixing sources by temperature, realised as budgeted block permutations. DataFrame operations only.

A source with a share p of all tokens (white-space separated words) gets the weight p^x / sum of p^x. The exponent x
in [0, 1] is the largest one at which the weights' entropy reaches `entropy` times its maximum (the logarithm of the
number of sources), raised as far as needed for no source to be repeated more than `repetition` times. It is found by
narrowing an interval 32-fold in each of four rounds, each one aggregate over the table of sources.

Every row has a pseudo-random place in its source; blocks are equal ranges of places, about `block_tokens` each. A
source with a quota of q tokens takes all its blocks floor(q / tokens) times, and of one more pass those in order of
place until the quota is reached; within the last block rows are counted out singly. So a quota is met up to one
row, whatever the source's size, and each pass lists blocks in another order.

A null source is a source of its own. Rows without words (null, empty texts) take places like others and cost
nothing; a source of such rows alone is taken once. Repeated rows share a place and come or go together. An empty
table stays empty. Columns of docs are kept in a struct, so that no name can clash.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Sources whose table is broadcast at most; above, sources are joined by a shuffle.
BROADCAST_SOURCES = 200_000
ROUNDS, GRID = 4, 32


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def exponent(sources: DataFrame, total: int, count: int, entropy: float, repetition: float, budget: int | None) -> float:
    """sources: tokens (over 0) of `count` sources, `total` together. budget None: see mixture()."""
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def narrowed(holds_low: bool, test) -> float:
        """The end of [0, 1] up to (from) which test holds, if it holds at the low (high) end and changes once."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            points = shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("x"))
            weighed = points.groupBy("x").agg(
                F.sum(F.pow("p", F.col("x"))).alias("z"),
                F.sum(F.pow("p", F.col("x")) * F.log("p")).alias("e"),
                F.max(F.pow("p", F.col("x") - 1)).alias("most"),
                F.min(F.pow("p", F.col("x") - 1)).alias("least"),
            )
            found = sorted(weighed.collect())
            holds = [test(r) for r in found]
            if holds_low:
                i = max((i for i, h in enumerate(holds) if h), default=0)
                low, high = grid[i], grid[min(i + 1, GRID)]
            else:
                i = min((i for i, h in enumerate(holds) if h), default=GRID)
                low, high = grid[max(i - 1, 0)], grid[i]
        return low if holds_low else high

    by_entropy = narrowed(True, lambda r: log(r.z) - r.x * r.e / r.z >= entropy * log(count) - 1e-9) if count > 1 else 1.0
    scale = (lambda r: r.most / r.least) if budget is None else (lambda r: r.most / r.z * budget / total)
    return max(by_entropy, narrowed(False, lambda r: scale(r) <= repetition + 1e-9))


def mixture(docs: DataFrame, entropy: float = 0.95, repetition: float = 4.0, budget: int | float | None = None, block_tokens: int = 1 << 20, seed: int = 1, id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The mixed rows (row: struct of docs' columns, epoch, block, turn: an order that permutes the blocks of each
    epoch) and the table of sources (source, tokens, weight, quota, epochs, cutoff, bits).

    budget: tokens of the mixture (int), or their ratio to the tokens there are (float); None is the smallest budget with
    which each row is taken at least once."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id), F.col(text)), 1)
    narrow = written(docs.select(F.col(source).alias("s"), place.alias("place"), F.regexp_count(F.col(text), F.lit(r"\S+")).cast("long").alias("n")).withColumn("n", F.coalesce("n", F.lit(0))), "places")
    sources = written(narrow.groupBy("s").agg(F.sum("n").alias("tokens")), "sources")
    some = sources.where("tokens > 0")
    count, total = some.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if isinstance(budget, float):
        budget = round(budget * total)
    x = exponent(some, total, count, entropy, repetition, budget) if count else 1.0
    share = F.col("tokens") / F.lit(float(max(total, 1)))
    power = F.when(F.col("tokens") > 0, F.pow(share, F.lit(x))).otherwise(0.0)
    z, least = sources.agg(F.sum(power), F.min(F.when(F.col("tokens") > 0, F.pow(share, F.lit(x - 1))))).first()
    if budget is None:
        # rounded so that the source repeated least gets its own tokens exactly
        quota = F.ceil(F.pow(share, F.lit(x - 1)) / F.lit(least or 1.0) * F.col("tokens") - 1e-6).cast("long")
    else:
        quota = F.floor(power / F.lit(z or 1.0) * F.lit(budget)).cast("long")
    planned = sources.select("s", "tokens", (power / F.lit(z or 1.0)).alias("weight"), F.when(F.col("tokens") > 0, quota).otherwise(0).alias("quota"))
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("long"))
    planned = planned.withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(0))
    planned = planned.withColumn("bits", F.least(F.lit(62), F.ceil(F.log2(F.greatest(F.col("tokens") / block_tokens, F.lit(1.0))))).cast("int"))
    planned = written(planned, "plan")
    n = planned.count()

    def block(place: str) -> F.Column:
        return F.expr(f"shiftright({place}, 63 - bits)")

    # the block in which the quota's last pass ends, then the place
    own = planned.where("rest > 0").select(F.col("s").alias("s_"), "rest", "bits")
    sums = narrow.join(_small(own, n), F.col("s").eqNullSafe(F.col("s_"))).select("s", "rest", "bits", block("place").alias("block"), "n").groupBy("s", "rest", "bits", "block").agg(F.sum("n").alias("n"))
    up_to = sums.withColumn("cum", F.sum("n").over(Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    last = written(up_to.where("cum > rest").groupBy("s", "rest", "bits").agg(F.min(F.struct("block", (F.col("cum") - F.col("n")).alias("before"))).alias("at")).select(F.col("s").alias("s_"), "rest", "bits", F.col("at.block").alias("block"), F.col("at.before").alias("before")), "last")
    ends = narrow.join(_small(last, n), F.col("s").eqNullSafe(F.col("s_")) & (block("place") == F.col("block")))
    ends = ends.withColumn("cum", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    cut = ends.groupBy("s", "bits", "block").agg(F.max(F.when(F.col("cum") <= F.col("rest"), F.col("place") + 1)).alias("cutoff"))
    cut = cut.select(F.col("s").alias("s_"), F.coalesce("cutoff", F.expr("shiftleft(block, 63 - bits)")).alias("cutoff"))
    planned = written(planned.join(_small(cut, n), F.col("s").eqNullSafe(F.col("s_")), "left").select(F.col("s").alias("source"), "tokens", "weight", "quota", "epochs", F.coalesce("cutoff", F.lit(0).cast("long")).alias("cutoff"), "bits"), "plan")

    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("s"), place.alias("place"))
    taken = placed.join(_small(planned, n), F.col("s").eqNullSafe(F.col("source"))).withColumn("copies", F.col("epochs") + (F.col("place") < F.col("cutoff")).cast("long"))
    rows = taken.where("copies > 0").withColumn("epoch", F.explode(F.expr("sequence(1, copies)"))).withColumn("block", block("place"))
    turn = F.xxhash64("epoch", "s", "block")
    return rows.select("row", "epoch", "block", turn.alias("turn"), "weight"), planned


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, at 0.95 of the highest entropy, no source more than four times."""
    rows, _ = mixture(table(spark, sf_dir, "documents"), budget=1.0)
    return rows.select("row.doc_id", "row.source", "epoch", "block", "turn", "weight")
