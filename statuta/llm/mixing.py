"""Mixing sources to target weights under a cap on repetitions.

Sizes are tokens of a public tokenizer. The wanted total is, unless given, one pass over
the tokens of the target sources. Every source gets its target share of it, or all that
its cap of repetitions allows. What scarce sources leave open is filled from the others
by temperature: in proportion to their found tokens to the power x, where x = 0 fills
evenly and x = 1 repeats nothing more than the corpus does. The exponent is bisected to
the least at which no source needs more than its cap; if a least entropy of the mix is
asked for, to the largest that still has it, and ``entropy_met`` tells if none has. A
source that would need more than its cap even at x = 1 gives all it may.

So a source with enough tokens always has at least its target share; by how much a gap
elsewhere lifts it is reported. With ``exact`` the total is instead the largest at which
every source that has documents meets its target exactly and nothing is left to fill.

The weights are realised as budgeted block permutations: a source's documents are
dealt to blocks by a hash, the blocks are taken in hash order, whole passes first,
and only the block in which the budget ends is ordered and cut. Block sums, not
documents, decide where that is, so no task sees a whole source.

A source without documents, or with none that has a token, has actual share 0. Null
sources and sources without a target are left out. Null and empty texts have no token
and are never drawn. Copies of a target row count once. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import cut

#: Documents a block holds on average.
BLOCK_DOCUMENTS = 2000
#: A target counts as met if the actual share is within so much of it.
TOLERANCE = 0.01


def tempered(available: dict[str, float], x: float) -> dict[str, float]:
    """Shares of the found tokens to the power x."""
    raw = {s: a**x for s, a in available.items()}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def entropy(sizes: dict[str, float]) -> float:
    total = sum(sizes.values())
    return -sum(w / total * math.log(w / total) for w in sizes.values() if w > 0) if total else 0.0


def _bisect(holds, good: float, bad: float, steps: int = 60) -> float:
    """The end, next to ``bad``, of the stretch from ``good`` on in which ``holds`` is true."""
    for _ in range(steps):
        middle = (good + bad) / 2
        good, bad = (middle, bad) if holds(middle) else (good, middle)
    return good


def fill(base: dict[str, float], available: dict[str, float], caps: dict[str, float], total: float, least_entropy: float | None = None) -> tuple[dict[str, float], float, bool | None]:
    """The budgets that fill ``base`` up to ``total``, the exponent, and whether the mix has
    the least entropy (None if none is asked for)."""
    base = dict(base)

    def budgets(x: float) -> dict[str, float]:
        room = {s: available[s] for s in base if base[s] < caps[s]}
        gap = max(total - sum(base.values()), 0.0)
        return {s: b + (gap * tempered(room, x)[s] if s in room else 0.0) for s, b in base.items()}

    def over(x: float) -> list[str]:
        return [s for s, b in budgets(x).items() if b > caps[s] * (1 + 1e-12)]

    while over(1.0):
        base |= {s: caps[s] for s in over(1.0)}
    x = 0.0 if not over(0.0) else _bisect(lambda x: not over(x), 1.0, 0.0)
    if least_entropy is None:
        return budgets(x), x, None
    even = lambda x: not over(x) and entropy(budgets(x)) >= least_entropy
    if not even(x):
        return budgets(x), x, False
    x = 1.0 if even(1.0) else _bisect(even, x, 1.0)
    return budgets(x), x, True


def sizes(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share wanted, cap, documents and tokens. At most one row per target."""
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = counted.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def plan(sized: list, total_tokens: float | None = None, least_entropy: float | None = None, passes: float = 1.0, exact: bool = False) -> list[tuple]:
    """``(source, budget, temperature, blocks, entropy_met)`` of every source that can be drawn
    from. ``passes`` wants a total of so many times all their tokens. ``sized`` are the rows of
    ``sizes``; their number is that of the targets."""
    asked = {r.source: float(r.target_share or 0) for r in sized}
    norm = sum(asked.values())
    available = {r.source: float(r.n_tokens) for r in sized if r.n_tokens and asked[r.source] > 0 and (r.max_repeats or 0) > 0}
    if not available:
        return []
    caps = {r.source: float(r.n_tokens) * r.max_repeats for r in sized if r.source in available}
    documents = {r.source: r.n_docs for r in sized}
    if exact:
        norm = sum(asked[s] for s in available)
        total = min(caps[s] * norm / asked[s] for s in available)
    else:
        total = total_tokens or passes * sum(available.values())
    base = {s: min(asked[s] / norm * total, caps[s]) for s in available}
    budgets, x, even = fill(base, available, caps, total, least_entropy)
    return [(s, b, x, max(1, documents[s] // BLOCK_DOCUMENTS), even) for s, b in budgets.items()]


def draw(counted: DataFrame, planned: list[tuple], seed: int = 7) -> DataFrame:
    """``doc_id, source, n_tokens, uses``: how often each document is used (rows with 0
    uses are left out). A source's total differs from its budget by less than one document."""
    spark = counted.sparkSession
    budgets = spark.createDataFrame(planned, "source string, budget double, temperature double, blocks bigint, entropy_met boolean")
    docs = counted.where(F.col("n_tokens") > 0).join(F.broadcast(budgets), "source")  # one row per target source
    mixed = F.xxhash64("doc_id", F.lit(seed))
    docs = docs.withColumn("block", F.pmod(mixed, "blocks")).withColumn("at", F.xxhash64("doc_id", F.lit(seed + 1)))
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("budget").alias("budget"))
    in_order = Window.partitionBy("source").orderBy("turn", "block")
    pass_size = F.sum("size").over(Window.partitionBy("source"))
    blocks = blocks.withColumn("turn", F.xxhash64("block", F.lit(seed + 2))).withColumn("until", F.sum("size").over(in_order)).withColumn("pass", pass_size)
    blocks = blocks.withColumn("whole", F.floor(F.col("budget") / F.col("pass"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("pass"))
    blocks = blocks.select("source", "block", "whole", (F.col("until") <= F.col("rest")).alias("full"), ((F.col("until") > F.col("rest")) & (F.col("until") - F.col("size") < F.col("rest"))).alias("ends_here"), (F.col("rest") - F.col("until") + F.col("size")).alias("left"))
    placed = docs.select("doc_id", "source", "n_tokens", "block", "at").join(blocks, ["source", "block"])
    done = placed.where(~F.col("ends_here")).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("full").cast("bigint")).alias("uses"))
    inside = Window.partitionBy("source", "block").orderBy("at", "doc_id")
    last = placed.where("ends_here").withColumn("until", F.sum("n_tokens").over(inside))
    last = last.select("doc_id", "source", "n_tokens", (F.col("whole") + (F.col("until") <= F.col("left")).cast("bigint")).alias("uses"))
    return done.unionByName(last).where("uses > 0")


def mix(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None, least_entropy: float | None = None, seed: int = 7, passes: float = 1.0, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the report of shares. ``counted``: doc_id, source, n_tokens.
    ``met``: the source has at least its target share of what was drawn, within TOLERANCE."""
    counted = cut(counted)
    sized = sizes(counted, targets)
    planned = plan(sized.collect(), total_tokens, least_entropy, passes, exact)  # one row per target
    drawn = draw(counted, planned, seed)
    spark = counted.sparkSession
    budgets = spark.createDataFrame([(s, b, x, e) for s, b, x, _, e in planned], "source string, budget double, temperature double, entropy_met boolean")
    used = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("uses").alias("most_uses"))
    whole = Window.partitionBy()  # over one row per target
    report = sized.join(budgets, "source", "left").join(used, "source", "left").select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce("budget", F.lit(0.0)).alias("budget"), "temperature", "entropy_met",
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    share = F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(whole)), F.lit(0.0))
    report = report.withColumn("actual_share", share)
    return drawn, report.withColumn("over_share", F.greatest(F.col("actual_share") - F.col("target_share"), F.lit(0.0))).withColumn("met", F.col("actual_share") >= F.col("target_share") - TOLERANCE)
