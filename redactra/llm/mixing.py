"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised.  The exponent
is bisected to meet a target entropy, or to be the flattest under which no
source is repeated more than a limit.  The weights are realised as token
budgets: whole passes over a source and a part of one.  A source's documents
are dealt into blocks once; each pass permutes the blocks by a keyed bijection
of their numbers, and reads a block as a whole.  The part is cut along its own
permutation, so no document moves: only the block at the cut is looked into.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .base import cut, named, without

#: Sources whose totals the driver holds and broadcasts (16 bytes and a name each); beyond them sums and joins are distributed.
DRIVER_SOURCES = 100_000
#: Documents that a block should have.
BLOCK = 256
#: Blocks of one source at most, as a power of two; beyond that blocks grow.
MAX_BITS = 17
MAX_REPEATS = 2.0
SEED = 20_261
RESULT = ["mix_source", "mix_tokens", "mix_epoch", "mix_order"]


def mix_weights(tokens: dict, exponent: float) -> dict:
    """Shares of tokens to the power ``exponent``, normalised; sources without tokens get 0."""
    total = sum(tokens.values()) or 1
    raised = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    s = sum(raised.values()) or 1.0
    return {k: v / s for k, v in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def find_exponent(tokens: dict, budget: float, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """Bisects the exponent in [0, 1]: 1 keeps the shares, 0 gives every source the same.

    With ``target_entropy``: the largest exponent whose mix has that entropy at
    least.  Else the smallest under which ``budget`` tokens repeat no source
    more than ``max_repeats`` times.  If no exponent meets the target, the
    nearest end of the range.
    """

    def flat_enough(x: float) -> bool:
        return entropy(mix_weights(tokens, x)) >= target_entropy

    def too_flat(x: float) -> bool:
        w = mix_weights(tokens, x)
        return any(w[k] * budget > max_repeats * n for k, n in tokens.items() if n)

    if not any(tokens.values()):
        return 1.0
    low, high = 0.0, 1.0
    good = flat_enough if target_entropy is not None else too_flat
    if good(high):  # as it is, flat enough; or repeated too often whatever the exponent
        return high
    if not good(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low if target_entropy is not None else high


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sums(totals: DataFrame, exponents: list[float], whole: float) -> list[tuple[float, float]]:
    """For each exponent the sum of the raised shares, and the sum of share times its logarithm, in one pass."""
    share = F.col("tokens") / F.lit(float(whole))
    raised = [F.when(F.col("tokens") > 0, F.pow(share, F.lit(x))).otherwise(0.0) for x in exponents]
    row = totals.agg(*(F.sum(r) for r in raised), *(F.sum(F.when(F.col("tokens") > 0, r * F.log(r)).otherwise(0.0)) for r in raised)).first()
    return list(zip(row[: len(exponents)], row[len(exponents) :], strict=True))


def find_exponent_of(totals: DataFrame, whole: int, budget: float, target_entropy: float | None, max_repeats: float | None, ways: int = 32) -> float:
    """As :func:`find_exponent` over a table of totals: each round sums ``ways`` exponents at once and keeps one interval."""
    least = totals.where("tokens > 0").agg(F.min("tokens")).first()[0]
    if least is None:
        return 1.0

    def good(x: float, s: float, slog: float) -> bool:
        if target_entropy is not None:  # the entropy of r/s over all r
            return math.log(s) - slog / s >= target_entropy
        # the smallest source repeats most, whatever the exponent
        return (least / whole) ** x / s * budget > max_repeats * least

    low, high = 0.0, 1.0
    (first, last) = _sums(totals, [low, high], whole)
    if good(high, *last):
        return high
    if not good(low, *first):
        return low
    while high - low > 2.0**-52 and high - low > 1e-12:
        steps = [low + (high - low) * k / ways for k in range(1, ways)]
        kept = [x for x, own in zip(steps, _sums(totals, steps, whole), strict=True) if good(x, *own)]
        low = max(kept, default=low)
        high = min([x for x in steps if x > low], default=high)
    return low if target_entropy is not None else high


def _tag(row: Column) -> Column:
    """A row's pseudo-random place in its source, 0 to 2^62: its highest bits are the block, the others the place there."""
    return F.shiftrightunsigned(F.xxhash64(row, F.lit(SEED)), 2)


def _block(tag: Column, bits: Column) -> Column:
    return F.call_function("shiftright", tag, F.lit(62) - bits)


def _permuted(block: Column, bits: Column, epoch: Column) -> Column:
    """The block's place in a pass: odd multiples, sums and folded halves are bijections of ``bits`` bits."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.greatest((bits / 2).cast("int"), F.lit(1))
    for k in range(3):
        key = F.xxhash64(epoch.cast("long"), F.lit(SEED + 1 + k))
        odd = F.shiftrightunsigned(key, 44).bitwiseOR(F.lit(1))  # 20 bits, so that no product overflows
        block = (block * odd + F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 24)).bitwiseAND(mask)
        block = block.bitwiseXOR(F.call_function("shiftrightunsigned", block, half))
    return block


def mix(
    docs: DataFrame, budget_tokens: int | None = None, target_entropy: float | None = None, max_repeats: float = MAX_REPEATS, source_col: str = "source", id_col: str = "doc_id",
    text_col: str = "text", keep: list[str] | None = None, tokens: Column | None = None, driver_sources: int = DRIVER_SOURCES,
) -> DataFrame:
    """One row for each use of a document: ``keep`` columns and mix_source, mix_tokens, mix_epoch, mix_order.

    ``tokens``: a document's number of tokens, such as a column that a tokenizer
    counted; by default a word is a token.  ``budget_tokens`` (default: as many
    as there are) are shared out by the weights; ordering by (mix_epoch,
    mix_order) gives the mix.  A null source is a source; a null text has no
    words, a null count is none, and such documents follow their source's
    passes.  A row's place is fixed by its id and text, so repeated rows are
    used alike, and a source may get one place's tie more than its budget.
    Columns of ``docs`` named like a result give way to it.  With more than
    ``driver_sources`` sources, sums and shares stay distributed.
    """
    keep = without(docs.columns, RESULT) if keep is None else keep
    count = F.coalesce((count_words(named(text_col)) if tokens is None else tokens).cast("long"), F.lit(0).cast("long"))
    tag = _tag(F.xxhash64(named(id_col), F.xxhash64(named(text_col))))
    source = named(source_col).cast("string")
    narrow = cut(docs.select(source.alias("s"), tag.alias("h"), count.alias("n")), "mix")
    totals = cut(narrow.groupBy("s").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "totals")
    spark = docs.sparkSession
    few = totals.limit(driver_sources + 1).count() <= driver_sources
    spread = F.broadcast if few else lambda table: table
    all_tokens = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = all_tokens if budget_tokens is None else budget_tokens
    if few:
        found = {r["s"]: int(r["tokens"]) for r in totals.collect()}
        weights = mix_weights(found, find_exponent(found, budget, target_entropy, max_repeats))
        rows = [(k, round(w * budget)) for k, w in weights.items()]
        wanted = spark.createDataFrame(rows, "ws string, wanted long")
        shares = totals.join(F.broadcast(wanted), totals["s"].eqNullSafe(wanted["ws"])).drop("ws")
    else:
        x = find_exponent_of(totals, all_tokens, budget, target_entropy, max_repeats)
        total = _sums(totals, [x], all_tokens)[0][0] if all_tokens else 1.0
        raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(all_tokens or 1)), F.lit(x))).otherwise(0.0)
        shares = totals.withColumn("wanted", F.rint(raised / F.lit(total) * F.lit(float(budget))).cast("long"))
    has = F.col("tokens") > 0
    one = F.greatest(F.col("tokens"), F.lit(1))
    shares = shares.select(
        "s", F.when(has, F.floor(F.col("wanted") / one)).otherwise(1).cast("long").alias("whole"), F.when(has, F.pmod("wanted", one)).otherwise(0).cast("long").alias("part"),
        F.least(F.lit(MAX_BITS), F.greatest(F.lit(1), F.ceil(F.log2(F.col("docs") / BLOCK)))).cast("int").alias("bits"),
    )
    shares = cut(shares, "shares")
    # how far the part of a pass goes: over its blocks in their order, then within the block at the cut
    own = spread(shares.where("part > 0").select(F.col("s").alias("ss"), "whole", "part", "bits"))
    placed = narrow.join(own, narrow["s"].eqNullSafe(F.col("ss"))).withColumn("at", _permuted(_block(F.col("h"), F.col("bits")), F.col("bits"), F.col("whole")))
    per_block = cut(placed.groupBy("s", "at", "part").agg(F.sum("n").alias("bn")), "blocks")
    so_far = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("before", F.coalesce(F.sum("bn").over(so_far), F.lit(0)))
    edge = cut(per_block.where("before < part and before + bn >= part").groupBy("s").agg(F.min("at").alias("edge"), F.min_by("before", "at").alias("before")), "edge")
    edges = spread(edge.select(F.col("s").alias("es"), "edge", "before"))
    at_edge = placed.join(edges, placed["s"].eqNullSafe(F.col("es")) & (placed["at"] == F.col("edge"))).select("s", "n", "h", "part", "before")
    inner = Window.partitionBy("s").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    cuts = at_edge.withColumn("upto", F.col("before") + F.sum("n").over(inner)).where("upto >= part").groupBy("s").agg(F.min("h").alias("last"))
    ends = cut(cuts.join(spread(edge.select(F.col("s").alias("es"), "edge")), cuts["s"].eqNullSafe(F.col("es"))).select(F.col("s").alias("cs"), "edge", "last"), "cuts")
    plan = cut(shares.join(spread(ends), shares["s"].eqNullSafe(ends["cs"]), "left").select(F.col("s").alias("__s__"), "whole", "bits", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("last", F.lit(-1)).alias("last")), "plan")
    used = docs.select(*[named(c) for c in keep], source.alias("mix_source"), count.alias("mix_tokens"), tag.alias("__h__"))
    joined = used.join(spread(plan), F.col("mix_source").eqNullSafe(F.col("__s__"))).withColumn("__block__", _block(F.col("__h__"), F.col("bits")))
    at = _permuted(F.col("__block__"), F.col("bits"), F.col("whole"))
    more = (at < F.col("edge")) | ((at == F.col("edge")) & (F.col("__h__") <= F.col("last")))
    times = F.col("whole") + more.cast("long")
    uses = joined.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    rest = F.lit(62) - F.col("bits")
    place = F.call_function("shiftleft", _permuted(F.col("__block__"), F.col("bits"), F.col("mix_epoch")), rest)
    inside = F.col("__h__").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1)
    out = uses.withColumn("mix_order", place + inside)
    return out.select(*[named(c) for c in keep], *RESULT)
