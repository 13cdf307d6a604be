"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent between 0 and 1 and scaled to
sum to one. The exponent is found by bisection: the flattest mix whose sources are
repeated within a limit, or the one of a target entropy. Weights are realised as
budgeted block permutations: a keyed hash deals a source's documents out to blocks once and
for all; each epoch has a keyed permutation of the blocks, and of the documents in each.
Whole epochs are used as they are, the last one up to the block, and in it the document, at
which the source's budget is used up. A block's place in a permutation is computed, not
looked up, so no table of blocks travels.

What reaches the driver is a row for each source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name

BLOCK_ROWS = 2048  # documents of a block, at least about so many
MOST_BITS = 22  # a source has 2**22 blocks at most
BROADCAST_SOURCES = 50_000  # up to so many sources the plan's rows go to all tasks; more are joined


def default_tokens() -> Column:
    """Tokens of a text, estimated as a quarter of its UTF-8 bytes, rounded up."""
    return F.coalesce(F.ceil(F.octet_length("text") / 4), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """Of each source, in the order of ``sizes``: weight, budget of tokens and epochs."""

    exponent: float
    budget: float
    weights: list[float]
    epochs: list[float]


def weights_at(sizes: list[int], exponent: float) -> list[float]:
    raised = [math.exp(exponent * math.log(n)) if n else 0.0 for n in sizes]
    total = math.fsum(raised) or 1.0
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w)


def plan(sizes: list[int], budget: float | None = None, max_repeats: float | None = None, target_entropy: float | None = None) -> Plan:
    """The mix for sources of ``sizes`` tokens. With ``max_repeats`` the exponent is the
    smallest with no source repeated more often; with ``target_entropy`` (nats) it is
    the one that gives that entropy, or the nearest that can be had. Without
    ``budget`` the budget is the least that uses every document once at least. A limit that
    the budget exceeds under every exponent is an error."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")

    def realised(exponent: float) -> Plan:
        weights = weights_at(sizes, exponent)
        total = budget if budget is not None else max((n / w for n, w in zip(sizes, weights) if w), default=0.0)
        epochs = [w * total / n if n else 0.0 for n, w in zip(sizes, weights)]
        return Plan(exponent, total, weights, epochs)

    def flat_enough(exponent: float) -> bool:  # true from some exponent on
        if max_repeats is not None:
            return max(realised(exponent).epochs, default=0.0) <= max_repeats * (1 + 1e-12)
        return entropy(weights_at(sizes, exponent)) <= target_entropy

    low, high = 0.0, 1.0
    if flat_enough(0.0):
        return realised(0.0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    if max_repeats is not None and not flat_enough(high):
        raise ValueError(f"a budget of {budget} needs more than {max_repeats} repeats of all sources together")
    return realised(high)


def _draw(epoch: Column, seed: int) -> Column:
    """A document's place in its block in an epoch: 0 up to, not including, 2**62."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("_id")), 2)


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _block(bits: Column, seed: int) -> Column:
    """A document's block among 2**bits."""
    return F.xxhash64(F.lit(seed), F.lit("block"), F.col("_id")).bitwiseAND(_power(bits) - 1)


def permuted(block: Column, bits: Column, key: Column) -> Column:
    """A block's place in a permutation of 2**bits blocks that ``key`` (a long) chooses. Each
    step maps the numbers of so many bits one to one: multiplying by an odd number and
    adding, and folding the upper half into the lower."""
    mask = _power(bits) - 1
    fold = F.floor((bits + 1) / 2).cast("int")
    x = block
    for step in range(3):
        own = F.xxhash64(key, F.lit(step))
        factor = own.bitwiseAND(F.lit((1 << MOST_BITS) - 1)).bitwiseOR(F.lit(1))
        x = (x * factor + F.shiftrightunsigned(own, 64 - MOST_BITS)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.call_function("shiftrightunsigned", x, F.greatest(fold, F.lit(1)))) if step < 2 else x
    return x


def _rank(epoch: Column, seed: int) -> Column:
    """The place of a document's block in its source's permutation of an epoch."""
    return permuted(F.col("_block"), F.col("_bits"), F.xxhash64(F.lit(seed), F.lit("order"), epoch.cast("long"), F.col("_source")))


SPAN = float(1 << 62)


def mix(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 2.0, target_entropy: float | None = None, slots: int = 1024, seed: int = 7, tokens: Column | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, source, text and any other columns, which pass
    unchanged whatever their names) once for each time that the mix uses it, with a column
    _mix (under more underscores if there is one): struct of tokens, epoch (from 0), block
    (its place in the epoch's permutation), slot and draw. Reading slots in order, and each
    in order of epoch, block and draw, gives a stream that holds the sources by weight throughout.

    A source uses each of its documents in every whole epoch; in the last, partial one
    those that come first in its permutation while their tokens fit the budget, so a
    source stays within its budget, by less than one document. A null source is a
    source. Texts without tokens cost nothing and are used in whole epochs, in one at
    least where each document is. Rows of equal doc_id are drawn together. An empty
    table gives an empty result."""
    spark = docs.sparkSession
    given, name = docs.columns, free_name(docs, "_mix")
    # the row as it is, apart from what is computed beside it
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"),
        F.col("doc_id").cast("long").alias("_id"),
        (default_tokens() if tokens is None else tokens).alias("_tokens"),
    )
    lean = held.select("_source", "_id", "_tokens")
    sizes = sorted((r["_source"], r["tokens"], r["rows"]) for r in lean.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")).collect())
    made = plan([n for _, n, _ in sizes], budget, max_repeats, target_entropy)
    known = []
    for (source, n, count), epochs in zip(sizes, made.epochs):
        full = math.floor(epochs + 1e-9)
        bits = min(MOST_BITS, max(0, (count // BLOCK_ROWS).bit_length()))
        known.append((source, max(full, 1) if not n and budget is None else full, float(epochs), int(max(0.0, epochs - full) * n), bits))
    schema = "_source string, _whole int, _epochs double, _left long, _bits int"
    share = F.broadcast if len(sizes) <= BROADCAST_SOURCES else (lambda x: x)

    # where each source's last epoch ends: its block by the blocks' totals, then the document in it
    drawn = lean.join(share(spark.createDataFrame(known, schema)), "_source").where("_left > 0")
    drawn = drawn.withColumn("_block", _block(F.col("_bits"), seed)).withColumn("_rank", _rank(F.col("_whole"), seed)).withColumn("_draw", _draw(F.col("_whole"), seed))
    totals = drawn.groupBy("_source", "_rank").agg(F.sum("_tokens").alias("n"), F.first("_left").alias("_left"))
    before = totals.withColumn("before", F.sum("n").over(Window.partitionBy("_source").orderBy("_rank")) - F.col("n"))
    last = before.where("before <= _left AND before + n > _left").groupBy("_source").agg(F.min(F.struct("_rank", "before")).alias("at")).select("_source", F.col("at._rank").alias("_rank"), "at.before")
    inside = drawn.join(share(last), ["_source", "_rank"])
    reach = inside.groupBy("_source", "_rank", "_draw").agg(F.sum("_tokens").alias("n"), F.first("_left").alias("_left"), F.first("before").alias("before"))
    reach = reach.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("_source").orderBy("_draw")))
    over = reach.where("upto > _left").groupBy("_source").agg(F.min(F.struct("_rank", "_draw")).alias("cut")).select("_source", "cut.*")
    cuts = {r["_source"]: (r["_rank"], r["_draw"]) for r in over.collect()}  # a row for each source
    # a source without a cut uses its last epoch up to what fits: all of it
    ends = [(*k, *(cuts.get(k[0], (1 << MOST_BITS, 0)) if k[3] > 0 else (0, 0))) for k in known]

    used = held.join(share(spark.createDataFrame(ends, schema + ", _cut long, _cut_draw long")), "_source").withColumn("_block", _block(F.col("_bits"), seed))
    rank, draw = _rank(F.col("_whole"), seed), _draw(F.col("_whole"), seed)
    extra = F.when((rank < F.col("_cut")) | ((rank == F.col("_cut")) & (draw < F.col("_cut_draw"))), 1).otherwise(0)
    used = used.withColumn("_uses", F.col("_whole") + extra)
    used = used.where("_uses > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_uses") - 1)))
    used = used.withColumn("_rank", _rank(F.col("_epoch"), seed)).withColumn("_draw", _draw(F.col("_epoch"), seed))
    within = (F.col("_rank") + F.col("_draw") / SPAN) / _power(F.col("_bits"))
    place = (F.col("_epoch") + within) / F.greatest("_epochs", F.lit(1.0))
    result = F.struct(F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"), F.col("_rank").alias("block"), F.least(F.floor(place * slots), F.lit(slots - 1)).cast("int").alias("slot"), F.col("_draw").alias("draw"))
    return used.select(*[F.col("_row").getField(c).alias(c) for c in given], result.alias(name))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("_mix.tokens").alias("n_tokens"), "_mix.epoch", "_mix.block", "_mix.slot", "_mix.draw")
