"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares p of the sources are raised to an exponent a and normalised. The
exponent is bisected: it is the largest in [0, 1] whose weights reach the target
entropy (a share of the most possible), or, if more, the least at which no
source is repeated more than ``max_epochs`` times. The budget is a number of
tokens, by default all tokens; with ``cover`` it is the least budget that uses
every document at least once.

A source gets weight x budget tokens: whole epochs over all its documents, then
a part of one more. Documents are dealt by hash into blocks of about
``block_tokens``; each epoch permutes the blocks and the documents inside them
by keyed hashes, and the last epoch stops where its tokens are used up. It never
exceeds them. Running sums are taken inside blocks and over block totals, so no
source has to fit in a task.

The exponent depends on the sizes of the sources only, so sources of one size are
counted together before they meet in one row. There are fewer such sizes than
the square root of twice the tokens, whatever the number of sources: 14 million at 10**14
tokens. The plan has a row per source and is joined; Spark broadcasts it
if it is small when written.

Defined cases: a null or empty text has no tokens; a source without tokens gets
weight 0 and its rows appear once; null is a source; repeated rows are rows of
their own; columns of the input are kept, whatever their names, and ``tokens, epoch,
start`` (and ``exponent``, where asked for) replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.llm.shards import seeded_hash
from chatterloom.session import written

STEPS = 60


def estimated_tokens(text: str) -> Column:
    """Four characters a token, rounded up."""
    return F.expr(f"coalesce((char_length({text}) + 3) div 4, 0)")


def weights(
    sources: DataFrame,
    *,
    entropy: float | None = None,
    max_epochs: float | None = None,
    budget: int | None = None,
    cover: bool = False,
) -> DataFrame:
    """``_none, _s, _t, weight, exponent, budget`` for sources with ``_t`` tokens."""
    sizes = sources.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.array_sort(F.collect_list(F.struct("_t", "_n"))).alias("all"))
    row = row.withColumn("total", F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["_t"] * x["_n"]))
    some = F.filter("all", lambda x: x["_t"] > 0)
    row = row.withColumn("many", F.aggregate(some, F.lit(0).cast("bigint"), lambda s, x: s + x["_n"]))
    row = row.withColumn("shares", F.transform(some, lambda x: F.struct((x["_t"].cast("double") / F.col("total")).alias("p"), x["_n"].alias("n"))))
    row = row.withColumn("p", F.col("shares.p"))
    zero = F.lit(0.0)
    most = F.array_max("p")

    def norm(a: Column) -> Column:
        return F.aggregate("shares", zero, lambda s, x: s + x["n"] * F.pow(x["p"], a))

    def reaches(a: Column) -> Column:
        """Does exponent ``a`` reach the entropy?"""
        parts = F.aggregate(
            "shares",
            F.struct(zero.alias("z"), zero.alias("d")),
            lambda s, x: F.struct(
                (s["z"] + x["n"] * F.pow(x["p"], a)).alias("z"), (s["d"] + x["n"] * F.pow(x["p"], a) * F.ln(x["p"])).alias("d")
            ),
            lambda s: F.ln(s["z"]) - a * s["d"] / s["z"],
        )
        return parts >= F.lit(entropy) * F.ln(F.col("many").cast("double"))

    def repeats_too_much(a: Column) -> Column:
        least = F.array_min("p")  # below exponent 1 the smallest source is repeated most
        per_token = F.pow(most, F.lit(1.0) - a) if cover else F.lit(1.0 if budget is None else float(budget)) / (
            norm(a) * (F.lit(1.0) if budget is None else F.col("total").cast("double"))
        )
        return F.pow(least, a - F.lit(1.0)) * per_token > F.lit(max_epochs)

    def bisected(goes_up) -> Column:
        """The point of [0, 1] up to which ``goes_up`` holds."""

        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            up = goes_up(mid)
            return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

        start = F.struct(zero.alias("lo"), F.lit(1.0).alias("hi"))
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
        return F.when(goes_up(F.lit(1.0)), F.lit(1.0)).otherwise(inner)

    row = row.withColumn("a_entropy", F.lit(1.0) if entropy is None else bisected(reaches))
    row = row.withColumn("a_epochs", zero if max_epochs is None else bisected(repeats_too_much))
    row = row.withColumn("exponent", F.greatest("a_entropy", "a_epochs"))
    row = row.withColumn("z", norm(F.col("exponent")))
    amount = F.col("total").cast("double") if budget is None else F.lit(float(budget))
    if cover:  # one epoch of the largest source
        amount = most * F.col("total") * F.col("z") / F.pow(most, F.col("exponent"))
    row = row.withColumn("amount", amount)
    facts = row.select(F.struct("exponent", "z", "total", "amount")).scalar()
    known = sources.withColumn("f", facts)
    share = F.pow(F.col("_t").cast("double") / F.col("f.total"), F.col("f.exponent")) / F.col("f.z")
    return known.withColumn("weight", F.when(F.col("_t") > 0, share).otherwise(zero)).select(
        "_none", "_s", "_t", "weight", "f.exponent", F.round(F.col("weight") * F.col("f.amount")).cast("bigint").alias("budget")
    )


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    tokens: Column | None = None,
    entropy: float | None = None,
    max_epochs: float | None = None,
    budget: int | None = None,
    cover: bool = False,
    block_tokens: int = 1 << 20,
    seed: str = "mix",
    with_exponent: bool = False,
) -> DataFrame:
    """``docs`` repeated to the mixture, with ``tokens, epoch, start`` (offset in the source's epoch)."""
    added = ["tokens", "epoch", "start", *(["exponent"] if with_exponent else [])]
    kept = [c for c in docs.columns if c not in added]
    tokens = estimated_tokens(f"`{text}`") if tokens is None else tokens
    # The input's columns travel in one struct, so that none of them meets a name used here.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), tokens.cast("bigint").alias("_tokens"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s"), F.col(source).isNull().alias("_none"),
        F.col(key).alias("_k"), F.xxhash64(text).alias("_x"),
    )
    sources = written(rows.groupBy("_none", "_s").agg(F.sum("_tokens").alias("_t")), "sources")
    plan = weights(sources, entropy=entropy, max_epochs=max_epochs, budget=budget, cover=cover).select(
        "_none", "_s", F.col("_t").alias("_all"), F.col("exponent").alias("_a"),
        F.expr(f"cast(ceil(_t / {block_tokens}) as bigint)").alias("_blocks"),
        F.expr("if(_t = 0, 1, budget div _t)").alias("_whole"),
        F.expr("if(_t = 0, 0, budget % _t)").alias("_part"),
    )
    plan = written(plan, "mixture")  # of known size, so that Spark knows whether to broadcast it
    block = F.pmod(seeded_hash(f"{seed}:block", F.col("_k")), F.greatest("_blocks", F.lit(1))).alias("_block")
    dealt = rows.join(plan, ["_none", "_s"]).withColumn("_block", block)
    totals = dealt.groupBy("_none", "_s", "_block").agg(F.sum("_tokens").alias("_bt"))
    epochs = F.expr("explode(sequence(0, _whole - if(_part > 0, 0, 1)))").alias("_epoch")
    some = F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0) > 0
    across = Window.partitionBy("_none", "_s", "_epoch").orderBy(
        seeded_hash(f"{seed}:order", F.col("_epoch"), F.col("_block")), "_block"
    )
    starts = (
        totals.join(plan, ["_none", "_s"]).filter(some).select("*", epochs)
        .withColumn("_from", F.sum("_bt").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_bt"))
        .withColumn("_limit", F.when(F.col("_epoch") < F.col("_whole"), F.col("_all")).otherwise(F.col("_part")))
        .filter("_from <= _limit")  # a block at the limit may hold rows without tokens
        .select("_none", "_s", "_epoch", "_block", "_from", "_limit", "_a")
    )
    inside = Window.partitionBy("_none", "_s", "_epoch", "_block").orderBy(
        seeded_hash(seed, F.col("_epoch"), F.col("_k")), "_k", "_tokens", "_x"
    )
    repeated = dealt.filter(some).select("_row", "_tokens", "_none", "_s", "_k", "_x", "_block", epochs)
    placed = repeated.join(starts, ["_none", "_s", "_epoch", "_block"]).withColumn(
        "_end", F.col("_from") + F.sum("_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    results = {"tokens": F.col("_tokens"), "epoch": F.col("_epoch"), "start": F.col("_end") - F.col("_tokens"), "exponent": F.col("_a")}
    return placed.filter("_end <= _limit").select(
        *[F.col("_row").getField(c).alias(c) for c in kept], *[results[c].alias(c) for c in added]
    )
