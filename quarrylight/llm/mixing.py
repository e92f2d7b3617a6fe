"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its share of the tokens to the power tau. The exponent is bisected to the smallest one that keeps
the number of epochs of every source within a repetition limit (and, if asked for, the entropy of the weights at or
below a target). The budget is the least at which every source is read in full: epochs = (largest share / share) to the
power (1 - tau). Each epoch of a source is a seeded permutation of its documents, dealt in blocks so that no task holds a
whole source; the last epoch stops where the source's token budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, need, without

#: Levels of the bisection that one job settles, and jobs.
LEVELS, ROUNDS = 5, 8


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    """src, docs, tokens and share of every source that has tokens; docs: __src, __tokens, best a written table, as it is read twice."""
    by = docs.groupBy("__src").agg(F.count(F.lit(1)).alias("docs"), F.sum("__tokens").alias("tokens")).filter("tokens > 0")
    total = by.agg(F.sum("tokens").alias("total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("total"))


def bisect_exponent(shares: DataFrame, max_repeat: float | None, target_entropy: float | None) -> float:
    """The least exponent in [0, 1] that meets the limits; 1 if none does. One job settles LEVELS halvings.

    The result of each job is one number, however many sources there are.
    """
    top = shares.agg(F.max("share").alias("top"))
    lo, hi = 0.0, 1.0
    for k in range(ROUNDS):
        n = 2**LEVELS
        taus = [lo + (hi - lo) * i / n for i in range(0 if k == 0 else 1, n)]
        at = shares.crossJoin(F.broadcast(top)).withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
        at = at.withColumn("p", F.pow("share", F.col("tau")))
        at = at.groupBy("tau").agg(
            F.max(F.pow(F.col("top") / F.col("share"), 1 - F.col("tau"))).alias("repeat"),
            F.sum("p").alias("z"),
            F.sum(F.col("p") * F.ln("p")).alias("plnp"),
        )
        fits = F.lit(True)
        if max_repeat is not None:
            fits &= F.col("repeat") <= max_repeat
        if target_entropy is not None:
            fits &= F.ln("z") - F.col("plnp") / F.col("z") <= target_entropy
        least = at.filter(fits).agg(F.min("tau").alias("tau")).first()["tau"]
        if k == 0 and least == 0.0:
            return 0.0
        if least is None:
            lo = taus[-1]
        else:
            lo, hi = max(lo, least - (hi - lo) / n), least
    return hi


def mix_sources(
    docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, seed: int = 17, block_docs: int = 2048
) -> DataFrame:
    """One row for each time a document is read, with its place in the mixture.

    docs: doc_id, text, source and any other columns, which are carried along (but for n_tokens, epoch, block,
    tokens_before, epochs, weight and position, which are computed). Tokens are words between white space. A null source is a
    source of its own. A document without tokens, and every document of a source without tokens, is read once an epoch and counts for nothing.
    Repeated rows are read each on its own; ties in a permutation fall to doc_id and then the row's hash. A null doc_id
    sorts as an empty string. An empty table gives an empty result. Every document is read at least once.
    """
    need(docs, "doc_id", "text", "source")
    scratch = Scratch(docs.sparkSession, "mixing")
    made = ("n_tokens", "epoch", "block", "tokens_before", "epochs", "weight", "position")
    rows = without(docs, *made).withColumns({
        "__tokens": word_count(F.col("text")),
        "__src": F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "source")),
        "__row": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c in ("doc_id", "text", "source")]),
    })
    # shares and block sums need no texts: their words are counted once for both, and once more for the rows themselves
    counts = scratch.keep(rows.select("doc_id", "__src", "__tokens"), "counts")
    shares = scratch.keep(source_shares(counts), "shares")
    size = shares.agg(F.max("docs").alias("docs")).first()["docs"] or 0
    tau = bisect_exponent(shares, max_repeat, target_entropy)
    blocks = 2 ** max(0, math.ceil(math.log2(max(1.0, size / block_docs))))
    norm = shares.agg(F.max("share").alias("top"), F.sum(F.pow("share", F.lit(tau))).alias("z"))
    plan = shares.crossJoin(F.broadcast(norm)).select(
        "__src", "tokens",
        F.pow(F.col("top") / F.col("share"), F.lit(1.0 - tau)).alias("epochs"),
        (F.pow("share", F.lit(tau)) / F.col("z")).alias("weight"),
    ).withColumns({"__full": F.floor("epochs"), "__rest": F.floor((F.col("epochs") - F.floor("epochs")) * F.col("tokens") + F.lit(1e-6))})
    plan = scratch.keep(plan.withColumnRenamed("tokens", "__all"), "plan")

    def read(x: DataFrame) -> DataFrame:
        """Each row once an epoch, with its block there."""
        x = x.join(plan, "__src", "left").withColumns({
            "epochs": F.coalesce("epochs", F.lit(1.0)), "weight": F.coalesce("weight", F.lit(0.0)),
            "__full": F.coalesce("__full", F.lit(1)), "__rest": F.coalesce("__rest", F.lit(0)), "__all": F.coalesce("__all", F.lit(0)),
        })
        x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - F.when(F.col("__rest") > 0, 0).otherwise(1))))
        x = x.withColumn("__key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
        return x.withColumn("block", (F.conv(F.substring("__key", 1, 7), 16, 10).cast("long") * blocks / F.lit(16**7)).cast("long"))

    rows = read(rows)
    sums = read(counts).groupBy("__src", "epoch", "block").agg(F.sum("__tokens").alias("__sum"))
    w = Window.partitionBy("__src", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__src", "epoch", "block", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__src", "epoch", "block").orderBy("__key", "doc_id", "__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__tokens").over(inside), F.lit(0))).join(sums, ["__src", "epoch", "block"])
    rows = rows.withColumn("tokens_before", F.col("__base") + F.col("__in"))
    rows = rows.filter((F.col("epoch") < F.col("__full")) | (F.col("tokens_before") < F.col("__rest")))
    budget = F.col("__full") * F.col("__all") + F.col("__rest")
    place = F.when(budget > 0, (F.col("epoch") * F.col("__all") + F.col("tokens_before")) / budget).otherwise(F.lit(0.0))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made], F.col("__tokens").alias("n_tokens"), "epoch", "block", "tokens_before", "epochs", "weight", place.alias("position"))
