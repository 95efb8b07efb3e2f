"""Mixing sources to target weights (problem 7).

Method: subset-sum budget fitting. Documents are counted by exact token length; a source gives whole passes over its
documents and, for what is then left of its budget, a bounded knapsack over the counts finds how many documents of each
length make up the rest; those are drawn by a seeded hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from cardloom.runtime import materialize


def _sums(lengths: list[int], counts: list[int], most: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The sums up to `most` that can be made, as a bit set, and the steps to them: length number, how many, what was before."""
    reach, steps, full = 1, [], (2 << most) - 1
    for i, (n, c) in enumerate(zip(lengths, counts)):
        spare, size = min(c, most // n), 1
        while spare > 0:  # counts as powers of two
            k = min(size, spare)
            steps.append((i, k, reach))
            reach = (reach | reach << (k * n)) & full
            spare, size = spare - k, size * 2
    return reach, steps


def _taken(lengths: list[int], steps: list[tuple[int, int, int]], at: int) -> list[int]:
    """How many of each length make the sum `at`."""
    out = [0] * len(lengths)
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            out[i] += k
            at -= k * lengths[i]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length give the largest sum up to the budget, each at most as often as counted.

    An even share of every length is taken first; then sums of lengths that may go and sums of lengths that may come in
    are found as bit sets, within a reach that is doubled until the budget is met exactly. If it never is, the search
    goes on from the longest lengths down: a best choice differs from that one by 2 * longest + 1 items at most (the
    proximity of an integer program to a corner of its relaxation), so with that reach the sum is the largest there is.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    unit = math.gcd(*(n for n, c in zip(lengths, counts) if c > 0))
    lengths, budget, total = [max(1, n // unit) for n in lengths], budget // unit, total // unit
    longest = max(n for n, c in zip(lengths, counts) if c > 0)
    even = [c * budget // total for c in counts]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = budget - sum(n * k for n, k in zip(lengths, even))
    while left > 2 * longest:  # the rounding of the shares, a document a length and round
        for i in order:
            if left > 2 * longest and even[i] < counts[i]:
                even[i] += 1
                left -= lengths[i]
    corner, left = [0] * len(lengths), budget
    for i in order:
        corner[i] = min(counts[i], left // lengths[i])
        left -= lengths[i] * corner[i]
    for base, bound in ((even, 16 * longest), (corner, (2 * longest + 1) * longest)):
        left = budget - sum(n * k for n, k in zip(lengths, base))
        reach = min(bound, 2 * longest)
        while True:
            come, way_in = _sums(lengths, [c - k for c, k in zip(counts, base)], left + reach)
            go, way_out = _sums(lengths, base, reach)
            # the least gap for which a sum that comes in is what goes plus what is left without the gap
            gap = next(g for g in range(left + 1) if come & (go << (left - g)))
            if gap == 0 or reach >= bound:
                break
            reach = min(bound, 2 * reach)
        both = come & (go << (left - gap))
        at = both.bit_length() - 1
        best = [k + a - b for k, a, b in zip(base, _taken(lengths, way_in, at), _taken(lengths, way_out, at - left + gap))]
        if gap == 0:
            break
    return best


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The documents of the mix: source, doc_id, n_tokens, copies.

    docs: doc_id, source, text; targets: source, target_share, max_repeats (a row a source). total_tokens: size of the
    mix; unset, the largest for which every source that has documents can hold its share. Beyond that a source gives
    what max_repeats allows. Shares of sources without documents are spread over the others in proportion. Documents
    of no target, or without tokens, aren't drawn; a null source is no target.
    """
    wanted = F.broadcast(targets.select("source", "target_share", "max_repeats"))  # a few rows, fixed
    sized = materialize(with_token_counts(docs.join(wanted.select("source"), "source", "left_semi"), vocabulary=vocabulary, keep=("doc_id", "source")).where("n_tokens > 0"))
    counts = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    have = counts.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("have"))
    one = Window.partitionBy(F.lit(0))  # over the sources, a few rows
    plan = have.join(wanted, "source").where("target_share > 0").withColumn("share", F.col("target_share") / F.sum("target_share").over(one))
    plan = plan.withColumn("room", F.col("have") * F.col("max_repeats"))
    size = F.lit(total_tokens).cast("double") if total_tokens else F.min(F.col("room") / F.col("share")).over(one)
    plan = plan.withColumn("budget", F.least(F.col("room"), F.floor(F.col("share") * size + 1e-6)).cast("long"))
    plan = plan.withColumn("passes", F.least(F.floor(F.col("budget") / F.col("have")), F.col("max_repeats")).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("passes") * F.col("have"))

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("n_tokens")
        take = knapsack(f["n_tokens"].tolist(), f["n"].tolist(), int(f["rest"].iloc[0]))
        return f.assign(take=take)[["source", "n_tokens", "n", "passes", "take"]]

    # a group is the counts by length of a source, not its documents
    fitted = counts.join(F.broadcast(plan.select("source", "passes", "rest")), "source").groupBy("source")
    chosen = fitted.applyInPandas(fit, "source string, n_tokens long, n long, passes long, take long").where("passes > 0 or take > 0")

    # rank within a length by a seeded hash, by way of 256 ranges of it, so that a length many documents share is split
    keyed = sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.shiftrightunsigned("h", 56).cast("int"))
    parts = keyed.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n_part"))
    w = Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("n_part").over(w), F.lit(0))).drop("n_part")
    drawn = keyed.join(chosen, ["source", "n_tokens"]).join(before, ["source", "n_tokens", "part"])
    own = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("h", "doc_id"))
    copies = F.col("passes") + F.when(F.col("before") + own <= F.col("take"), 1).otherwise(0)
    return drawn.withColumn("copies", copies.cast("int")).where("copies > 0").select("source", "doc_id", "n_tokens", "copies")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, n_docs, n_tokens, actual_share of every target, those without documents included."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    both = targets.select("source", "target_share").join(got, "source", "left").fillna(0, ["n_docs", "n_tokens"])
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # over the targets, a few rows
    return both.withColumn("actual_share", F.when(total > 0, F.round(F.col("n_tokens") / total, 6)).otherwise(0.0))


def mix_checks(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Of every target: source, n_docs (with a text), n_twice (documents with two rows), n_over (more copies than allowed),
    n_foreign (documents of another source), is_near: its share is within a hundredth of the wanted one, shares of sources without
    documents spread over the others."""
    own = docs.select("doc_id", F.col("source").alias("of")).where("text != ''")
    wanted = F.broadcast(targets.select("source", "target_share", "max_repeats"))
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n_rows"), F.max("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"))
    seen = per_doc.join(own, "doc_id", "left").join(wanted, "source")
    per = seen.groupBy("source").agg(
        F.count_if(F.col("n_rows") > 1).alias("n_twice"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over"), F.count_if(~F.col("of").eqNullSafe(F.col("source"))).alias("n_foreign"), F.sum("n_tokens").alias("n_tokens")
    )
    have = own.groupBy(F.col("of").alias("source")).agg(F.count("*").alias("n_docs"))
    every = Window.partitionBy(F.lit(0))  # over the targets, a few rows
    both = targets.select("source", "target_share").join(have, "source", "left").join(per, "source", "left").fillna(0)
    share = F.when(F.col("n_docs") > 0, F.col("target_share")).otherwise(0.0)
    near = F.abs(F.col("n_tokens") / F.sum("n_tokens").over(every) - share / F.sum(share).over(every)) < 0.01
    return both.select("source", "n_docs", "n_twice", "n_over", "n_foreign", near.alias("is_near"))
