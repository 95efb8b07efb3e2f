"""Filling fixed-capacity containers with items (problem 6).

Method: best-two-fit. A bin is filled greedily with the largest item that fits; then its smallest item is replaced by
two unpacked ones that fill the gap it leaves more tightly. Items are packed as counts by size, all of a container at
once: a bin that comes out is repeated as long as the counts last, so the work follows the number of sizes, not that of
items. The items then take the places of their size by rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.tokens import DEFAULT_VOCABULARY, with_token_counts
from cardloom.runtime import materialize

#: Ranges of a hash by which items are ranked, so that a size many items share is no single group.
PARTS = 1024


class Stock:
    """Sizes still to pack, with counts."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, [0] * (capacity + 1)
        self.mask = self.mirror = 0
        for s, n in counts.items():
            if n > 0:
                self.count[s] = n
                self.mask |= 1 << s
                self.mirror |= 1 << (capacity - s)

    def largest(self, most: int) -> int:
        """The largest size up to `most`; 0 if there is none."""
        return (self.mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.mask & ((2 << most) - 1) else 0

    def take(self, size: int, n: int = 1) -> None:
        self.count[size] -= n
        if not self.count[size]:
            self.mask ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)

    def put(self, size: int) -> None:
        if not self.count[size]:
            self.mask |= 1 << size
            self.mirror |= 1 << (self.capacity - size)
        self.count[size] += 1

    def pair(self, most: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes whose sum is the largest up to `most`, if it is more than `more_than`."""
        for total in range(most, more_than, -1):
            both = self.mask & (self.mirror >> (self.capacity - total))
            if not total % 2 and both >> (total // 2) & 1 and self.count[total // 2] < 2:
                both ^= 1 << (total // 2)
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None


def pack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins as (sizes, how often). counts: items by size, sizes from 1 to capacity.

    There are at most capacity * (1 + ln capacity) different bins: each ends because one size can't be taken as often
    again, and a size is taken at most capacity / size times.
    """
    stock, bins = Stock(counts, capacity), []
    while stock.mask:
        here, free, back = [], capacity, 0
        while (s := stock.largest(free)) > 0:
            stock.take(s)
            here.append(s)
            free -= s
        if free and len(here) > 0:
            smallest = min(here)
            better = stock.pair(free + smallest, smallest)
            if better:
                here.remove(smallest)
                for s in better:
                    stock.take(s)
                    here.append(s)
                stock.put(smallest)
                back = smallest
        own = Counter(here)
        # a size that was put back must be there once more while the bin is made again
        again = min(max(0, (stock.count[s] - n - (s == back)) // n + 1) for s, n in own.items())
        if again:
            for s, n in own.items():
                stock.take(s, n * again)
        bins.append((here, again + 1))
    return bins


def _places(f: pd.DataFrame) -> pd.DataFrame:
    """Where the items of each size go: container, size, first (rank), bin (of that rank), each (items of it a bin)."""
    cap = int(f["cap"].iloc[0])
    done, base, rows = Counter(), 0, []
    for here, times in pack(dict(zip(f["size"].tolist(), f["n"].tolist())), cap):
        for s, n in Counter(here).items():
            rows.append((s, done[s], base, n))
            done[s] += n * times
        base += times
    out = pd.DataFrame(rows, columns=["size", "first", "bin", "each"]).astype("int64")
    out.insert(0, "container", f["container"].iloc[0])
    return out


def fill_containers(docs: DataFrame, containers: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Bins of each container: container, bin, doc_id, piece, start_token, n_tokens.

    docs: doc_id, text; containers: container, capacity_tokens (positive). A text longer than the capacity is cut into
    full pieces, each a bin of its own (with a negative number), and a rest that is packed like a text; no other text is
    cut. A null or empty text takes no room and has no row; equal sizes go in the order of a hash of doc_id. An empty
    table gives no bins.
    """
    spark = docs.sparkSession
    sized = materialize(with_token_counts(docs, vocabulary=vocabulary, keep=("doc_id",)).where("n_tokens > 0"))
    kinds = F.broadcast(containers.select("container", F.col("capacity_tokens").cast("long").alias("cap")).where("cap > 0").distinct())
    # a few kinds of container, each for all texts
    items = sized.join(kinds).withColumn("size", F.col("n_tokens") % F.col("cap")).withColumn("full", F.floor(F.col("n_tokens") / F.col("cap")))
    counts = items.where("size > 0").groupBy("container", "cap", "size").agg(F.count("*").alias("n"))
    # a group is the counts by size of one container, as many as its capacity at most
    found = counts.groupBy("container", "cap").applyInPandas(_places, "container string, size long, first long, bin long, each long")
    by_size: dict[tuple[str, int], list] = {}
    for r in found.collect():  # bounded by the capacities, see pack
        by_size.setdefault((r["container"], r["size"]), []).append((r["first"], r["bin"], r["each"]))
    places = spark.sparkContext.broadcast({k: np.array(sorted(v), dtype=np.int64) for k, v in by_size.items()})

    # the rank within a size, and of full pieces within a container, by ranges of a hash
    keyed = items.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    sums = keyed.groupBy("container", "size", "part").agg(F.count("*").alias("n_part"), F.sum("full").alias("full_part"))
    above = Window.partitionBy("container", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_size = sums.groupBy("container", "size").agg(F.sum("full_part").alias("full_size"))
    over = Window.partitionBy("container").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)  # a row a size
    per_size = per_size.select("container", "size", F.coalesce(F.sum("full_size").over(over), F.lit(0)).alias("full_above"))
    before = sums.withColumns({k: F.coalesce(F.sum(v).over(above), F.lit(0)) for k, v in (("rank_before", "n_part"), ("full_before", "full_part"))})
    before = before.join(per_size, ["container", "size"]).select("container", "size", "part", "rank_before", (F.col("full_before") + F.col("full_above")).alias("full_before"))
    own = Window.partitionBy("container", "size", "part").orderBy("h", "doc_id")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).withColumn("own_full", F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    ranked = ranked.join(before, ["container", "size", "part"]).select(
        "container", "cap", "doc_id", "size", "full", (F.col("rank_before") + F.col("own")).alias("rank"), (F.col("full_before") + F.col("own_full")).alias("full_rank")
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f), dtype=np.int64)
            for key, i in f.reset_index(drop=True).groupby(["container", "size"]).indices.items():
                if key[1] > 0:
                    t, rank = places.value[key], f["rank"].to_numpy()[i]
                    at = np.searchsorted(t[:, 0], rank, side="right") - 1
                    out[i] = t[at, 1] + (rank - t[at, 0]) // t[at, 2]
            yield f.assign(bin=out)[["container", "bin", "doc_id", "cap", "size", "full", "full_rank"]]

    placed = ranked.mapInPandas(place, "container string, bin long, doc_id long, cap long, size long, full long, full_rank long")
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda k: F.struct((-1 - F.col("full_rank") - k).alias("bin"), k.alias("piece"), F.col("cap").alias("n_tokens"))))
    rest = F.when(F.col("size") > 0, F.array(F.struct("bin", F.col("full").alias("piece"), F.col("size").alias("n_tokens"))))
    none = F.array().cast("array<struct<bin:bigint,piece:bigint,n_tokens:bigint>>")
    pieces = placed.select("container", "cap", "doc_id", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(rest, none))).alias("x"))
    return pieces.select("container", "x.bin", "doc_id", F.col("x.piece").cast("int").alias("piece"), (F.col("x.piece") * F.col("cap")).alias("start_token"), "x.n_tokens")


def fill_checks(bins: DataFrame, docs: DataFrame, containers: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """container, n_docs (texts with tokens), and how many bins are too full, texts cut without need or not covered by their pieces."""
    sized = with_token_counts(docs, vocabulary=vocabulary, keep=("doc_id",)).where("n_tokens > 0").withColumnRenamed("n_tokens", "whole")
    caps = F.broadcast(containers.select("container", F.col("capacity_tokens").alias("cap")).where("cap > 0").distinct())
    w = Window.partitionBy("container", "doc_id").orderBy("start_token")
    pieces = bins.withColumn("gap", F.col("start_token") != F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(w), F.lit(0)))
    per = pieces.groupBy("container", "doc_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("got"), F.bool_or("gap").alias("gap"))
    both = sized.join(caps).join(per, ["container", "doc_id"], "full")
    broken = ~((F.col("got") == F.col("whole")) & ~F.col("gap"))
    per_doc = both.groupBy("container").agg(
        F.count("*").alias("n_docs"), F.count_if((F.col("n_pieces") > 1) & (F.col("whole") <= F.col("cap"))).alias("needless_cuts"), F.count_if(F.coalesce(broken, F.lit(True))).alias("not_covered")
    )
    per_bin = bins.groupBy("container", "bin").agg(F.sum("n_tokens").alias("used")).join(caps, "container").groupBy("container").agg(F.count_if(F.col("used") > F.col("cap")).alias("too_full"))
    return per_doc.join(per_bin, "container")


def fill_report(bins: DataFrame, containers: DataFrame) -> DataFrame:
    """container, capacity_tokens, n_bins, n_tokens, fill (share of the room that is used)."""
    used = bins.groupBy("container").agg(F.count_distinct("bin").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    both = containers.select("container", "capacity_tokens").join(used, "container")
    return both.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6))
