"""Labelled character spans: scores, overlaps, masks, borders and texts.

A span is (card, label, start_pos, end_pos), 0-based and half-open over code points. A null border or an end before the
start makes a span empty; repeated rows count once where spans are read by `tidy`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy(spans: DataFrame) -> DataFrame:
    """Spans once each, with one spelling of every label (spaces and underscores alike) and borders in order."""
    lo, hi = F.least("start_pos", "end_pos"), F.greatest("start_pos", "end_pos")
    kept = spans.where("card is not null and label is not null and start_pos is not null and end_pos is not null")
    return kept.select("card", F.replace(F.col("label"), F.lit(" "), F.lit("_")).alias("label"), lo.alias("start_pos"), hi.alias("end_pos")).distinct()


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def hull(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """From the first start to the last end, the gap between disjoint spans included."""
    return F.greatest(e1, e2) - F.least(s1, s2)


def shifted(spans: DataFrame, by: Column) -> DataFrame:
    return spans.withColumns({"start_pos": F.col("start_pos") + by, "end_pos": F.col("end_pos") + by})


def interval_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """card, label, a_start, a_end, b_start, b_end, inter, hull of spans of one card and label that overlap."""
    x = a.select("card", "label", F.col("start_pos").alias("a_start"), F.col("end_pos").alias("a_end"))
    y = b.select("card", "label", F.col("start_pos").alias("b_start"), F.col("end_pos").alias("b_end"))
    both = x.join(y, ["card", "label"]).where("a_start < b_end and b_start < a_end")
    args = [F.col(c) for c in ("a_start", "a_end", "b_start", "b_end")]
    return both.withColumn("inter", intersection(*args)).withColumn("hull", hull(*args))


def iou_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of every span of `a` the best one of `b` by intersection over hull; the first start wins a tie. A span that
    overlaps none has no row."""
    pairs = interval_pairs(a, b).withColumn("iou", F.col("inter") / F.col("hull"))
    rank = F.struct(F.col("iou"), (-F.col("b_start")).alias("s"), (-F.col("b_end")).alias("e"))
    best = pairs.groupBy("card", "label", "a_start", "a_end").agg(F.max_by(F.struct("b_start", "b_end", "inter", "hull", "iou"), rank).alias("m"))
    return best.select("card", "label", "a_start", "a_end", "m.b_start", "m.b_end", "m.inter", "m.hull", F.round("m.iou", 6).alias("iou"))


def iou_totals(matched: DataFrame) -> DataFrame:
    """Sums of intersection and hull over all, by label, by card, and by both: card and label are null where summed."""
    sets = matched.groupingSets([["card", "label"], ["card"], ["label"], []], "card", "label")
    return sets.agg(F.sum("inter").alias("inter"), F.sum("hull").alias("hull"), F.grouping_id().cast("int").alias("level"))


def label_error(totals: DataFrame) -> DataFrame:
    """label, error = 1 - intersection / hull, of the sums by label; -1 where the hull is nothing, null over all."""
    rows = totals.where("level in (2, 3)")
    error = F.when(F.coalesce(F.col("hull"), F.lit(0)) > 0, F.round(1 - F.col("inter") / F.col("hull"), 6)).otherwise(F.when(F.col("level") == 2, F.lit(-1.0)))
    return rows.select(F.coalesce("label", F.lit("total")).alias("label"), error.alias("error"))


def overlap_pairs(spans: DataFrame) -> DataFrame:
    """Pairs of differently placed or labelled spans of a card that overlap, each once: kind 'inside' or 'partial'."""
    key = lambda s: F.struct(F.col(f"{s}_start"), F.col(f"{s}_end"), F.col(f"{s}_label"))
    x = spans.select("card", *[F.col(c).alias(f"a_{c.split('_')[0]}") for c in ("label", "start_pos", "end_pos")])
    y = spans.select("card", *[F.col(c).alias(f"b_{c.split('_')[0]}") for c in ("label", "start_pos", "end_pos")])
    both = x.join(y, "card").where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (key("a") < key("b")))
    inside = ((F.col("a_start") <= F.col("b_start")) & (F.col("b_end") <= F.col("a_end"))) | ((F.col("b_start") <= F.col("a_start")) & (F.col("a_end") <= F.col("b_end")))
    return both.withColumn("kind", F.when(inside, "inside").otherwise("partial"))


def merge_adjacent_spans(spans: DataFrame, gap: int = 1) -> DataFrame:
    """Spans of a card and label whose end and next start are exactly `gap` apart, as one."""
    w = Window.partitionBy("card", "label").orderBy("start_pos", "end_pos")
    fresh = F.when(F.lag("end_pos").over(w) + gap == F.col("start_pos"), 0).otherwise(1)
    island = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("_f", fresh).withColumn("_i", island).groupBy("card", "label", "_i")
    return merged.agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n_spans")).drop("_i")


def char_mask(spans: DataFrame) -> DataFrame:
    """card, pos, label of every covered character; where spans overlap the one that starts later holds, then the one
    that ends later, then the larger label."""
    chars = spans.where("end_pos > start_pos").select("card", "label", "start_pos", "end_pos", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"))
    return chars.groupBy("card", "pos").agg(F.max_by("label", F.struct("start_pos", "end_pos", "label")).alias("label"))


def masked_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """label, inter, union, error by characters: equal labels count for both, unequal ones for the union of a's label, or
    of b's where a has none."""
    x, y = char_mask(a).withColumnRenamed("label", "la"), char_mask(b).withColumnRenamed("label", "lb")
    both = x.join(y, ["card", "pos"], "full")
    by = both.groupBy(F.coalesce("la", "lb").alias("label")).agg(F.count_if(F.col("la").eqNullSafe(F.col("lb"))).alias("inter"), F.count("*").alias("union"))
    return by.withColumn("error", F.round(1 - F.col("inter") / F.col("union"), 6))


def space_positions(text: Column, at: str = " ") -> Column:
    """Positions of a character in a text; an empty array for an empty text."""
    every = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: F.substring(text, i + 1, 1) == at)


def refine_border(left: Column, right: Column, spaces: Column) -> Column:
    """A border between left and right, moved to a space: the middle one of those inside, else the nearer one outside
    (the right one on a tie), else the middle."""
    inside = F.filter(spaces, lambda s: (s >= left) & (s <= right))
    before, after = F.array_max(F.filter(spaces, lambda s: s < left)), F.array_min(F.filter(spaces, lambda s: s > right))
    nearer = F.when(before.isNull(), after).when(after.isNull(), before).when(left - before < after - right, before).otherwise(after)
    middle = F.get(inside, F.floor(F.size(inside) / 2).cast("int"))
    return F.when(F.size(inside) > 0, middle).otherwise(F.coalesce(nearer, F.floor((left + right) / 2).cast("int")))


def span_text(spans: DataFrame, cards: DataFrame) -> DataFrame:
    """card, label, text: the spans' texts without white space at the ends, joined by spaces in order of start."""
    texts = cards.select("card", "transcription").where("transcription is not null").distinct()
    cut = F.trim(F.expr("substring(transcription, start_pos + 1, end_pos - start_pos)"))
    each = spans.join(texts, "card").select("card", "label", "start_pos", "end_pos", cut.alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "t"))), lambda x: x["t"]), " ")
    return each.groupBy("card", "label").agg(joined.alias("text"))


def dataset_lines(spans: DataFrame) -> DataFrame:
    """card, line: the card and, in order of start, 'label start end' of each span, all separated by tabs."""
    part = F.concat_ws(" ", "label", "start_pos", "end_pos")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "label", part.alias("p")))), lambda x: x["p"])
    return spans.groupBy("card").agg(F.concat_ws("\t", F.first("card"), F.array_join(parts, "\t")).alias("line"))


#: The sign of each label in a mask of characters; '0' is none.
MASK_SIGNS = {
    "Author": "1", "Title": "2", "Original title": "3", "Publisher": "4", "Pages": "5", "Series": "6", "Edition": "7", "References": "8",
    "ID": "9", "ISBN": "a", "ISSN": "b", "Topic": "c", "Subtitle": "d", "Date": "e", "Institute": "f", "Volume": "g",
}


def mask_signs(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """card, mask: a sign for every character of the card's text, as `char_mask` labels it; '0' where it has none."""
    signs = F.create_map(*[F.lit(x) for k, v in MASK_SIGNS.items() for x in (k.replace(" ", "_"), v)])
    marks = char_mask(spans).groupBy("card").agg(F.map_from_entries(F.collect_list(F.struct("pos", signs[F.col("label")].alias("sign")))).alias("m"))
    sized = texts.select("card", F.length("transcription").alias("n")).where("n > 0").distinct().join(marks, "card", "left")
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("0")))
    return sized.select("card", F.array_join(every, "").alias("mask"))


def unmasked(masks: DataFrame) -> DataFrame:
    """card, start_pos, end_pos, label of the runs of equal signs of a mask, 'O' for those without a label."""
    names = F.create_map(F.lit("0"), F.lit("O"), *[F.lit(x) for k, v in MASK_SIGNS.items() for x in (v, k.replace(" ", "_"))])
    chars = masks.select("card", F.posexplode(F.split("mask", "")).alias("pos", "sign")).where("sign != ''")
    w = Window.partitionBy("card").orderBy("pos")
    fresh = F.when(F.lag("sign").over(w) == F.col("sign"), 0).otherwise(1)
    island = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))
    by = chars.withColumn("_f", fresh).withColumn("_i", island).groupBy("card", "_i", "sign").agg(F.min("pos").alias("start_pos"), (F.max("pos") + 1).alias("end_pos"))
    return by.select("card", "start_pos", "end_pos", names[F.col("sign")].alias("label"))


def label_whitelist(spans: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Only the spans with one of the labels."""
    return spans.where(F.col("label").isin(*labels))


def training_filter(spans: DataFrame, least: int = 4, labels: tuple[str, ...] = ("Author", "ID", "Title")) -> DataFrame:
    """card, n_spans of the cards with at least `least` spans that have all of the labels."""
    per = spans.groupBy("card").agg(F.count("*").alias("n_spans"), F.count_distinct(F.when(F.col("label").isin(*labels), F.col("label"))).alias("_n"))
    return per.where((F.col("n_spans") >= least) & (F.col("_n") == len(set(labels)))).select("card", "n_spans")


def _refine(left: int, right: int, spaces: list[int]) -> int:
    inside = [s for s in spaces if left <= s <= right]
    if inside:
        return inside[len(inside) // 2]
    before, after = [s for s in spaces if s < left], [s for s in spaces if s > right]
    if not before and not after:
        return (left + right) // 2
    if not before or (after and after[0] - right <= left - before[-1]):
        return after[0]
    return before[-1]


def drop_outer(spans: list[list], spaces: list[int]) -> list[list]:
    """Overlaps of [label, start, end] lists resolved in order: of two spans strictly one in the other the outer goes;
    partial ones meet at a space. Equal spans both stay."""
    alive = [True] * len(spans)
    out = [list(s) for s in spans]
    for i, a in enumerate(out):
        for j, b in enumerate(out):
            if not alive[i] or not alive[j] or a[0] == b[0] or not (a[1] < b[2] and b[1] < a[2]):
                continue
            if a[1] < b[1] and b[2] < a[2]:
                alive[i] = False
            elif b[1] < a[1] and a[2] < b[2]:
                alive[j] = False
            elif a[1] < b[1] < a[2]:
                a[2] = b[1] = _refine(b[1], a[2], spaces)
            elif b[1] < a[1] < b[2]:
                b[2] = a[1] = _refine(a[1], b[2], spaces)
    return [s for s, ok in zip(out, alive) if ok]


def drop_inner(spans: list[list]) -> list[list]:
    """Overlaps of [label, start, end] lists resolved by start: a span within an earlier one goes; partial ones meet in
    the middle, one character apart."""
    out: list[list] = []
    for s in sorted((list(x) for x in spans), key=lambda x: x[1]):
        if any(p[1] <= s[1] and s[2] <= p[2] for p in out):
            continue
        if out and s[1] < out[-1][2]:
            middle = (s[1] + out[-1][2]) // 2
            out[-1][2], s[1] = middle, middle + 1
        out.append(s)
    return out


def resolve_overlaps(spans: DataFrame, how: str = "inner", texts: DataFrame | None = None) -> DataFrame:
    """card, label, start_pos, end_pos without overlaps. how: 'inner' or 'outer', which of two nested spans goes.

    The order of processing is start, end, label. The spans of one card are resolved together; texts (card,
    transcription) tells 'outer' where spaces are.
    """
    rows = spans.groupBy("card").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "label"))).alias("s"))
    if texts is not None:
        rows = rows.join(texts.select("card", "transcription").where("transcription is not null").distinct(), "card", "left")
    else:
        rows = rows.withColumn("transcription", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for card, s, t in zip(f["card"], f["s"], f["transcription"]):
                own = [[x["label"], x["start_pos"], x["end_pos"]] for x in s]
                gaps = [i for i, ch in enumerate(t) if ch == " "] if isinstance(t, str) else []
                done = drop_inner(own) if how == "inner" else drop_outer(own, gaps)
                out += [(card, *x) for x in done if x[2] > x[1]]
            yield pd.DataFrame(out, columns=["card", "label", "start_pos", "end_pos"])

    return rows.mapInPandas(run, "card string, label string, start_pos int, end_pos int")
