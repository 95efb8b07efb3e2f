"""Placing the fields of a record in the text of its card.

Two aligners. `align_cards`: every line goes to the field it is nearest to, the best ordered subset of a field's lines is
taken, trimmed to what matches and, if near enough, kept. `align_fuzzy`: every field is searched in the whole text within
a bounded distance. Positions are code points of the raw text throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.distance import align_substring, cer, infix_table
from cardloom.operators.spans import resolve_overlaps
from cardloom.runtime import materialize

#: A field with more lines than this gets none.
MAX_LINES = 5


def permutations_table(spark, n: int = MAX_LINES) -> DataFrame:
    """n, ord, perm: all ordered subsets of n lines for 1 to n, in the order smaller subsets first."""
    rows = []
    for size in range(1, n + 1):
        every = (p for k in range(1, size + 1) for c in itertools.combinations(range(size), k) for p in itertools.permutations(c))
        rows += [(size, i, list(p)) for i, p in enumerate(every)]
    return spark.createDataFrame(rows, "n int, ord int, perm array<int>")


def best_permutation(groups: DataFrame, text=lambda c: c) -> DataFrame:
    """card, label, perm, cer: of a group of up to MAX_LINES lines the ordered subset whose joined text is nearest to the
    field; the first in order wins a tie, and one with an error rate of 1 or more counts as none.

    groups: card, label, lines (array), ref. The table of permutations has 409 rows.
    """
    table = F.broadcast(permutations_table(groups.sparkSession))
    sized = groups.where(F.size("lines").between(1, MAX_LINES)).withColumn("n", F.size("lines"))
    joined = F.array_join(F.transform("perm", lambda i: F.get("lines", i)), " ")
    tried = sized.join(table, "n").withColumn("cer", cer(text(joined), text(F.col("ref"))))
    best = tried.groupBy("card", "label").agg(F.min(F.struct("cer", "ord", "perm")).alias("b"))
    return best.where("b.cer < 1").select("card", "label", F.col("b.perm").alias("perm"), F.round("b.cer", 6).alias("cer"))


def line_label_assign(pairs: DataFrame, lines: DataFrame, labels: DataFrame, text=lambda c: c) -> DataFrame:
    """card, line_no, label, cer: the field each line of a linked card is nearest to; the earlier field wins a tie."""
    both = pairs.select("card", "db_id").join(lines, "card").join(labels, "db_id").where("text != ''")
    scored = both.select("card", "line_no", "label", "label_ord", cer(text(F.col("line")), text(F.col("text"))).alias("cer"))
    best = scored.groupBy("card", "line_no").agg(F.min(F.struct("cer", "label_ord", "label")).alias("b"))
    return best.select("card", "line_no", "b.label", F.round("b.cer", 6).alias("cer"))


def merged_text(values: list[str]) -> tuple[str, list[int]]:
    """The record's fields in one text and where each ends."""
    text, ends = "", []
    for v in values:
        text += v.strip() + " "
        ends.append(len(text) - 1)
    return text.strip(), ends


def candidate_fields(values: list[str], line: str) -> list[int]:
    """Fields of which two characters or more are met by the line, aligned within the merged record."""
    text, ends = merged_text(values)
    places = align_substring(text, line)
    out, start = [], 0
    for k, end in enumerate(ends):
        hits = sum(places[i] >= 0 and text[i].lower() == line[places[i]].lower() for i in range(start, min(end, len(text))))
        if hits >= 2:
            out.append(k)
        start = end
    return out


def place_field(lines: list[tuple[int, str]], ref: str) -> list[tuple[int, int]]:
    """Spans of the lines, given as (start, text) in order, trimmed to what the field matches; lines one character apart
    are one span."""
    joined = " ".join(t for _, t in lines)
    places = align_substring(joined, ref)
    met = [i for i, p in enumerate(places) if p >= 0]
    if not met:
        return []
    first, last, out, at = met[0], met[-1], [], 0
    for start, text in lines:
        a, b = max(first - at, 0), min(last + 1 - at, len(text))
        if a < b:
            if out and out[-1][1] + 1 == start + a:
                out[-1] = (out[-1][0], start + b)
            else:
                out.append((start + a, start + b))
        at += len(text) + 1
    return out


def candidate_lines(pairs: DataFrame, lines: DataFrame, labels: DataFrame, text=lambda c: c) -> DataFrame:
    """card, line_no, label_ord: the fields each line of a linked card may belong to, see `candidate_fields`."""
    ls = lines.groupBy("card").agg(F.collect_list(F.struct("line_no", text(F.col("line")).alias("line"))).alias("lines"))
    vs = labels.where("text != ''").groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("label_ord", text(F.col("text")).alias("text")))).alias("fields"))
    both = pairs.select("card", "db_id").distinct().join(ls, "card").join(vs, "db_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for card, own, fields in zip(f["card"], f["lines"], f["fields"]):
                values = [x["text"] for x in fields]
                for x in own:
                    out += [(card, x["line_no"], fields[k]["label_ord"]) for k in candidate_fields(values, x["line"])]
            yield pd.DataFrame(out, columns=["card", "line_no", "label_ord"])

    return both.mapInPandas(run, "card string, line_no int, label_ord int")


def align_cards(pairs: DataFrame, lines: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float = 0.8, max_lines: int = MAX_LINES) -> DataFrame:
    """card, label, start_pos, end_pos of all linked cards by the first aligner, overlaps resolved (the outer of nested spans goes).

    A line goes to the nearest of its candidate fields; of a field's lines (none if there are more than max_lines) the best
    ordered subset is taken, trimmed to what matches and, if near enough, kept. Distances and subsets are column
    expressions; only the character alignment works on Arrow batches.
    """
    fields = labels.where("text != ''").select("db_id", "label", "label_ord", F.col("text").alias("ref"))
    linked = pairs.select("card", "db_id").distinct().join(fields, "db_id")
    found = candidate_lines(pairs, lines, labels).join(linked, ["card", "label_ord"]).join(lines, ["card", "line_no"])
    near = found.groupBy("card", "line_no", "line", "line_start").agg(F.min(F.struct(cer(F.col("line"), F.col("ref")).alias("cer"), "label_ord", "label", "ref")).alias("b"))
    own = near.groupBy("card", F.col("b.label").alias("label"), F.col("b.ref").alias("ref")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line_start", "line"))).alias("x"))
    groups = materialize(own.where(F.size("x") <= max_lines).withColumn("lines", F.transform("x", lambda x: x["line"])))
    best = best_permutation(groups.select("card", "label", "lines", "ref")).join(groups.select("card", "label", "x", "ref"), ["card", "label"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for card, label, perm, x, ref in zip(f["card"], f["label"], f["perm"], f["x"], f["ref"]):
                chosen = [(x[i]["line_start"], x[i]["line"]) for i in perm]
                spans = place_field(chosen, ref)
                cut = [next(t[a - s : b - s] for s, t in chosen if s <= a < s + len(t)).strip() for a, b in spans]
                out += [(card, label, a, b, " ".join(cut), ref) for a, b in spans]
            yield pd.DataFrame(out, columns=["card", "label", "start_pos", "end_pos", "joined", "ref"])

    placed = best.select("card", "label", "perm", "x", "ref").mapInPandas(place, "card string, label string, start_pos int, end_pos int, joined string, ref string")
    spans = placed.where(cer(F.col("joined"), F.col("ref")) < threshold).select("card", "label", "start_pos", "end_pos")
    return resolve_overlaps(spans, "outer", texts)


def best_near_match(text: str, ref: str, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the nearest substring within the limit, the first of equal ones."""
    if not ref or not text:
        return None
    row = infix_table(ref, text)
    dist = int(row[1:].min())
    if dist > limit:
        return None
    end = int(row[1:].argmin()) + 1
    # the shortest way back from this end with the same distance, anchored at the end
    n = min(end, len(ref) + dist)
    a, b = text[end - n : end][::-1], ref[::-1]
    line = list(range(len(b) + 1))
    best = (len(b), 0)
    for i, x in enumerate(a, 1):
        prev, line[0] = line[0], i
        for j, y in enumerate(b, 1):
            prev, line[j] = line[j], min(prev + (x != y), line[j] + 1, line[j - 1] + 1)
        if line[-1] < best[0]:
            best = (line[-1], i)
    return dist, end - best[1], end


def best_fuzzy_match(pairs: DataFrame, texts: DataFrame, labels: DataFrame, text=lambda c: c) -> DataFrame:
    """card, label, dist, start_pos, end_pos: the nearest place of every field in the card's text, if the distance is at
    most 0.6 of the field's length and 12. Texts are gathered once a card, not once a field."""
    vs = labels.where("text != ''").groupBy("db_id").agg(F.sort_array(F.collect_list(F.struct("label_ord", "label", text(F.col("text")).alias("text")))).alias("fields"))
    both = pairs.select("card", "db_id").join(texts.select("card", text(F.col("transcription")).alias("transcription")), "card").join(vs, "db_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for card, t, fields in zip(f["card"], f["transcription"], f["fields"]):
                for x in fields:
                    hit = best_near_match(t, x["text"], min(int(len(x["text"]) * 0.6), 12))
                    if hit:
                        out.append((card, x["label"], *hit))
            yield pd.DataFrame(out, columns=["card", "label", "dist", "start_pos", "end_pos"])

    return both.mapInPandas(run, "card string, label string, dist int, start_pos int, end_pos int")


def align_fuzzy(pairs: DataFrame, texts: DataFrame, labels: DataFrame, text=lambda c: c) -> DataFrame:
    """card, label, start_pos, end_pos by the second aligner, overlaps resolved (the inner of nested spans goes)."""
    found = best_fuzzy_match(pairs, texts, labels, text).where("end_pos > start_pos")
    return resolve_overlaps(found.select("card", "label", "start_pos", "end_pos"), "inner")
