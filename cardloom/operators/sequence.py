"""Token sequences of a card: splitting, labels from spans, islands, tags, offsets.

Order is always an explicit column. A null text has no token; a group is the tokens of one card or the rows of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.records import SPACE

LINE_BREAK = "[LF]"


def lf_tokens(text: Column) -> Column:
    """Words of a text, every line break a word of its own; an empty array for a blank text."""
    marked = F.replace(text, F.lit("\n"), F.lit(f" {LINE_BREAK} "))
    return F.filter(F.split(marked, f"{SPACE}+"), lambda t: t != "")


def tokens_of(cards: DataFrame) -> DataFrame:
    """card, tok_ord, token."""
    texts = cards.select("card", "transcription").where("card is not null and transcription is not null").distinct()
    return texts.select("card", F.posexplode(lf_tokens(F.col("transcription"))).alias("tok_ord", "token"))


def token_offsets(cards: DataFrame) -> DataFrame:
    """card, tok_ord, token, start_pos, end_pos: where each white-space separated word stands in the raw text.

    Lengths of words and of the gaps before them are summed up, so a word that occurs twice is placed twice.
    """
    texts = cards.select("card", "transcription").where("card is not null and transcription is not null").distinct()
    words = F.regexp_extract_all("transcription", F.lit(f"([^{SPACE[1:-1]}]+)"))
    gaps = F.regexp_extract_all("transcription", F.lit(f"({SPACE}*)[^{SPACE[1:-1]}]+"), F.lit(1))
    each = texts.select("card", F.posexplode(F.arrays_zip(words.alias("w"), gaps.alias("g"))).alias("tok_ord", "x")).select("card", "tok_ord", F.col("x.w").alias("token"), F.length("x.g").alias("gap"))
    w = Window.partitionBy("card").orderBy("tok_ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("token") + F.col("gap")).over(w).cast("int")
    return each.select("card", "tok_ord", "token", (end - F.length("token")).alias("start_pos"), end.alias("end_pos"))


def offsets_to_io(cards: DataFrame, spans: DataFrame) -> DataFrame:
    """card, seg, tok_ord, token, label: the text cut at the spans, the words of a span with its label, others 'O'.

    Segments are, in order of start, what stands before a span and the span, and at last what stands after the last one. The
    words of spans that overlap come out with each of them. The text is cut before line breaks are marked, so labels don't
    drift. A card without spans is one segment of 'O'.
    """
    texts = cards.select("card", "transcription").where("card is not null and transcription is not null").distinct()
    ordered = F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "label")))
    per = spans.where("end_pos > start_pos").groupBy("card").agg(ordered.alias("s"))
    both = texts.join(per, "card", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start_pos:int,end_pos:int,label:string>>")))
    end_before = lambda i: F.coalesce(F.get("s", i - 1)["end_pos"], F.lit(0))
    seg = lambda a, b, label: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), label.alias("label"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.array(seg(end_before(i), x["start_pos"], F.lit("O")), seg(x["start_pos"], x["end_pos"], x["label"]))))
    rest = F.array(seg(end_before(F.size("s")), F.length("transcription"), F.lit("O")))
    segs = both.select("card", "transcription", F.posexplode(F.concat(pairs, rest)).alias("seg", "x"))
    cut = F.expr("substring(transcription, x.a + 1, greatest(x.b - x.a, 0))")
    return segs.select("card", "seg", F.col("x.label").alias("label"), F.posexplode(lf_tokens(cut)).alias("tok_ord", "token"))


def found_offsets(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """card, tok_ord, token, start_pos, end_pos of given tokens, each searched for from the end of the one found before.

    texts: card, transcription; tokens: card, tok_ord, token. A token that isn't found has null positions and the search goes
    on where it was; marks of line breaks are not searched for. The unit of work is one card.
    """
    per = tokens.where(F.col("token") != LINE_BREAK).groupBy("card").agg(F.sort_array(F.collect_list(F.struct("tok_ord", "token"))).alias("t"))
    both = texts.select("card", "transcription").where("transcription is not null").distinct().join(per, "card")
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<tok_ord:int,token:string,start_pos:int,end_pos:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = F.call_function("locate", x["token"], F.col("transcription"), acc["at"])
        hit, n = at > 0, F.length(x["token"])
        row = F.struct(x["tok_ord"].cast("int").alias("tok_ord"), x["token"].alias("token"), F.when(hit, at - 1).alias("start_pos"), F.when(hit, at - 1 + n).alias("end_pos"))
        return F.struct(F.when(hit, at + n).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return both.select("card", F.explode(F.aggregate("t", begin, step)["out"]).alias("x")).select("card", "x.*")


def with_label_ids(rows: DataFrame, ids: DataFrame, label: str = "label", into: str = "label_id", line_break: int | None = None, token: str = "token") -> DataFrame:
    """rows with the id of their label; a label of no id has null. line_break: what a line break gets in its place, as -100 to leave
    it out of a loss. ids: label, id, a row a label."""
    named = ids.select(F.col("label").alias("_l"), F.col("id").alias(into))
    joined = rows.join(F.broadcast(named), F.col(label) == F.col("_l"), "left").drop("_l")
    return joined if line_break is None else joined.withColumn(into, F.when(F.col(token) == LINE_BREAK, line_break).otherwise(F.col(into)))


def label_islands(rows: DataFrame, key: str, order: list[str], label: str, value: str) -> DataFrame:
    """Runs of equal labels in order: key, island, label, n, first and last of the first order column, values collected."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    marked = rows.withColumn("_f", fresh).withColumn("island", island)
    return marked.groupBy(key, "island").agg(
        F.first(label).alias("label"), F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.collect_list(value).alias("values")
    )


def aggregate_confidence(islands: DataFrame, how: str) -> DataFrame:
    """The islands with confidence = prod, mean, max, min or median of their values."""
    v = F.col("values")
    n = F.size(v)
    ordered = F.sort_array(v)
    fold = {
        "prod": F.aggregate(v, F.lit(1.0), lambda a, x: a * x),
        "mean": F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n,
        "max": F.array_max(v),
        "min": F.array_min(v),
        "median": (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2,
    }
    return islands.withColumn("confidence", fold[how]).drop("values")


def iob_tags(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """rows with tag: 'B-' where a label differs from the one before, 'I-' where it goes on, 'O' alone and resetting."""
    before = F.lag(label).over(Window.partitionBy(key).orderBy(*order))
    tag = F.when(F.col(label) == "O", "O").when(before.eqNullSafe(F.col(label)), F.concat(F.lit("I-"), label)).otherwise(F.concat(F.lit("B-"), label))
    return rows.withColumn("tag", tag)


def propagate_labels(pieces: DataFrame, key: str, order: list[str], labels: Column) -> DataFrame:
    """pieces with piece_label: pieces have start and end within their word. Ends at 0 (special pieces) get -100; a start
    at 0 moves on to the next of the labels (an array), other pieces repeat the current one; null beyond the last."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    word = F.count_if((F.col("start") == 0) & (F.col("end") > 0)).over(w)
    return pieces.withColumn("piece_label", F.when(F.col("end") == 0, F.lit(-100)).otherwise(F.get(labels, (word - 1).cast("int"))))


def label_ids(spark, labels: tuple[str, ...], kinds: tuple[str, ...] = ("I", "O", "B")) -> DataFrame:
    """label, id of every prefixed label, in the order labels by kinds from 1; plain 'O' is 0. Without kinds the labels
    themselves are numbered."""
    names = [f"{k}-{label}" for label in labels for k in kinds] if kinds else list(labels)
    return spark.createDataFrame([("O", 0), *((n, i + 1) for i, n in enumerate(names))], "label string, id int")
