"""Writers of the file formats of the linkage pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.operators.linkage import build_index
from cardloom.operators.spans import dataset_lines


def write_records(labels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The labelled fields of all records in ranges of the id, a record's together and in order."""
    labels.repartitionByRange("db_id").sortWithinPartitions("db_id", "label_ord").write.mode(mode).parquet(path)


def write_clean_records(clean: DataFrame, path: str, mode: str = "overwrite") -> None:
    """'tag body' lines of clean records, in order of the line."""
    clean.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.col("clean").alias("value")).write.mode(mode).text(path)


def literal(text: Column) -> Column:
    """A text as a literal: in single quotes, or in double ones if it holds a single and no double quote; backslash, line
    feed, tab and carriage return escaped."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))


def write_spans(spans: DataFrame, path: str, mode: str = "overwrite", quoted: bool = False) -> None:
    """card, label, text, start, end separated by tabs, in ranges of the card, a card's together and in order. quoted: the text as a literal."""
    text = literal(F.col("text")) if quoted else F.translate("text", "\t\n\r", "   ")
    rows = spans.repartitionByRange("card").sortWithinPartitions("card", "start_pos", "end_pos", "label")
    rows.select(F.concat_ws("\t", "card", "label", text, "start_pos", "end_pos").alias("value")).write.mode(mode).text(path)


def write_dataset(spans: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line a card, as `dataset_lines` gives them."""
    dataset_lines(spans).select(F.col("line").alias("value")).write.mode(mode).text(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """The JSON of annotation tasks, one a line; fails if the path exists."""
    tasks.select(F.col("task").alias("value")).write.mode("errorifexists").text(path)


def write_texts(cards: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The text store: card, transcription, to be joined by card."""
    cards.select("card", "transcription").write.mode(mode).parquet(path)


def write_index(docs: DataFrame, key: str, text: str, path: str, mode: str = "overwrite") -> None:
    """Postings and lengths of a full-text index."""
    postings, lengths = build_index(docs, key, F.col(text))
    postings.write.mode(mode).parquet(f"{path}/postings")
    lengths.write.mode(mode).parquet(f"{path}/lengths")


def html_rows(labels: DataFrame, raw: DataFrame) -> DataFrame:
    """db_id, ord, html: the lines of a table of records, fields beside raw lines. A record opens with its fields (as many as there are
    labels), then come its lines, then what closes it; so the lines of a record that has many are no single group."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    left = labels.groupBy("db_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label_ord", F.concat_ws(" ", "label", "text").alias("t")))), lambda x: esc(x["t"])), "<br>").alias("fields"))
    begin = left.select("db_id", F.lit(-1).cast("long").alias("ord"), F.concat(F.lit("<tr><td>"), "fields", F.lit("</td><td>")).alias("html"))
    lines = raw.join(left.select("db_id"), "db_id", "left_semi").select("db_id", F.col("line_no").cast("long").alias("ord"), F.concat(esc(F.col("content")), F.lit("<br>")).alias("html"))
    end = left.select("db_id", F.lit((1 << 63) - 1).alias("ord"), F.lit("</td></tr>").alias("html"))
    return begin.unionByName(lines).unionByName(end)


def error_report(totals: DataFrame) -> DataFrame:
    """card, report: the error of a card and of each of its labels to four places, a line each."""
    error = F.when(F.col("hull") > 0, 1 - F.col("inter") / F.col("hull")).otherwise(F.lit(-1.0))
    rows = totals.where("card is not null").select("card", F.coalesce("label", F.lit("")).alias("label"), F.format_number(error, 4).alias("e"))
    line = F.concat_ws(": ", F.when(F.col("label") == "", "total").otherwise(F.col("label")), "e")
    return rows.groupBy("card").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", line.alias("l")))), lambda x: x["l"]), "\n").alias("report"))
