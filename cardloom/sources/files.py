"""Readers of the file formats of the linkage pipeline; all give DataFrames with an explicit order where it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators.linkage import mapping


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """card, db_id, score of 'file id score' lines, ids with their leading zeros; of several rows a card the last one holds."""
    parts = F.split("raw", " ")
    rows = read_dump(spark, path).select(parts[0].alias("card_file"), F.get(parts, F.lit(1)).alias("db_id"), F.get(parts, F.lit(2)).try_cast("int").alias("score"), "line_no")
    return mapping(rows.where("db_id is not null"), "line_no")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """line_no (file, block, place), raw of a dump; the number orders lines by file name and, in a file, as they stand.

    A file is read in blocks; their begin and the place of a line within its block give the order whatever task reads it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("raw"))
    return lines.select(F.struct("f", "b", "i").alias("line_no"), "raw")


def read_clean_records(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, body of 'tag body' lines; a line of one word has a null body."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), parts.alias("p")).where("p[0] != ''")
    return lines.select("file", F.get("p", F.lit(0)).alias("tag"), F.get("p", F.lit(1)).alias("body"))


def read_cards(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """card, transcription of every text file below a directory; the card is the path below it without extensions."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path, wholetext=True)
    root = path.rstrip("/").split(":", 1)[-1].rstrip("/") + "/"
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substr(whole, F.locate(root, whole) + len(root))
    return files.select(F.substring_index(below, ".", 1).alias("card"), F.col("value").alias("transcription"))


def read_texts(spark: SparkSession, path: str, min_length: int = 10) -> DataFrame:
    """text of lines longer than min_length without the white space at their ends."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where(F.length("text") > min_length)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="x int")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """card, label, start_pos, end_pos of an annotation export; records without labels have no row."""
    schema = "text string, label array<struct<start:int,end:int,labels:array<string>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).where("label is not null")
    name = F.substring_index(F.substring_index("text", "/", -1), ".", 1)
    each = rows.select(name.alias("card"), F.explode("label").alias("x"))
    return each.select("card", F.explode("x.labels").alias("label"), F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """file, label, span_text, start_pos, end_pos of tab-separated span files, a card a file; where lines begin with the card, as
    `write_spans` writes them, card stands in the place of file."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) != ''").select(F.col("_metadata.file_name").alias("file"), p.alias("p"), F.size(p).alias("n"))
    n = F.col("n")
    field = lambda k: F.get("p", n - 4 + k)
    return rows.where("n >= 4").select(F.when(n >= 5, F.get("p", F.lit(0))).otherwise(F.col("file")).alias("file"), field(0).alias("label"), field(1).alias("span_text"), field(2).try_cast("int").alias("start_pos"), field(3).try_cast("int").alias("end_pos"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """card, spans (array of start_pos, end_pos, label in order of start) of ragged lines 'card TAB LABEL start end ...'."""
    parts = F.split("value", "\t")
    one = lambda p: F.struct(F.split(p, " ")[1].cast("int").alias("start_pos"), F.split(p, " ")[2].cast("int").alias("end_pos"), F.split(p, " ")[0].alias("label"))
    lines = spark.read.text(path).where("trim(value) != ''")
    return lines.select(F.get(parts, F.lit(0)).alias("card"), F.array_sort(F.transform(F.slice(parts, 2, 1 << 20), one)).alias("spans"))


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, raw of the lines of page XML files, for `xml_text_extract`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "raw"))
