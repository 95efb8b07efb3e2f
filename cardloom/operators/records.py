"""Parsing of record dumps: lines to subfields, subfields to labelled fields.

A line is (line_no, db_id, tag, content); content packs subfields as $$<code><text>. Nulls and lines that can't be
parsed give no row here and are counted by `failed_lines`. Repeated rows count once wherever lines are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.linkage import numbered

#: White space as Python's str.split() sees it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ALL = 1 << 30

# Tags whose lines name an author, if they end in the role code; tags of the other labels.
AUTHOR_TAGS = (
    "100", "700", "975", "978", "1000", "1001", "1002", "1003", "1100", "7000", "7001", "7003", "9750", "9751", "9811", "10010", "10013",
    "60017", "70002", "70010", "70012", "71012", "1OR", "7001?", "100?", "700 7", "7OR",
)
TITLE_TAGS = ("245", "24500", "24510")
ORIGINAL_TAGS = ("765", "7650")
SERIES_TAGS = ("490", "4901")
# Tags with one label that is subfield a.
PLAIN_TAGS = {"250": "Edition", "504": "References", "020": "ISBN", "022": "ISSN", "650": "Topic"}
# Subfields taken over from a dump, by tag.
ACCEPTED = {"100": ("a",), "260": ("a", "b", "c"), "300": ("a",), "245": ("a", "b", "c"), "765": ("a",), "910": ("b",)}


def dump_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold a tag and some content, repeated rows once."""
    kept = lines.select("line_no", "db_id", "tag", "content").where("tag is not null and db_id is not null and trim(content) != ''")
    return kept.distinct()


def subfields(content: Column) -> Column:
    """All subfields in order as array of (code, text); what stands before the first mark and empty ones are left out."""
    parts = F.filter(F.slice(F.split(content, r"\$\$", -1), 2, _ALL), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.substring(p, 2, _ALL).alias("text")))


def last_of(parts: Column, code: str) -> Column:
    """Text of the last subfield with this code; '' if there is none."""
    texts = F.transform(F.filter(parts, lambda p: p["code"] == code), lambda p: p["text"])
    return F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))


def has(parts: Column, code: str) -> Column:
    return F.exists(parts, lambda p: p["code"] == code)


def subfield_map(parts: Column) -> Column:
    """One (code, text) per code: at its first place, with its last text."""
    codes = F.transform(parts, lambda q: q["code"])
    first = F.filter(parts, lambda p, i: F.array_position(codes, p["code"]) == i + 1)
    return F.transform(first, lambda p: F.struct(p["code"].alias("code"), F.element_at(F.filter(parts, lambda q: q["code"] == p["code"]), -1)["text"].alias("text")))


def subfield_parse(lines: DataFrame) -> DataFrame:
    """line_no, code, text of every subfield; of a code that occurs twice the last text holds."""
    found = dump_lines(lines).select("line_no", subfields(F.col("content")).alias("p"))
    return found.select("line_no", F.explode(subfield_map(F.col("p"))).alias("s")).select("line_no", "s.code", "s.text")


def render_dump(lines: DataFrame) -> DataFrame:
    """Lines as the text of a dump: line_no, raw = 'id tag L content'; a null tag or content leaves its place out."""
    kept = lines.select("line_no", "db_id", "tag", "content").distinct()
    return kept.select("line_no", F.concat_ws(" ", "db_id", "tag", F.when(F.col("tag").isNotNull(), F.lit("L")), "content").alias("raw"))


def parse_dump(raw: DataFrame) -> DataFrame:
    """line_no, db_id, entry_type (array), content of dump lines 'id type... L content'; the type is null where the line
    can't be parsed (no L, or nothing before it)."""
    words = F.split(F.regexp_replace("raw", f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+")
    at = F.array_position("w", F.lit("L")).cast("int")
    split = raw.select("line_no", words.alias("w")).withColumn("at", at)
    ok = F.col("at") > 2
    return split.select(
        "line_no",
        F.when(ok, F.get("w", F.lit(0))).alias("db_id"),
        F.when(ok, F.slice("w", F.lit(2), F.greatest(F.col("at") - 2, F.lit(0)))).alias("entry_type"),
        F.when(ok, F.array_join(F.slice("w", F.col("at") + 1, F.lit(_ALL)), " ")).alias("content"),
    )


def marc_line_parse(lines: DataFrame) -> DataFrame:
    """line_no, db_id, entry_type, code, text: subfields of dump lines; text before the first mark counts as one too."""
    parsed = parse_dump(render_dump(lines)).where("entry_type is not null")
    every = F.filter(F.split("content", r"\$\$", -1), lambda p: p != "")
    parts = F.transform(every, lambda p: F.struct(F.substring(p, 1, 1).alias("code"), F.substring(p, 2, _ALL).alias("text")))
    found = parsed.select("line_no", "db_id", F.array_join("entry_type", " ").alias("entry_type"), parts.alias("p"))
    return found.select("line_no", "db_id", "entry_type", F.explode(subfield_map(F.col("p"))).alias("s")).select("line_no", "db_id", "entry_type", "s.code", "s.text")


def failed_lines(lines: DataFrame) -> DataFrame:
    """n_lines, n_failed: how many dump lines there are and how many can't be parsed."""
    parsed = parse_dump(render_dump(lines))
    return parsed.agg(F.count("*").alias("n_lines"), F.count_if(F.col("entry_type").isNull()).alias("n_failed"))


def accepted_subfields(lines: DataFrame) -> DataFrame:
    """line_no, db_id, full_type, content: the subfields taken over, '' where missing.

    A title part loses its closing ' /' if a statement of responsibility follows: subfield b, or a where there is no b.
    """
    found = dump_lines(lines).select("line_no", "db_id", "tag", subfields(F.col("content")).alias("p"))
    cut = lambda t: F.regexp_replace(t, " /$", "")
    a, b = last_of(F.col("p"), "a"), last_of(F.col("p"), "b")
    with_c, with_b = has(F.col("p"), "c"), has(F.col("p"), "b")
    title = F.col("tag").startswith("245")
    value = {"a": F.when(title & with_c & ~with_b, cut(a)).otherwise(a), "b": F.when(title & with_c, cut(b)).otherwise(b), "c": last_of(F.col("p"), "c")}
    key = F.when(title, "245").otherwise(F.col("tag"))
    pairs = F.array(*[F.struct(F.lit(tag).alias("k"), F.lit(c).alias("c"), value[c].alias("v")) for tag, codes in ACCEPTED.items() for c in codes])
    rows = found.select("line_no", "db_id", "tag", key.alias("k"), F.explode(pairs).alias("x")).where("x.k = k")
    return rows.select("line_no", "db_id", F.concat("tag", "x.c").alias("full_type"), F.col("x.v").alias("content"))


def last_wins(accepted: DataFrame) -> DataFrame:
    """db_id, full_type, content: of several lines the last one holds; the order is the line number."""
    return accepted.groupBy("db_id", "full_type").agg(F.max_by("content", "line_no").alias("content"))


def filter_empty(filtered: DataFrame) -> DataFrame:
    """Without empty fields, and so without records that hold nothing else."""
    return filtered.where("content != ''")


def _labels(tag: Column, content: Column, p: Column) -> Column:
    """Array of (label, text) of a line by the first rule its tag matches; empty if none does."""
    row = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    get = lambda code: last_of(p, code)
    series = F.array_join(F.transform(F.filter(subfield_map(p), lambda s: ~s["code"].isin("v", "x")), lambda s: F.concat(s["text"], F.lit(" "))), "")
    ids = F.array_join(F.transform(p, lambda s: F.concat(s["text"], F.lit(" "))), "")
    rules = (
        F.when(tag.isin(*AUTHOR_TAGS) & content.rlike("^.*aut$"), F.array(row("Author", get("a"))))
        .when(tag.isin(*TITLE_TAGS), F.array(row("Title", get("a")), row("Subtitle", get("b"))))
        .when(tag.isin(*ORIGINAL_TAGS), F.array(row("Original_title", get("t"))))
        .when(tag == "260", F.array(row("Publisher", F.concat(get("a"), F.lit(", "), get("b"))), row("Date", get("c"))))
        .when(tag == "300", F.array(row("Pages", F.concat(get("a"), F.lit(" "), get("e")))))
        .when(tag.isin(*SERIES_TAGS), F.array(row("Series", series), row("Volume", get("v")), row("ISSN", get("x"))))
        .when(tag == "910", F.array(row("ID", ids)))
    )
    for t, label in PLAIN_TAGS.items():
        rules = rules.when(tag == t, F.array(row(label, get("a"))))
    return rules


def record_labels(lines: DataFrame) -> DataFrame:
    """db_id, label, text, label_ord: the labelled fields of a record.

    A label keeps the place of its first line and the text of its last; blank texts are dropped before that.
    """
    found = dump_lines(lines).select("line_no", "db_id", _labels(F.col("tag"), F.col("content"), subfields(F.col("content"))).alias("l"))
    each = found.select("line_no", "db_id", F.posexplode("l").alias("i", "x")).select("db_id", (F.col("line_no") * 100 + F.col("i")).alias("ord"), "x.label", F.trim("x.text").alias("text"))
    per = each.where("text != ''").groupBy("db_id", "label").agg(F.min("ord").alias("first"), F.max_by("text", "ord").alias("text"))
    order = F.row_number().over(Window.partitionBy("db_id").orderBy("first")) - 1
    return per.select("db_id", "label", "text", order.cast("int").alias("label_ord"))


def record_rows(lines: DataFrame) -> DataFrame:
    """db_id, line_no, i, label, text under the stricter rules: a missing subfield drops its row, a second author counts
    if its role says so, and every shelf mark is a row of its own."""
    p = F.col("p")
    found = dump_lines(lines).select("line_no", "db_id", "tag", subfields(F.col("content")).alias("p"))
    row = lambda label, text, ok: F.struct(F.lit(label).alias("label"), F.when(ok, text).alias("text"))
    one = lambda label, code: row(label, last_of(p, code), has(p, code))
    tag = F.col("tag")
    rules = (
        F.when(tag == "100", F.array(one("Author", "a")))
        .when(tag == "700", F.array(row("Author_2", last_of(p, "a"), has(p, "a") & last_of(p, "4").contains("aut"))))
        .when(tag == "245", F.array(one("Title", "a"), row("Subtitle", last_of(p, "b"), has(p, "a") & has(p, "b"))))
        .when(tag == "765", F.array(one("Original_title", "t")))
        .when(tag == "260", F.array(row("Publisher", F.concat(last_of(p, "a"), F.lit(", "), last_of(p, "b")), has(p, "a") & has(p, "b")), row("Date", last_of(p, "c"), has(p, "a") & has(p, "b") & has(p, "c"))))
        .when(tag == "300", F.array(row("Pages", F.when(has(p, "e"), F.concat(last_of(p, "a"), F.lit(" "), last_of(p, "e"))).otherwise(last_of(p, "a")), has(p, "a"))))
        .when(tag == "490", F.array(row("Series", F.array_join(F.transform(F.filter(subfield_map(p), lambda s: ~s["code"].isin("v", "x")), lambda s: F.concat(s["text"], F.lit(" "))), ""), F.lit(True)), one("Volume", "v"), one("ISSN", "x")))
        .when(tag == "910", F.transform(p, lambda s: F.struct(F.lit("ID").alias("label"), s["text"].alias("text"))))
    )
    for t, label in PLAIN_TAGS.items():
        rules = rules.when(tag == t, F.array(one(label, "a")))
    each = found.select("db_id", "line_no", F.posexplode(rules).alias("i", "x"))
    return each.select("db_id", "line_no", "i", "x.label", "x.text").where("text is not null")


def fixed_width_project(raw: DataFrame) -> DataFrame:
    """line_no, clean = tag and body of fixed-width lines: three characters from the 17th, a space, all from the 25th."""
    return raw.select("line_no", F.concat(F.substring("raw", 17, 3), F.lit(" "), F.substring("raw", 25, _ALL)).alias("clean"))


def clean_record(raw: DataFrame) -> DataFrame:
    """line_no, clean of fixed-width lines that begin with the id of their record: three characters from the 11th, a
    space, and all from the 19th."""
    own = raw.where(F.startswith("raw", "db_id"))
    return own.select("line_no", F.concat(F.substring("raw", 11, 3), F.lit(" "), F.substring("raw", 19, _ALL)).alias("clean"))


def render_fixed(lines: DataFrame) -> DataFrame:
    """Lines in fixed width: the id at 1, the tag at 17, the body at 25; with db_id for `clean_record`."""
    kept = dump_lines(lines)
    return kept.select("line_no", "db_id", F.concat(F.rpad("db_id", 16, " "), F.rpad("tag", 8, " "), "content").alias("raw"))


def render_clean(lines: DataFrame) -> DataFrame:
    """Lines in the narrower layout: the id at 1, the tag at 11, the body at 19; each also as a line of no record, after a '#'."""
    kept = dump_lines(lines)
    own = kept.select("line_no", "db_id", F.concat(F.rpad("db_id", 10, " "), F.rpad("tag", 8, " "), "content").alias("raw"))
    return own.unionByName(own.withColumn("raw", F.concat(F.lit("#"), "raw")))


def merge_boundaries(labels: DataFrame) -> DataFrame:
    """db_id, label, boundary: where the label ends in the record's merged text, its trimmed texts joined by spaces."""
    w = Window.partitionBy("db_id").orderBy("label_ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(F.trim("text")) + 1).over(w) - 1
    return labels.select("db_id", "label", end.cast("int").alias("boundary"))


def grouped_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """db_id, ord (from 1), line_no, line: the lines of the wanted ids in order (a semi join). They are numbered over all ids at
    once, so the lines of an id that many have are not one task's."""
    kept = dump_lines(lines).join(ids.select("db_id").distinct(), "db_id", "left_semi")
    rows = numbered(kept.select("db_id", "line_no", F.concat_ws(" ", "tag", "content").alias("line")), [F.asc("db_id"), F.asc("line_no"), F.asc("line")], "_n")
    first = rows.groupBy("db_id").agg(F.min("_n").alias("_first"))
    return rows.join(first, "db_id").select("db_id", (F.col("_n") - F.col("_first") + 1).alias("ord"), "line_no", "line")
