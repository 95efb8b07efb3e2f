"""The queries of the core operators, over the whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import distance
from cardloom.operators import align, inference, linkage, metrics, records, sequence, spans, unpack
from cardloom.runtime import scratch_path, table
from cardloom.sources import files, sinks

FLAGSHIP = "classification_report"
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Columns of the record table by the label of the field they hold, in the order of a record.
LABEL_COLUMNS = {"Author": "author", "Title": "title", "Subtitle": "subtitle", "Publisher": "publisher", "Date": "date_text", "Pages": "pages", "Series": "series", "Edition": "edition", "ID": "id"}


def query(f: Callable) -> Callable:
    """Register f(t), t giving a table by its name, under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: table(spark, sf_dir, name))

    REGISTRY[f.__name__] = run
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def _field_labels(t) -> DataFrame:
    """db_id, label, text, label_ord of the record table."""
    rows = t("db_record").select("db_id", *LABEL_COLUMNS.values()).distinct()
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).alias("text"), F.lit(i).alias("label_ord")) for i, (label, c) in enumerate(LABEL_COLUMNS.items())])
    return rows.select("db_id", F.explode(each).alias("x")).select("db_id", "x.*").where("text is not null and trim(text) != ''")


def _links(t) -> DataFrame:
    return linkage.mapping(t("card_mapping"))


def _spans(t) -> DataFrame:
    return spans.tidy(t("card_span"))


def _aligned(t) -> DataFrame:
    """The spans misplaced by up to three characters, as an aligner would."""
    return spans.shifted(_spans(t), F.col("start_pos") % 4)


def _masks(t) -> DataFrame:
    a = spans.char_mask(_spans(t)).withColumnRenamed("label", "truth")
    b = spans.char_mask(_aligned(t)).withColumnRenamed("label", "pred")
    return a.join(b, ["card", "pos"], "full")


@query
def p3_found(t):
    lines = t("db_record_line").select("db_id", "line_no", "content")
    content = unpack.in_packed(unpack.unpack_marked(lines, "content", ["db_id", "line_no"]), ["db_id", "line_no"])
    ids = unpack.in_packed(unpack.unpack_list(t("db_record").select("db_id", "id"), "id", ["db_id"]), ["db_id"])
    return content.select(F.lit("content").alias("field"), "db_id", "line_no", "pos", "piece").unionByName(
        ids.select(F.lit("id").alias("field"), "db_id", F.lit(0).cast("long").alias("line_no"), "pos", "piece")
    )


@query
def subfield_parse(t):
    return records.subfield_parse(t("db_record_line"))


@query
def marc_line_parse(t):
    return records.marc_line_parse(t("db_record_line"))


@query
def failed_lines(t):
    return records.failed_lines(t("db_record_line"))


@query
def accepted_subfields(t):
    return records.accepted_subfields(t("db_record_line"))


@query
def last_wins(t):
    return records.last_wins(records.accepted_subfields(t("db_record_line")))


@query
def filter_empty(t):
    return records.filter_empty(records.last_wins(records.accepted_subfields(t("db_record_line"))))


@query
def record_labels(t):
    return records.record_labels(t("db_record_line"))


@query
def record_rows(t):
    return records.record_rows(t("db_record_line"))


@query
def fixed_width_project(t):
    return records.fixed_width_project(records.render_fixed(t("db_record_line")))


@query
def clean_record(t):
    return records.clean_record(records.render_clean(t("db_record_line")))


@query
def merge_boundaries(t):
    return records.merge_boundaries(records.record_labels(t("db_record_line")))


@query
def semi_join_ids(t):
    return records.grouped_lines(t("db_record_line"), _links(t))


@query
def mapping(t):
    return _links(t)


@query
def card_lines(t):
    return linkage.card_lines(t("card_transcription"))


@query
def card_record_join(t):
    return linkage.card_record_join(_links(t), t("card_transcription"), _field_labels(t))


@query
def anti_resume(t):
    return linkage.anti_resume(t("card_transcription"), t("card_span"))


@query
def suffix_first_match(t):
    return linkage.suffix_first_match(t("card_span").select(F.substring_index("card", "/", -1).alias("stem")), t("card_transcription"))


@query
def grep_ids(t):
    return linkage.grep_ids(records.render_dump(t("db_record_line")), _links(t))


@query
def union_prefixed(t):
    rows = t("card_mapping").select("card_file", "db_id")
    return linkage.union_prefixed({"old": rows, "new": rows.distinct()}, "card_file")


@query
def ranked_matches(t):
    return linkage.ranked_matches(_links(t))


@query
def task_numbering(t):
    return linkage.task_numbering(linkage.latest_texts(t("card_transcription")))


@query
def xml_text_extract(t):
    lines = linkage.latest_texts(t("card_transcription")).select("card", F.posexplode(F.split("transcription", "\n")).alias("n", "line"))
    raw = F.array(F.concat(F.lit("  <Coords points='0,0'/>"), "line"), F.concat(F.lit("  <Unicode>"), "line", F.lit("</Unicode> ")), F.lit("  </TextEquiv>"))
    page = lines.select("card", "n", F.posexplode(raw).alias("k", "raw")).select(F.concat_ws("#", "card", "n", "k").alias("line_no"), "raw")
    return linkage.xml_text_extract(page)


@query
def records_match_score(t):
    return linkage.records_match_score(_links(t), linkage.card_lines(t("card_transcription")), _field_labels(t), text=distance.fold_ascii)


@query
def index_search(t):
    docs = t("db_record").select("db_id", F.concat_ws(" ", "title", "author").alias("text")).distinct()
    return linkage.index_search(linkage.latest_texts(t("card_transcription")), docs, "card", F.col("transcription"), "db_id", F.col("text"))


@query
def cer(t):
    own = t("card_span").select("card", F.replace(F.col("label"), F.lit(" "), F.lit("_")).alias("label"), "span_text", "start_pos").distinct()
    both = own.join(_links(t).select("card", "db_id"), "card").join(_field_labels(t), ["db_id", "label"])
    return both.select("card", "label", "start_pos", F.round(distance.cer(distance.fold_ascii(F.col("span_text")), distance.fold_ascii(F.col("text"))), 6).alias("cer"))


@query
def infix_distance(t):
    own = t("card_span").select("card", distance.fold_ascii(F.col("span_text")).alias("word")).where("word != ''").distinct()
    titles = _field_labels(t).where("label = 'Title'").select("db_id", distance.fold_ascii(F.col("text")).alias("title"))
    pairs = own.join(_links(t).select("card", "db_id"), "card").join(titles, "db_id").select("word", "title").distinct()
    return pairs.select("word", "title", distance.infix_udf()("word", "title").alias("dist"))


@query
def line_label_assign(t):
    return align.line_label_assign(_links(t), linkage.card_lines(t("card_transcription")), _field_labels(t), distance.fold_ascii)


@query
def best_permutation(t):
    lines = linkage.card_lines(t("card_transcription"))
    assigned = align.line_label_assign(_links(t), lines, _field_labels(t), distance.fold_ascii)
    groups = assigned.join(lines, ["card", "line_no"]).groupBy("card", "label").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    refs = _links(t).select("card", "db_id").join(_field_labels(t), "db_id").select("card", "label", F.col("text").alias("ref"))
    with_lines = groups.select("card", "label", F.transform("x", lambda x: x["line"]).alias("lines")).join(refs, ["card", "label"])
    return align.best_permutation(with_lines, distance.fold_ascii)


@query
def align_cards(t):
    texts = linkage.latest_texts(t("card_transcription"))
    return align.align_cards(_links(t), linkage.card_lines(t("card_transcription")), _field_labels(t), texts)


@query
def best_fuzzy_match(t):
    return align.best_fuzzy_match(_links(t), linkage.latest_texts(t("card_transcription")), _field_labels(t), distance.fold_ascii)


@query
def align_fuzzy(t):
    return align.align_fuzzy(_links(t), linkage.latest_texts(t("card_transcription")), _field_labels(t), distance.fold_ascii)


@query
def interval_iou(t):
    pairs = spans.interval_pairs(_spans(t), _aligned(t))
    return pairs.withColumn("iou", F.round(F.col("inter") / F.col("hull"), 6))


@query
def iou_match(t):
    return spans.iou_match(_spans(t), _aligned(t))


@query
def iou_totals(t):
    return spans.iou_totals(spans.iou_match(_spans(t), _aligned(t)))


@query
def label_error(t):
    return spans.label_error(spans.iou_totals(spans.iou_match(_spans(t), _aligned(t))))


@query
def overlap_pairs(t):
    return spans.overlap_pairs(_aligned(t))


@query
def merge_adjacent_spans(t):
    return spans.merge_adjacent_spans(_spans(t))


@query
def char_mask(t):
    return spans.char_mask(_spans(t))


@query
def masked_error(t):
    return spans.masked_error(_spans(t), _aligned(t))


@query
def classification_report(t):
    return metrics.classification_report(_masks(t), "truth", "pred")


@query
def masked_accuracy(t):
    ids = sequence.label_ids(t("region").sparkSession, tuple(spans.MASK_SIGNS), ())
    ids = ids.withColumn("label", F.replace("label", F.lit(" "), F.lit("_")))
    both = sequence.with_label_ids(sequence.with_label_ids(_masks(t), ids, "truth", "t_id"), ids, "pred", "p_id")
    return metrics.masked_accuracy(both, F.coalesce("t_id", F.lit(-100)), F.coalesce("p_id", F.lit(0)), F.substring_index("card", "/", 1))


@query
def space_positions(t):
    own = t("card_span").select("card", "label", "start_pos", "span_text").distinct()
    return own.select("card", "label", "start_pos", F.array_join(spans.space_positions(F.col("span_text")), ",").alias("spaces"))


@query
def refine_border(t):
    texts = linkage.latest_texts(t("card_transcription")).select("card", spans.space_positions(F.col("transcription")).alias("spaces"))
    both = _spans(t).join(texts, "card")
    return both.select("card", "label", "start_pos", "end_pos", spans.refine_border(F.col("start_pos"), F.col("end_pos"), F.col("spaces")).alias("border"))


@query
def span_text(t):
    return spans.span_text(_spans(t), linkage.latest_texts(t("card_transcription")))


@query
def merge_annotations(t):
    return spans.dataset_lines(_spans(t))


@query
def training_filter(t):
    return spans.training_filter(_spans(t))


@query
def resolve_inner(t):
    return spans.resolve_overlaps(_aligned(t), "inner")


@query
def resolve_outer(t):
    return spans.resolve_overlaps(_aligned(t), "outer", linkage.latest_texts(t("card_transcription")))


@query
def lf_tokenize(t):
    return sequence.tokens_of(linkage.latest_texts(t("card_transcription")))


@query
def token_offsets(t):
    return sequence.token_offsets(linkage.latest_texts(t("card_transcription")))


@query
def offsets_to_io(t):
    return sequence.offsets_to_io(linkage.latest_texts(t("card_transcription")), _spans(t))


def _islands(t) -> DataFrame:
    scaled = t("events").withColumn("conf", F.col("value") / 1000)
    return sequence.label_islands(scaled, "user_id", ["ts", "event_id"], "event_type", "conf")


@query
def label_islands(t):
    return _islands(t).drop("values")


def _confidence(how: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = sequence.aggregate_confidence(_islands(lambda name: table(spark, sf_dir, name)), how)
        return done.select("user_id", "island", "label", F.round("confidence", 9).alias("confidence"))

    REGISTRY[f"confidence_agg_{how}"] = run


for _how in ("prod", "mean", "max", "min", "median"):
    _confidence(_how)


@query
def iob_tags(t):
    return sequence.iob_tags(t("events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "tag")


@query
def propagate_labels(t):
    words = sequence.tokens_of(linkage.latest_texts(t("card_transcription")))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("token") - 1) / 3).cast("int")), lambda k: F.struct(k.alias("piece"), (k * 3).alias("start"), F.least(k * 3 + 3, F.length("token")).alias("end")))
    pieces = words.select("card", "tok_ord", F.explode(cut).alias("x")).select("card", "tok_ord", "x.*")
    first = words.groupBy("card").agg(F.lit(-1).alias("tok_ord"), F.lit(0).alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    per = F.transform(F.sort_array(F.collect_list(F.struct("tok_ord", F.length("token").alias("n")))), lambda x: x["n"])
    labels = words.groupBy("card").agg(per.alias("labels"))
    both = pieces.unionByName(first).join(labels, "card")
    return sequence.propagate_labels(both, "card", ["tok_ord", "piece"], F.col("labels")).select("card", "tok_ord", "piece", "piece_label")


@query
def label_ids(t):
    return sequence.label_ids(t("region").sparkSession, tuple(LABEL_COLUMNS))


@query
def length_histogram(t):
    return metrics.length_histogram(t("documents").where("text is not null"), F.size(F.split("text", " ")))


@query
def softmax_confidence(t):
    v = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(metrics.softmax_confidence(v), 6).alias("confidence"), metrics.argmax(v).alias("best"))


# The operators below had no query of their own; readers and writers are tested by what comes back from a file.


def _written(t, write) -> str:
    path = scratch_path(t("region").sparkSession)
    write(path)
    return path


@query
def read_mapping(t):
    rows = linkage.numbered(t("card_mapping").distinct(), [F.asc("card_file"), F.asc("score"), F.asc("db_id")], "n")
    lines = rows.orderBy("n").select(F.concat_ws(" ", "card_file", "db_id", "score").alias("value")).coalesce(1)
    return files.read_mapping(lines.sparkSession, _written(t, lines.write.text))


@query
def read_dump(t):
    raw = records.render_dump(t("db_record_line")).select("line_no", F.regexp_replace("raw", r"[\n\r]", " ").alias("value"))
    path = _written(t, raw.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text)
    return linkage.numbered(files.read_dump(raw.sparkSession, path), [F.asc("line_no")], "n").select("n", "raw")


@query
def read_clean_records(t):
    clean = records.clean_record(records.render_clean(t("db_record_line"))).withColumn("clean", F.regexp_replace("clean", r"[\n\r]", " "))
    back = files.read_clean_records(clean.sparkSession, _written(t, lambda p: sinks.write_clean_records(clean, p)))
    return back.groupBy("tag", "body").agg(F.count("*").alias("n"))


@query
def read_cards(t):
    # one file a card, in a directory named after it
    texts = linkage.latest_texts(t("card_span").select("card").distinct().join(t("card_transcription"), "card"))
    named = texts.select(F.replace("card", F.lit("/"), F.lit("-")).alias("file"), F.replace("transcription", F.lit("\r"), F.lit(" ")).alias("value"))
    back = files.read_cards(texts.sparkSession, _written(t, lambda p: named.write.option("lineSep", "\u0000").partitionBy("file").text(p)))
    return back.select(F.regexp_extract("card", r"^file=([^/]+)/", 1).alias("card"), F.rtrim(F.replace("transcription", F.lit("\u0000"), F.lit(""))).alias("transcription"))


@query
def read_spans(t):
    rows = spans.tidy(t("card_span")).withColumn("text", F.lit("x"))
    return files.read_spans(rows.sparkSession, _written(t, lambda p: sinks.write_spans(rows, p))).withColumnRenamed("file", "card")


@query
def read_spans_quoted(t):
    rows = t("card_span").where("span_text is not null").select("card", F.replace(F.col("label"), F.lit(" "), F.lit("_")).alias("label"), F.col("span_text").alias("text"), "start_pos", "end_pos").distinct()
    return files.read_spans(rows.sparkSession, _written(t, lambda p: sinks.write_spans(rows, p, quoted=True))).withColumnRenamed("file", "card")


@query
def read_dataset(t):
    back = files.read_dataset(t("region").sparkSession, _written(t, lambda p: sinks.write_dataset(_spans(t), p)))
    return back.select("card", F.posexplode("spans").alias("n", "x")).select("card", "n", "x.label", "x.start_pos", "x.end_pos")


@query
def read_annotations(t):
    own = _spans(t).groupBy("card").agg(F.collect_list(F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.array("label").alias("labels"))).alias("label"))
    rows = own.select(F.concat(F.lit("/x/"), F.replace("card", F.lit("/"), F.lit("-")), F.lit(".gif.xml.txt")).alias("text"), "label")
    # an export is an array: one row, so one file, for each of some buckets
    exports = rows.groupBy(F.pmod(F.xxhash64("text"), F.lit(8)).alias("b")).agg(F.to_json(F.collect_list(F.struct("text", "label"))).alias("value"))
    return files.read_annotations(rows.sparkSession, _written(t, exports.write.partitionBy("b").text))


@query
def read_tasks(t):
    tasks = linkage.task_numbering(linkage.latest_texts(t("card_transcription")))
    back = tasks.sparkSession.read.schema("id int, data struct<text:string,body:string>").json(_written(t, lambda p: sinks.write_tasks(tasks, p)))
    return back.select("id", "data.text", "data.body")


@query
def read_texts(t):
    lines = linkage.card_lines(t("card_transcription")).select(F.regexp_replace("line", r"[\r\x0b\x0c]", " ").alias("value"))
    back = files.read_texts(lines.sparkSession, _written(t, lines.write.text))
    return back.groupBy("text").agg(F.count("*").alias("n"))


@query
def read_numbers(t):
    sizes = t("documents").where("text is not null").select(F.length("text").cast("string").alias("value"))
    back = files.read_numbers(sizes.sparkSession, _written(t, sizes.write.text))
    return back.groupBy("x").agg(F.count("*").alias("n"))


@query
def read_store(t):
    path = _written(t, lambda p: sinks.write_texts(linkage.latest_texts(t("card_transcription")), p))
    return t("card_mapping").select(linkage.card_of_file(F.col("card_file")).alias("card")).distinct().join(t("region").sparkSession.read.parquet(path), "card")


@query
def read_record_files(t):
    return t("region").sparkSession.read.parquet(_written(t, lambda p: sinks.write_records(records.record_labels(t("db_record_line")), p)))


@query
def read_index(t):
    docs = t("db_record").select("db_id", F.concat_ws(" ", "title", "author").alias("text")).distinct()
    path = _written(t, lambda p: sinks.write_index(docs, "db_id", "text", p))
    spark = docs.sparkSession
    return spark.read.parquet(f"{path}/postings").join(spark.read.parquet(f"{path}/lengths"), "db_id")


@query
def html_rows(t):
    raw = records.dump_lines(t("db_record_line")).select("db_id", "line_no", "content")
    return sinks.html_rows(records.record_labels(t("db_record_line")), raw)


@query
def error_report(t):
    return sinks.error_report(spans.iou_totals(spans.iou_match(_spans(t), _aligned(t))))


@query
def label_id_join(t):
    tokens = sequence.offsets_to_io(linkage.latest_texts(t("card_transcription")), spans.label_whitelist(_spans(t), ("Author", "Title", "ID")))
    ids = sequence.label_ids(tokens.sparkSession, ("Author", "Title", "ID"), ())
    return sequence.with_label_ids(tokens, ids, line_break=-100).select("card", "seg", "tok_ord", "token", "label_id")


@query
def label_whitelist(t):
    return spans.label_whitelist(_spans(t), ("Author", "Title", "ID"))


@query
def found_offsets(t):
    texts = linkage.latest_texts(t("card_transcription"))
    return sequence.found_offsets(texts, sequence.tokens_of(texts))


@query
def mask_signs(t):
    return spans.mask_signs(_spans(t), linkage.latest_texts(t("card_transcription")))


@query
def unmasked(t):
    return spans.unmasked(spans.mask_signs(_spans(t), linkage.latest_texts(t("card_transcription"))))


@query
def union_dumps(t):
    lines = records.dump_lines(t("db_record_line")).select("db_id", "line_no")
    return linkage.union_dumps([lines.where("line_no % 2 = 0"), lines.where("line_no % 2 = 1")])


@query
def resplit(t):
    docs = t("documents").select("doc_id", "text")
    train, test = linkage.resplit(docs.where("doc_id % 5 != 0"), docs.where("doc_id % 5 = 0"), lambda d: d.withColumn("n", F.length("text")))
    return train.select("doc_id", "n", F.lit("train").alias("part")).unionByName(test.select("doc_id", "n", F.lit("test").alias("part")))


@query
def shuffled(t):
    done = linkage.shuffled(t("documents").select("doc_id"), ["doc_id"], 7)
    return done.agg(F.count("*").alias("n"), F.count_distinct("place").alias("n_places"), F.max("place").alias("last"), F.sum("doc_id").alias("ids"), (F.corr("doc_id", "place") < 0.9).alias("is_mixed"))


@query
def length_density(t):
    return metrics.length_density(t("documents").where("text is not null"), F.size(F.split("text", " ")))


@query
def predicted_spans(t):
    texts = linkage.latest_texts(t("card_transcription"))
    return inference.predicted_spans(inference.predict_words(texts, _by_length), "mean", 0.5).select("card", "island", "label", "n", "first", "last", F.round("confidence", 6).alias("confidence"))


def _by_length(words: list[str]) -> list[tuple[str, float]]:
    """A stand-in for a classifier: words by their length."""
    return [("O", 1.0) if len(w) < 4 else ("LONG" if len(w) > 7 else "MID", (len(w) % 10) / 10) for w in words]


@query
def matched_cards(t):
    cards = linkage.latest_texts(t("card_transcription"))
    docs = t("db_record").select("db_id", F.concat_ws(" ", "title", "author").alias("text")).distinct()
    return linkage.matched_cards(cards, linkage.card_lines(t("card_transcription")), docs, _field_labels(t))
