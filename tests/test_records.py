from pyspark.sql import functions as F

from cardloom.operators import linkage, records, unpack

LINES = [
    (1, "000000017", "24510", "$$aFirst title /$$cJ. Author"),
    (2, "000000017", "260", "$$aBrno$$bPress$$c1950"),
    (3, "000000017", "1001", "$$aAuthor, J.$$4aut"),
    (4, "000000042", "24500", "$$aDup$$aLast wins$$b"),
    (4, "000000042", "24500", "$$aDup$$aLast wins$$b"),
    (5, "000000042", None, None),
    (6, "000000042", "300", "   "),
]
SCHEMA = "line_no long, db_id string, tag string, content string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_subfields_last_wins(spark):
    got = rows(records.subfield_parse(spark.createDataFrame(LINES, SCHEMA)).where("line_no = 4"))
    assert got == [(4, "a", "Last wins"), (4, "b", "")]


def test_accepted_subfields(spark):
    acc = records.filter_empty(records.last_wins(records.accepted_subfields(spark.createDataFrame(LINES, SCHEMA))))
    assert rows(acc.select("full_type", "content").where("db_id = '000000017'")) == [
        ("24510a", "First title"), ("24510c", "J. Author"), ("260a", "Brno"), ("260b", "Press"), ("260c", "1950"),
    ]
    assert rows(acc.select("full_type", "content").where("db_id = '000000042'")) == [("24500a", "Last wins")]


def test_labels_keep_first_place_and_last_value(spark):
    lines = [*LINES, (7, "000000017", "24510", "$$aSecond title$$bsub")]
    got = records.record_labels(spark.createDataFrame(lines, SCHEMA)).where("db_id = '000000017'")
    assert [(r.label, r.text) for r in got.orderBy("label_ord").collect()] == [
        ("Title", "Second title"), ("Publisher", "Brno, Press"), ("Date", "1950"), ("Author", "Author, J."), ("Subtitle", "sub"),
    ]


def test_failed_lines(spark):
    assert rows(records.failed_lines(spark.createDataFrame(LINES, SCHEMA))) == [(6, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (records.subfield_parse, records.marc_line_parse, records.accepted_subfields, records.record_labels, records.record_rows):
        assert f(none).count() == 0
    assert unpack.unpack_marked(none, "content", ["db_id"]).count() == 0
    assert unpack.unpack_list(none, "content", ["db_id"]).count() == 0


def test_mapping_takes_the_best(spark):
    data = [("C1-sk01-su01-00000001.gif.xml.txt", "000000017", 6), ("C1-sk01-su01-00000001.gif.xml.txt", "000000018", 9), (None, "1", 1)]
    got = rows(linkage.mapping(spark.createDataFrame(data, "card_file string, db_id string, score int")))
    assert got == [("C1/sk01/su01/00000001", "000000018", 9)]
    last = rows(linkage.mapping(spark.createDataFrame([(*d, -i) for i, d in enumerate(data)], "card_file string, db_id string, score int, n int"), "n"))
    assert last == [("C1/sk01/su01/00000001", "000000017", 6)]


def test_numbers_of_a_hot_value(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then id else 7 end as k")
    got = linkage.numbered(df, [F.asc("k"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_shuffle_union_resplit(spark):
    a, b = spark.range(50).toDF("id"), spark.range(50, 60).toDF("id")
    assert linkage.union_dumps([a, b]).where("part = 1").count() == 10
    train, test = linkage.resplit(a, b, lambda d: d.withColumn("x", F.col("id") + 1))
    assert train.count() == 50 and sorted(r.x for r in test.collect()) == list(range(51, 61))
    order = [r.id for r in linkage.shuffled(a, ["id"], 3).orderBy("place").collect()]
    assert sorted(order) == list(range(50)) and order != list(range(50)) and order == [r.id for r in linkage.shuffled(a.repartition(3), ["id"], 3).orderBy("place").collect()]


def test_unpack_marked_varies_by_row(spark):
    data = [(1, "$$aX$$bY"), (2, "|aX|b Y |c"), (3, '"$aX$b""q"""'), (4, None), (5, " "), (6, "no marks"), (7, "\x1faX\x1fbY"), (8, "$$aA | b$$bC")]
    df = spark.createDataFrame(data * 3, "k int, f string")
    got = rows(unpack.unpack_marked(df, "f", ["k"]).select("k", "pos", "piece"))
    assert got == [(1, 0, "X"), (1, 1, "Y"), (2, 0, "X"), (2, 1, "Y"), (3, 0, "X"), (3, 1, '"q"'), (7, 0, "X"), (7, 1, "Y"), (8, 0, "A | b"), (8, 1, "C")]


def test_split_list():
    known = frozenset({"A-9/9", "A9", "A 9.9", "9-9.9"})
    cases = {
        "RK-1/2, ST-3/4": ["RK-1/2", "ST-3/4"],
        'IV 2.3;"BK1; c";BK2': ["IV 2.3", "BK1; c", "BK2"],
        '"BK1 ""old"""': ['BK1 "old"'],
        "RK-1/2 / IV 2.3, BK9": ["RK-1/2", "IV 2.3", "BK9"],
        "II 3.4 RK-1/2 BK7": ["II 3.4", "RK-1/2", "BK7"],
        '"RK-1/2" BK7': ["RK-1/2", "BK7"],
        "BK1 +": ["BK1"],
        "BK1, , BK2": ["BK1", "BK2"],
        "": [],
    }
    for text, want in cases.items():
        assert unpack.split_list(text, known) == want, text


def test_unpack_list_ignores_other_columns(spark):
    data = [("1", "BK1;BK2", "x"), ("1", "BK1;BK2", "y"), ("2", None, "x"), ("3", "BK3", "x"), ("4", "BK5", "x"), ("5", "BK6", "x")]
    df = spark.createDataFrame(data, "db_id string, id string, pos string")
    values = unpack.unpack_list(df.select("db_id", "id"), "id", ["db_id"])
    assert rows(unpack.in_packed(values, ["db_id"])) == [("1", 0, "BK1"), ("1", 1, "BK2")]


def test_page_xml(spark):
    df = spark.createDataFrame([(1, "  <Unicode>a &amp; b</Unicode> "), (2, "<Other>"), (3, None)], "line_no int, raw string")
    assert rows(linkage.xml_text_extract(df)) == [(1, "a &amp; b")]


def test_ranks_are_a_permutation(spark):
    df = spark.createDataFrame([(f"c{i}", str(i), i % 3) for i in range(20)], "card string, db_id string, score int")
    got = linkage.ranked_matches(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and [r.score for r in got] == sorted((i % 3 for i in range(20)), reverse=True)


def test_label_count_of_long_text(spark):
    long = "$$a" + "x" * 200_000
    df = spark.createDataFrame([(1, "1", "245", long)], SCHEMA)
    assert records.record_labels(df).select(F.length("text")).collect()[0][0] == 200_000
