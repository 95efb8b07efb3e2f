import json

import pytest

from cardloom import runtime
from cardloom.operators import linkage
from cardloom.sources import files, sinks


def test_round_trips(spark, tmp_path):
    (tmp_path / "map.txt").write_text("C1-sk01-su01-00000001.gif.xml.txt 000000018 9\nC1-sk01-su01-00000001.gif.xml.txt 000000017 6\n")
    assert [tuple(r) for r in files.read_mapping(spark, str(tmp_path / "map.txt")).collect()] == [("C1/sk01/su01/00000001", "000000017", 6)]
    (tmp_path / "set.tsv").write_text("a.txt\tTitle 12 30\tAuthor 0 11\n")
    got = files.read_dataset(spark, str(tmp_path / "set.tsv")).collect()[0]
    assert [(s.label, s.start_pos, s.end_pos) for s in got.spans] == [("Author", 0, 11), ("Title", 12, 30)]
    ann = [{"text": "/x/1.gif.xml.txt", "label": [{"start": 0, "end": 5, "labels": ["ID"]}]}, {"text": "/x/2.gif.xml.txt"}]
    (tmp_path / "ann.json").write_text(json.dumps(ann))
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "ann.json")).collect()] == [("1", "ID", 0, 5)]
    (tmp_path / "cards" / "C1").mkdir(parents=True)
    (tmp_path / "cards" / "C1" / "1.gif.xml.txt").write_text("a\nb")
    assert [tuple(r) for r in files.read_cards(spark, str(tmp_path / "cards")).collect()] == [("C1/1", "a\nb")]
    (tmp_path / "a.b (1)" / "x").mkdir(parents=True)
    (tmp_path / "a.b (1)" / "x" / "a.b (1)+.txt").write_text("t")
    assert [tuple(r) for r in files.read_cards(spark, str(tmp_path / "a.b (1)")).collect()] == [("x/a", "t")]
    s = spark.createDataFrame([("c", "Title", 3, 5), ("c", "Author", 0, 2)], "card string, label string, start_pos int, end_pos int")
    sinks.write_dataset(s, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["c\tAuthor 0 2\tTitle 3 5"]


def test_small_formats(spark, tmp_path):
    q = spark.createDataFrame([("c", "Title", "it's\ta\n\\", 1, 2)], "card string, label string, text string, start_pos int, end_pos int")
    sinks.write_spans(q, str(tmp_path / "q"), quoted=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ["c\tTitle\t\"it's\\ta\\n\\\\\"\t1\t2"]
    (tmp_path / "c.tsv").write_text("Title\tword\t3\t7\n")
    assert [tuple(r)[1:] for r in files.read_spans(spark, str(tmp_path / "c.tsv")).collect()] == [("Title", "word", 3, 7)]
    (tmp_path / "p.xml").write_text("<a>\n  <Unicode>text</Unicode>\n")
    page = files.read_page_xml(spark, str(tmp_path / "p.xml"))
    assert [r.text for r in linkage.xml_text_extract(page).collect()] == ["text"]
    tasks = spark.createDataFrame([("{}",)], "task string")
    sinks.write_tasks(tasks, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_tasks(tasks, str(tmp_path / "t"))


def test_a_cluster_must_name_its_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(Session)


def test_no_file_is_left(spark):
    import os

    kept = runtime.materialize(spark.range(3).toDF("x"))
    where = kept._cardloom_path.removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(where)
    runtime.release(kept)
    assert not os.path.exists(where)
