import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions import distance
from cardloom.operators import align, inference, linkage, metrics, sequence, spans

SPAN = "card string, label string, start_pos int, end_pos int"


def brute(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(p + (x != y), d[j] + 1, d[j - 1] + 1)
    return d[-1]


def test_infix_distance_against_all_substrings():
    random.seed(1)
    for _ in range(300):
        a = "".join(random.choices("abcd", k=random.randint(1, 6)))
        b = "".join(random.choices("abcd", k=random.randint(6, 12)))
        want = min(brute(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert distance.infix_distance(a, b) == want
        assert want <= distance.infix_distance(a, b, compat=True) <= want + 1
    assert distance.infix_distance("abcd", "bcde") == 1 and distance.infix_distance("abcd", "bcde", compat=True) == 2


def test_alignment_is_of_least_cost():
    random.seed(2)
    for _ in range(200):
        a = "".join(random.choices("abc", k=random.randint(1, 12)))
        b = "".join(random.choices("abc", k=random.randint(1, 5)))
        places = distance.align_substring(a, b)
        met = [i for i, p in enumerate(places) if p >= 0]
        least = min(brute(b, a[i:j]) for i in range(len(a) + 1) for j in range(i, len(a) + 1))
        cost = sum(a[i] != b[places[i]] for i in met) + len(b) - len(met) + (sum(p < 0 for p in places[met[0] : met[-1] + 1]) if met else 0)
        assert cost == least and [places[i] for i in met] == sorted(places[i] for i in met)


def test_best_near_match_is_nearest():
    random.seed(3)
    for _ in range(200):
        t = "".join(random.choices("abc", k=15))
        r = "".join(random.choices("abc", k=5))
        least = min(brute(r, t[i:j]) for i in range(15) for j in range(i + 1, 16))
        got = align.best_near_match(t, r, 12)
        assert got[0] == least and brute(r, t[got[1] : got[2]]) == least


@pytest.mark.parametrize(("left", "right", "gaps", "want"), [(10, 14, [3, 12, 20], 12), (10, 20, [11, 13, 17], 13), (10, 12, [8, 14], 14), (10, 13, [], 11)])
def test_refine_border(spark, left, right, gaps, want):
    df = spark.createDataFrame([(left, right, gaps)], "l int, r int, s array<int>")
    assert df.select(spans.refine_border(F.col("l"), F.col("r"), F.col("s"))).collect()[0][0] == want
    assert spans._refine(left, right, gaps) == want


def test_overlap_resolution():
    assert spans.drop_outer([["A", 0, 20], ["B", 5, 10]], []) == [["B", 5, 10]]
    assert spans.drop_inner([["A", 0, 20], ["B", 5, 10]]) == [["A", 0, 20]]
    assert len(spans.drop_outer([["A", 0, 5], ["B", 0, 5]], [])) == 2
    assert spans.drop_inner([["A", 0, 5], ["B", 0, 5]]) == [["A", 0, 5]]
    assert spans.drop_inner([["A", 0, 10], ["B", 6, 20]]) == [["A", 0, 8], ["B", 9, 20]]


def test_adjacent_and_interval_scores(spark):
    df = spark.createDataFrame([("c", "A", 0, 4), ("c", "A", 5, 9), ("c", "A", 12, 15)], SPAN)
    got = sorted((r.start_pos, r.end_pos) for r in spans.merge_adjacent_spans(df).collect())
    assert got == [(0, 9), (12, 15)]
    a, b = spark.createDataFrame([("c", "A", 0, 10)], SPAN), spark.createDataFrame([("c", "A", 5, 20)], SPAN)
    assert [(r.inter, r.hull) for r in spans.interval_pairs(a, b).collect()] == [(5, 20)]


def test_islands_and_tags(spark):
    rows = [(1, i, lab, 0.5) for i, lab in enumerate("AAOAB")]
    df = spark.createDataFrame(rows, "k int, o int, label string, conf double")
    got = sequence.label_islands(df, "k", ["o"], "label", "conf").orderBy("island").collect()
    assert [r.label for r in got] == ["A", "O", "A", "B"]
    tags = sequence.iob_tags(df, "k", ["o"], "label").orderBy("o").collect()
    assert [r.tag for r in tags] == ["B-A", "I-A", "O", "B-A", "B-B"]
    assert [r.confidence for r in sequence.aggregate_confidence(sequence.label_islands(df, "k", ["o"], "label", "conf"), "prod").orderBy("island").collect()] == [0.25, 0.5, 0.5, 0.5]


def test_propagated_labels(spark):
    df = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate([(0, 0), (0, 3), (3, 5), (0, 2), (0, 0)])], "k int, o int, start int, end int")
    got = sequence.propagate_labels(df, "k", ["o"], F.array(F.lit(7), F.lit(9))).orderBy("o").collect()
    assert [r.piece_label for r in got] == [-100, 7, 7, 9, -100]


def test_offsets_to_io_against_python(spark):
    text = "ab  cd\nef gh\n\nij"
    cards = spark.createDataFrame([("c", text), ("d", None), ("e", "")], "card string, transcription string")
    s = spark.createDataFrame([("c", "T", 4, 9), ("c", "U", 8, 12), ("c", "V", 14, 16)], SPAN)
    got = [(r.token, r.label) for r in sequence.offsets_to_io(cards, s).where("card = 'c'").orderBy("seg", "tok_ord").collect()]
    assert got == [("ab", "O"), ("cd", "T"), ("[LF]", "T"), ("ef", "T"), ("f", "U"), ("gh", "U"), ("[LF]", "O"), ("[LF]", "O"), ("ij", "V")]


def test_token_offsets_point_at_the_tokens(spark):
    text = "  one two\tone\n\nthree é one "
    cards = spark.createDataFrame([("c", text)], "card string, transcription string")
    got = sequence.token_offsets(cards).orderBy("tok_ord").collect()
    assert [r.token for r in got] == text.split() and all(text[r.start_pos : r.end_pos] == r.token for r in got)


def align_by_hand(lines, fields, threshold=0.8, max_lines=5):
    """The first aligner of one card, said plainly: every order of every subset is measured."""
    rate = lambda h, r: brute(h.lower(), r.lower()) / len(r) if r else 9.0
    groups, out = {}, []
    for line in lines:
        found = align.candidate_fields([v for _, v in fields], line[1])
        if found:
            groups.setdefault(min(found, key=lambda k: (rate(line[1], fields[k][1]), k)), []).append(line)
    for k, own in groups.items():
        ref = fields[k][1]
        orders = [p for n in range(1, len(own) + 1) for c in itertools.combinations(own, n) for p in itertools.permutations(c)] if len(own) <= max_lines else []
        best = min(orders, key=lambda p: rate(" ".join(t for _, t in p), ref), default=())
        if not best or rate(" ".join(t for _, t in best), ref) >= 1:
            continue
        found = align.place_field(list(best), ref)
        cut = " ".join(next(t[a - s : b - s] for s, t in best if s <= a < s + len(t)).strip() for a, b in found)
        if found and rate(cut, ref) < threshold:
            out += [(fields[k][0], a, b) for a, b in found]
    return out


def test_aligner_against_plain_python(spark):
    rnd = random.Random(5)
    words = ["Novák", "Jan", "Dějiny", "města", "Brno", "1950", "sešit", "řada", "Žďár", "über", "knihy"]
    some = lambda a, b: " ".join(rnd.choices(words, k=rnd.randint(a, b)))
    noise = lambda t: "".join(rnd.choice("xyz") if rnd.random() < 0.08 else c for c in t)
    cards, labels, links, want = [], [], [], {}
    for i in range(30):
        fields = [(name, some(1, 4)) for name in ("Author", "Title", "Date")]
        lines = [noise(w) for _, v in fields for w in ([v] if rnd.random() < 0.6 else v.split(" ", 1))] + [some(1, 2)]
        text = "\n".join(lines) + "\n"
        cards.append((f"c{i}", text))
        labels += [(f"r{i}", name, v, k) for k, (name, v) in enumerate(fields)]
        links.append((f"c{i}", f"r{i}"))
        placed, at = [], 0
        for line in lines:
            if len(line) > 1:
                placed.append((at, line))
            at += len(line) + 1
        spans_ = sorted([[lab, a, b] for lab, a, b in align_by_hand(placed, fields)], key=lambda x: (x[1], x[2], x[0]))
        want[f"c{i}"] = sorted(map(tuple, (x for x in spans.drop_outer(spans_, [k for k, ch in enumerate(text) if ch == " "]) if x[2] > x[1])))
    texts = spark.createDataFrame(cards, "card string, transcription string")
    got = align.align_cards(spark.createDataFrame(links, "card string, db_id string"), linkage.card_lines(texts), spark.createDataFrame(labels, "db_id string, label string, text string, label_ord int"), texts)
    have = {}
    for r in got.collect():
        have.setdefault(r.card, []).append((r.label, r.start_pos, r.end_pos))
    assert {k: sorted(v) for k, v in have.items()} == {k: v for k, v in want.items() if v} and sum(map(len, have.values())) > 30


def test_distance_beyond_ascii(spark):
    pairs = [("Žďár", "Zdar"), ("", "ab"), ("über", "ueber"), ("Řada", "řada"), ("日本", "日本語")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(distance.cer(F.col("a"), F.col("b"))).collect()] == [brute(a.lower(), b.lower()) / len(b) for a, b in pairs]
    assert [r[0] for r in df.select(distance.infix_udf()("a", "b")).collect()] == [distance.infix_distance(a, b) for a, b in pairs]


def test_match_score_against_all_pairs(spark):
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choices("abcde ", k=n))
    vals = [(f"r{i}", some(rnd.randint(2, 20))) for i in range(12)]
    lines = [("c", k, v[: rnd.randint(3, 20)] + some(rnd.randint(0, 3))) for k, (_, v) in enumerate(vals * 2)] + [("c", 99, some(15))]
    df = linkage.records_match_score(
        spark.createDataFrame([("c", r) for r, _ in vals] + [("c", "none")], "card string, db_id string"), spark.createDataFrame(lines, "card string, line_no int, line string"), spark.createDataFrame(vals, "db_id string, text string")
    )
    want = {r: sum(len(x) >= 4 and distance.infix_distance(x, v) < 0.3 * min(len(x), len(v)) for _, _, x in lines) for r, v in vals if len(v) >= 4}
    assert {r.db_id: r.n_matched for r in df.collect()} == want


def test_infix_distances_at_once(spark):
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choices("abcdeě𝒜 ", k=n))
    texts = [some(n) for n in [1, 2, 63, 64, 64, 0, *(rnd.randint(1, 40) for _ in range(60)), 200]]
    pats = [t for t in texts if 0 < len(t) <= 64]
    of, within = (np.array(x) for x in zip(*((i, k) for i, p in enumerate(pats) for k, t in enumerate(texts) if len(p) <= len(t))))
    got = distance.infix_distances(pats, texts, of, within)
    assert got.tolist() == [distance.infix_distance(pats[i], texts[k]) for i, k in zip(of, within)]


def test_match_score_measures_pairs_at_once(spark):
    line = "abcdefghij" * 9  # longer than a word of bits
    cards = [("c", 0, line), ("c", 1, "xyz abc"), ("c", 2, "xyz abd qqqq"), ("d", 0, "klmn")]
    vals = [("r", line[:80] + "x"), ("r", "xyz abc"), ("s", "nmlk"), ("s", "klmo")]
    pairs = spark.createDataFrame([(c, r) for c in "cd" for r in "rs"], "card string, db_id string")
    tables = spark.createDataFrame(cards, "card string, line_no int, line string"), spark.createDataFrame(vals, "db_id string, text string")
    got = {(r.card, r.db_id): r.n_matched for r in linkage.records_match_score(pairs, *tables).collect()}
    assert got == {("c", "r"): 3, ("c", "s"): 0, ("d", "r"): 0, ("d", "s"): 1}


def test_index_search_against_all_terms(spark):
    rnd = random.Random(6)
    words = ["der", "und"] * 40 + [f"w{i}" for i in range(30)]
    docs = [(f"d{i:02}", " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(60)] + [("dd", None), ("de", "")]
    asked = [(f"q{i}", " ".join(rnd.choices(words, k=4))) for i in range(12)] + [("qf", "der und"), ("qn", None), ("qx", "nowhere")]
    d, q = spark.createDataFrame(docs, "db_id string, text string"), spark.createDataFrame(asked, "card string, t string")
    runs = [{(r.card, r.db_id, r.score, r["rank"]) for r in linkage.index_search(q, d, "card", F.col("t"), "db_id", F.col("text"), 3, share).collect()} for share in (0.05, 1.0)]
    assert runs[0] == runs[1] and {r[0] for r in runs[0]} >= {"qf"}


def test_index_search_writes_no_pairs_that_share_a_term(spark, monkeypatch):
    docs = [(f"d{i:04}", f"w{i % 150} v{i % 147} x{i}") for i in range(1500)]
    d, q = spark.createDataFrame(docs, "db_id string, text string"), spark.createDataFrame([(f"q{i:04}", t) for i, (_, t) in enumerate(docs)], "card string, t string")
    sizes, write = [], linkage.materialize
    monkeypatch.setattr(linkage, "materialize", lambda df: sizes.append((out := write(df)).count()) or out)
    monkeypatch.setattr(linkage, "BLOCK_DOCS", 400, raising=False)
    best = {r.card: r.db_id for r in linkage.index_search(q, d, "card", F.col("t"), "db_id", F.col("text"), 3, 0.1).where("rank = 1").collect()}
    assert best == {f"q{i:04}": f"d{i:04}" for i in range(1500)} and max(sizes) <= 3 * len(docs)


def test_masks_and_their_signs(spark):
    texts = spark.createDataFrame([("c", "abcdefgh"), ("d", "xy")], "card string, transcription string")
    s = spark.createDataFrame([("c", "Title", 1, 3), ("c", "ID", 6, 7)], SPAN)
    got = spans.mask_signs(s, texts)
    assert {r.card: r["mask"] for r in got.collect()} == {"c": "02200090", "d": "00"}
    assert {(r.card, r.start_pos, r.end_pos, r.label) for r in spans.unmasked(got).collect()} >= {("c", 1, 3, "Title"), ("c", 6, 7, "ID"), ("d", 0, 2, "O")}


def test_given_tokens_are_found_in_order(spark):
    texts = spark.createDataFrame([("c", "one two, one")], "card string, transcription string")
    toks = spark.createDataFrame([("c", i, w) for i, w in enumerate(["one", "two", "missing", "[LF]", ",", "one"])], "card string, tok_ord int, token string")
    got = [(r.token, r.start_pos, r.end_pos) for r in sequence.found_offsets(texts, toks).orderBy("tok_ord").collect()]
    assert got == [("one", 0, 3), ("two", 4, 7), ("missing", None, None), (",", 7, 8), ("one", 9, 12)]


def test_predicted_spans(spark):
    cards = spark.createDataFrame([("c", "aa bb x"), ("d", None)], "card string, transcription string")
    words = inference.predict_words(cards, lambda ws: [("O", 1.0) if w == "x" else ("T", 0.5) for w in ws])
    assert [(r.label, r.n, r.confidence) for r in inference.predicted_spans(words, "prod").collect()] == [("T", 2, 0.25)]
    assert inference.predicted_spans(words, "prod", 0.3).count() == 0


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "t string, p string")
    assert metrics.classification_report(df, "t", "p").count() == 0
    full = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), (None, "B")], "t string, p string")
    got = {r.kind: r for r in metrics.classification_report(full, "t", "p").collect()}
    assert got["A"].recall == 0.5 and got["accuracy"].f1 == 0.5 and got["-"].support == 1
