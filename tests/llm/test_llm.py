import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardloom.llm import canonical, mixing, name_variants, ocr_repair, packing, shared_spans, soft_linkage

DOC = "doc_id long, text string"


def brute_stretches(docs, n):
    seen = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(d)
    out = set()
    for d, t in docs:
        cur = None
        for i in range(len(t or "") - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                if cur and i <= cur[1]:
                    cur = (cur[0], i + n)
                else:
                    out |= {(d, *cur)} if cur else set()
                    cur = (i, i + n)
        out |= {(d, *cur)} if cur else set()
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_spans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choices("abcdefgh ěš", k=k))
    parts = [text(rnd.randint(15, 90)) for _ in range(6)]
    docs = [(1, None), (2, ""), (3, "short"), (4, "a" * 150), (5, "a" * 90)]
    docs += [(10 + i, "".join(text(rnd.randint(0, 40)) + rnd.choice(parts) for _ in range(rnd.randint(1, 6)))) for i in range(25)]
    docs += [(50, docs[10][1]), (51, docs[10][1]), (52, parts[0] + parts[1]), (53, parts[0] + parts[1])]
    got = {tuple(r) for r in shared_spans.shared_spans(spark.createDataFrame(docs, DOC).withColumn("s", F.lit(1)), 30).collect()}
    assert got == brute_stretches(docs, 30)


def test_shared_spans_of_nothing(spark):
    assert shared_spans.shared_spans(spark.createDataFrame([], DOC)).count() == 0


def test_canonical_forms(spark):
    cases = {
        "Přepr­acovaný úvod": "Přepracovaný úvod",
        "Stаrý rоzhovor": "Starý rozhovor",
        "Ｄｅｒ Band": "Der Band",
        "Dětský": "Dětský",
        "öﬀnet": "öffnet",
        "Летний роман": None,
        "obraz o λ-záření": None,
        "пеcен народных": "песен народных",
        "plain": None,
        "": None,
    }
    df = spark.createDataFrame([(k, k) for k in cases] + [("null", None)], "k string, canon string")
    got = {r.k: r for r in canonical.canonicalize(df, "canon").collect()}
    for text, want in cases.items():
        assert got[text].is_disguised == (want is not None), text
        assert got[text].canon == (want if want is not None else text)
    assert got["null"].canon is None and not got["null"].is_disguised


def errors_between(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(p + (x != y), d[j] + 1, d[j - 1] + 1)
    return d[-1]


def test_automaton_gives_all_words_two_errors_away():
    rnd = random.Random(1)
    some = lambda a, b: "".join(rnd.choices("abc", k=rnd.randint(a, b)))
    words = sorted({some(1, 9) for _ in range(500)} | {"a" * 12, "ab" * 7})
    front, rear = ocr_repair.Trie(words), ocr_repair.Trie(words, back=True)
    for word in [some(1, 10) for _ in range(300)] + ["a" * 13, "ab" * 7]:
        assert front.near(word) | rear.near(word) == {v for v in words if errors_between(word, v) <= 2}


def test_ways_between_words():
    assert list(ocr_repair.scripts("rnotor", "motor", 1)) == [[(0, "rn", "m")]]
    assert [(2, "1", "i"), (4, "0", "o")] in list(ocr_repair.scripts("kn1h0", "kniho"))
    assert not list(ocr_repair.scripts("abcdef", "uvwxyz"))


def test_words_too_rare_to_be_meant_are_not_walked(monkeypatch):
    rnd = random.Random(13)
    some = lambda: "".join(rnd.choices("abcd", k=rnd.randint(3, 6)))
    known = pd.DataFrame([(w, rnd.choice([4, 13, 14, 33, 34, 90])) for w in sorted({some() for _ in range(150)})], columns=["word", "n"])
    asked = pd.DataFrame([(w, rnd.choice([1, 2, 3, 4, 5, 200])) for w in sorted({some() for _ in range(80)})], columns=["word", "n"])
    walked = []

    class Spy(ocr_repair.Trie):
        def __init__(self, words, back=False):
            super().__init__(words, back)
            self.words = words

        def near(self, word):
            walked.append((word, self.words))
            return super().near(word)

    monkeypatch.setattr(ocr_repair, "Trie", Spy)
    got = {(r.word, r.meant) for r in ocr_repair.look_up(asked, known).itertuples()}
    n_of, least = dict(zip(known["word"], known["n"])), {w: 4 + 10 * (n - 1) for w, n in zip(asked["word"], asked["n"])}
    far = lambda w: 1 if len(w) <= 4 else 2
    # a pair may also be two characters for one, so the ways are asked, not the distance
    assert got == {(w, v) for w in least for v in n_of if v != w and n_of[v] >= least[w] and errors_between(w, v) <= 2 and list(ocr_repair.scripts(w, v, far(w)))}
    assert walked and all(n_of[v] >= min(14, least[w]) for w, words in walked for v in words)


def test_a_kind_of_error_is_judged_by_its_own_words(spark):
    rnd = random.Random(10)
    some = lambda k: "".join(rnd.choices("bdghjkpqstvwxz", k=k))
    often = [f"{some(4)}o{some(4)}" for _ in range(50)]
    seldom = [f"{some(4)}äö{some(4)}" for _ in range(3)]
    shape = f"{some(5)}i{some(4)}"
    wrong = {w.replace("o", "ß"): (w, [4]) for w in often} | {w.replace("äö", "ñ"): (w, [4]) for w in seldom} | {shape.replace("i", "1"): (shape, [5])}
    stray = {some(3) + "u" + w[4:] for w in often[:2]}
    rows = [(w, 200) for w in [*often, *seldom, shape]] + [(w, 1) for w in {*wrong, *stray}]
    df = spark.createDataFrame(rows, "word string, n long")
    near = ocr_repair.near_words(df, df)
    got = {r.word: (r.meant, r.places) for r in ocr_repair.misreadings(near, ocr_repair.error_kinds(near, df)).collect()}
    assert got == wrong


def test_noise_of_a_small_collection(spark):
    rnd = random.Random(8)
    words = ["dodatek", "dlouhý", "obsahuje", "mezitím", "rejstřík", "starý", "rozbor", "knihách", "obraz", "román", "protokol", "soupis"]
    some = lambda k: " ".join(rnd.choices(words, k=k))
    rows = [(f"A/{i}", f"VELKÁ KNIHOVNA V MĚSTĚ\n{some(5)}\n{some(4)} potvr-\nzuje {some(4)}\n- 1 -\n\n") for i in range(80)]
    bad = [w.replace("o", "0", 1) for w in words if "o" in w]
    rows += [(f"A/9{i}x", f"VELKÁ KNIH0VNA V MĚSTĚ   {i}\nMezitím {w} {some(4)}\n(2)") for i, w in enumerate(bad)]
    rows += [("A/x", None), ("A/y", ""), ("A/z", "  \n"), rows[0]]
    df = spark.createDataFrame(rows, "card string, transcription string")
    got = {tuple(r) for r in ocr_repair.find_noise(df).collect()}
    assert {g for g in got if g[0] == "A/0"} == {("A/0", 0, "header"), ("A/0", 2, "hyphen"), ("A/0", 4, "page_no")}
    assert {g for g in got if g[0] == "A/90x"} == {("A/90x", 0, "header"), ("A/90x", 1, "misread"), ("A/90x", 2, "page_no")}
    # a batch is judged as within the whole, by what was learned of it
    learned = ocr_repair.learn(df)
    part = df.where("card in ('A/90x', 'A/3', 'A/y')")
    assert {tuple(r) for r in ocr_repair.find_noise(part, learned=learned).collect()} == {g for g in got if g[0] in ("A/90x", "A/3", "A/y")}
    assert ocr_repair.find_noise(df.limit(0)).count() == 0
    text = {r.card: r.text for r in ocr_repair.repaired(df).collect()}
    assert " potvrzuje " in text["A/0"] and "VELKÁ" not in text["A/0"] and text["A/90x"].startswith("Mezitím dodatek ")


def test_names(spark):
    names = ["Novotný, Božena", "Novotný, B.", "Božena Novotný", "NOVOTNÝ, Božena", "Novotný, Boža", "Novottný, Božena", "Novotný, Karel", "Dr. Karel Novotný", "Dvořáček, Karel", None, " "]
    rnd = random.Random(9)
    surname = lambda: "".join(rnd.choice("bdfghklmprst") + rnd.choice("aeiou") for _ in range(4)).capitalize() + "ek"
    others = [f"{surname()}, {g}" for g in ["Božena", "Karel", "Jan", "Emil", "B.", "Boža", "K."] * 40]
    df = spark.createDataFrame([(n, None) for n in names + others + names], "author string, publisher string")
    got = {(r.name_a, r.name_b) for r in name_variants.variant_pairs(name_variants.name_clusters(df)).collect()}
    bozena = sorted(n for n in names[:6])
    assert {(a, b) for i, a in enumerate(bozena) for b in bozena[i + 1 :]} <= got
    assert tuple(sorted(["Novotný, Karel", "Dr. Karel Novotný"])) in got
    assert not any("Karel" in a + b and "Bož" in a + b for a, b in got)


def test_the_cosine_decides_where_the_parts_say_nothing(spark):
    names = ["Hokalalák, Hynek", "Hokalalák, Joesf", "Hokalalák, H.", "Pesumapek, Josef", "Peumapek, Josef", "Corohenin, Vusovin", "Corhoennin, Vusovin"]
    rnd = random.Random(3)
    some = lambda: "".join(rnd.choice("bdfghklmprst") + rnd.choice("aeiou") for _ in range(4)).capitalize() + "ek"
    others = [f"{some()}, {g}" for g in ["Hynek", "Josef", "H.", "Emil"] * 60]
    df = spark.createDataFrame([(n, None) for n in names + others], "author string, publisher string")
    parsed = name_variants.parsed_names(df, ("author",))
    pairs = name_variants.similar_pairs(parsed)
    name = {r.id: r.name for r in parsed.collect()}
    linked = {}
    for how, cosine in (("on", F.col("cosine")), ("off", F.lit(1.0))):
        sims = pairs.select("a", "b", name_variants.similarity(cosine, F.col("verdict")).alias("sim")).where("sim != 0")
        linked[how] = {name[r.id]: r.cluster for r in name_variants.average_linkage(parsed.select("id"), sims, 0.2).collect()}
    same = lambda how, a, b: linked[how][a] == linked[how][b]
    assert same("on", names[0], names[2]) and same("on", names[3], names[4]) and not same("on", names[0], names[1])
    groups = lambda how: len(set(linked[how].values()))
    assert groups("off") < groups("on")  # without it, names that only look a little alike are linked


def moved_rows(spark):
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}


def test_pairs_that_only_share_a_gram_are_not_shuffled(spark, monkeypatch):
    rnd = random.Random(12)
    some = lambda: "".join(rnd.choice("dkl") + rnd.choice("aeo") for _ in range(5)).capitalize()
    names = [f"{some()}, {g}" for g in ("Hynek", "Josef", "H.", "Emil") for _ in range(450)]
    rows = {}
    for n in (600, 1800):
        parsed = name_variants.materialize(name_variants.parsed_names(spark.createDataFrame([(x, None) for x in names[::1800 // n]], "author string, publisher string"), ("author",)))
        before = moved_rows(spark)
        pairs = {(r.a, r.b) for r in name_variants.similar_pairs(parsed, 0.8).collect()}
        after = moved_rows(spark)
        rows[n] = sum(x for k, x in after.items() if k not in before)
        assert pairs
    assert rows[1800] < 4 * rows[600], rows  # three times the names
    monkeypatch.setattr(name_variants, "MEMBERS", 1)
    assert {(r.a, r.b) for r in name_variants.similar_pairs(parsed, 0.8).collect()} == pairs


def test_average_linkage_against_one_by_one(spark):
    rnd = random.Random(4)
    ids = list(range(12))
    sims = {(a, b): round(rnd.uniform(-0.5, 1), 3) for a in ids for b in ids if a < b and rnd.random() < 0.5}
    got = {r.id: r.cluster for r in name_variants.average_linkage(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, sim double"), 0.2).collect()}
    groups = [{i} for i in ids]
    mean = lambda x, y: sum(sims.get((min(a, b), max(a, b)), 0) for a in x for b in y) / (len(x) * len(y))
    while True:
        m, i, j = max(((mean(x, y), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=(0, 0, 0))
        if m < 0.2 or not m:
            break
        groups[-i] |= groups[-j]
        del groups[-j]
    want = {frozenset(g) for g in groups}
    assert {frozenset(k for k in got if got[k] == c) for c in set(got.values())} == want


def test_packing_keeps_items_whole_and_bins_within(spark):
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 101, 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    bins = [here for here, times in packing.pack(counts, 100) for _ in range(times)]
    assert sorted(s for b in bins for s in b) == sorted(sizes.tolist()) and max(map(sum, bins)) <= 100
    assert len(bins) <= 1.02 * np.ceil(sizes.sum() / 100)
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 600), (5, "one two three")], DOC)
    kinds = spark.createDataFrame([("k", 256)], "container string, capacity_tokens int")
    rows = packing.fill_containers(docs, kinds).collect()
    assert {r.doc_id for r in rows} == {1, 4, 5} and all(r.piece == 0 for r in rows if r.doc_id != 4)
    assert [tuple(r)[2:] for r in packing.fill_checks(packing.fill_containers(docs, kinds), docs, kinds).select("container", "n_docs", "needless_cuts", "not_covered", "too_full").collect()] == [(0, 0, 0)]
    assert packing.fill_containers(docs.limit(0), kinds).count() == 0
    four = sorted((r.start_token, r.n_tokens) for r in rows if r.doc_id == 4)
    assert all(a + n == b for (a, n), (b, _) in zip(four, four[1:])) and [n for _, n in four[:-1]] == [256] * (len(four) - 1)


def test_knapsack_is_optimal():
    rnd = random.Random(6)
    for _ in range(1500):
        lengths = sorted(rnd.sample(range(1, rnd.choice([8, 40, 200])), rnd.randint(1, 6)))
        counts = [rnd.randint(0, rnd.choice([1, 3, 30])) for _ in lengths]
        budget = rnd.randint(0, sum(n * c for n, c in zip(lengths, counts)) + 3)
        reach = 1
        for n, c in zip(lengths, counts):
            for _ in range(c):
                reach |= reach << n
        take = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(take, counts))
        assert sum(n * k for n, k in zip(lengths, take)) == (reach & ((2 << budget) - 1)).bit_length() - 1


def test_mix_holds_shares_and_repeats(spark):
    docs = [(i, "word " * (5 + i % 7), "a" if i % 3 else "b") for i in range(300)] + [(999, "x", None), (998, None, "a")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets)
    got = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert abs(got["a"].actual_share - 5 / 9) < 0.01 and abs(got["b"].actual_share - 4 / 9) < 0.01 and got["none"].n_tokens == 0
    assert mixed.where("source = 'a' and copies > 1 or copies > 2").count() == 0


def test_blocks_are_solved_exactly():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = 3
        pro, con, pull, rho = rng.uniform(0, 5, n), rng.uniform(0.1, 5, n), rng.uniform(0, 1, n), np.full(n, 2.0)
        x = soft_linkage.solve_blocks(np.array([0]), pro, con, pull, rho)
        f = lambda y: float(np.sum(pro * (1 - y) ** 2 + con * y**2 + rho / 2 * (y - pull) ** 2))  # noqa: B023, E731
        grid = [np.array(p) for p in np.ndindex(21, 21, 21) if sum(p) <= 20]
        assert x.sum() <= 1 + 1e-6 and f(x) <= min(f(p / 20) for p in grid) + 1e-6


def test_linkage_tells_editions_apart(spark):
    rec = [("000000001", "Starý obraz dávných sporů", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", "120 s.", None, None, "BK1"), ("000000002", "Starý obraz dávných sporů", None, "Novák, Jan", "Brno, Verlag Dimov", "1910", "130 s.", None, None, "BK2"), ("000000003", None, None, None, None, None, None, None, None, None)]
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    text = "Novák, Jan\nStarý 0braz dávných sporů /\nBrno, Dimov {}\n{} s."
    cards = [("A/1", text.format(1901, 120)), ("A/2", text.format(1910, 130)), ("A/3", text.format(1955, 99)), ("A/4", None), ("A/5", text.format(1901, 120)), ("A/1", text.format(1901, 120))]
    got = {r.card: r.db_id for r in soft_linkage.link(spark.createDataFrame(cards, "card string, transcription string"), spark.createDataFrame(rec * 2, cols)).collect()}
    assert got == {"A/1": "000000001", "A/2": "000000002", "A/5": "000000001"}


@pytest.mark.parametrize(
    ("title", "numbers"),
    [
        ("Starý #### dávných sporů", "1901\n120 s."),
        ("##### obraz dávných sporů", "1901"),
        ("Starý #### dávných sporů", ""),
        ("Starý #### dávných #####", "\n120 s."),
    ],
)
def test_linkage_without_one_of_the_first_title_words(spark, title, numbers):
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    rec = [("000000001", "Starý obraz dávných sporů", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", "120 s.", None, None, "BK1")]
    rec += [(f"00000001{i}", f"Jiná kniha o městě číslo {i}", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", f"{200 + i} s.", None, None, f"BX{i}") for i in range(8)]
    text = f"Novák, Jan\n{title.replace('#', 'x')} /\nBrno, Dimov {numbers}"
    got = soft_linkage.link(spark.createDataFrame([("A/1", text)], "card string, transcription string"), spark.createDataFrame(rec, cols)).collect()
    assert [(r.card, r.db_id) for r in got] == [("A/1", "000000001")]


def test_candidates_do_not_depend_on_how_frequent_keys_are(spark, monkeypatch):
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    rec = [("000000001", "Starý obraz dávných sporů", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", "120 s.", None, None, "BK1"), ("000000002", None, None, "Novák, Jan", "Brno, Verlag Dimov", "1901", None, None, None, "BK2")]
    rec += [(f"00000001{i}", f"Jiná kniha o městě číslo {i}", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", f"{119 + i} s.", None, None, f"BX{i}") for i in range(4)]
    titles = ["Starý obraz dávných sporů", "xxxxx xxxxx xxxxxxx xxxxx", "Jiná kniha o městě číslo 3"]
    cards = [(f"A/{i}", f"Novák, Jan\n{t} /\nBrno, Verlag Dimov 1901{pages}") for i, (t, pages) in enumerate((t, p) for t in titles for p in ("", "\n120 s.", "\n500 s."))]
    c, r = spark.createDataFrame(cards, "card string, text string"), spark.createDataFrame(rec, cols)
    got = {}
    for most in (10**9, 12, 0):  # no key is split, some are, all are
        monkeypatch.setattr(soft_linkage, "HOT_PAIRS", most)
        rows = [(x.card, x.db_id) for x in soft_linkage.candidates(c, r).collect()]
        assert len(rows) == len(set(rows))
        got[most] = set(rows)
    assert ("A/4", "000000001") in got[10**9] and ("A/0", "000000002") in got[10**9]
    assert got[0] == got[12] == got[10**9]


def test_only_pairs_that_may_hold_are_scored(spark, monkeypatch):
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    titles = ["Starý obraz dávných sporů", "Jiná kniha o městě", "Město město a kniha", None]
    rec = [(f"{i:09}", titles[i % 4], "malé spisy" if i % 3 else None, "Novák, Jan" if i % 5 else None, "Brno, Verlag Dimov", f"{1901 + i % 2}", f"{119 + i % 3} s." if i % 7 else None, None, "2. vyd." if i % 4 == 1 else None, f"BK{i}") for i in range(40)]
    shown = ["Starý obraz dávných sporů", "Starý xxxxx dávných sporů", "Jiná kniha", "Město a kniha", "obraz sporů"]
    text = "Novak, Jan\n{} /\nmalé spisy\n2. vyd.\nBrno, Dimov {}\n{} s.\nBK{}"
    cards = [(f"A/{i}", text.format(shown[i % 5], 1901 + i % 2, 119 + i % 3, i)) for i in range(20)] + [("B/1", text.format(shown[1], 1901, 119, 0))]
    c, r = spark.createDataFrame(cards, "card string, text string"), spark.createDataFrame(rec, cols)
    near, read_c, read_r = soft_linkage.near_pairs(c, r)
    near = soft_linkage.materialize(near)
    scored = {(x.card, x.db_id): x for x in soft_linkage.score(near, read_c, read_r).collect()}
    bounds = {(x.card, x.db_id): x for x in near.collect()}
    assert scored.keys() == bounds.keys()
    for k, x in scored.items():
        assert all(f <= m + 1e-9 for f, m in zip(x.f, bounds[k].most)) and all(a >= n - 1e-9 for a, n in zip(x.a, bounds[k].least)), k
    kept = soft_linkage.may_hold(near, np.array(soft_linkage.FOR), np.array(soft_linkage.AGAINST), 0.5).count()
    assert 0 < kept < len(scored)
    got = lambda: sorted(soft_linkage.link(c.withColumnRenamed("text", "transcription"), r.where("db_id < '000000008'")).collect())
    bounded = got()
    monkeypatch.setattr(soft_linkage, "may_hold", lambda near, *_: near)
    assert bounded and got() == bounded


def test_linkage_makes_keys_and_pairs_of_some_cards_at_once(spark, monkeypatch):
    rec = [(f"00000000{i}", f"Starý obraz dávných sporů {w}", None, "Novák, Jan", "Brno, Verlag Dimov", f"190{i}", f"12{i} s.", None, None, f"BK{i}") for i, w in enumerate(("lesa", "pole", "vody", "hory"))]
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    cards = [(f"A/{k}", f"Novák, Jan\nStarý obraz dávných sporů {w} /\nBrno, Dimov 190{i}\n12{i} s.") for k in range(6) for i, w in enumerate(("lesa", "pole", "vody", "xxxx"))]
    c, r = spark.createDataFrame([(f"{x}/{i}", t) for i, (x, t) in enumerate(cards)], "card string, transcription string"), spark.createDataFrame(rec, cols)
    tables, write = [], soft_linkage.materialize
    monkeypatch.setattr(soft_linkage, "materialize", lambda df: tables.append((df.columns, (out := write(df)).count())) or out)
    near = lambda: [n for columns, n in tables if {"most", "least"} <= {*columns}]
    whole, once = sorted(soft_linkage.link(c, r).collect()), near()
    tables.clear()
    for name, value in (("SLICE_CARDS", 6), ("SLICE_PAIRS", 1), ("LEAST_PAIRS", 1)):
        monkeypatch.setattr(soft_linkage, name, value)
    assert sorted(soft_linkage.link(c, r).collect()) == whole and len(whole) == 24
    assert len(once) == 1 and sum(near()) == once[0] and max(near()) < once[0]
    assert not any({"card", "key"} <= {*columns} for columns, _ in tables)


def test_linkage_has_one_python_worker_a_task(spark, monkeypatch):
    rec = [("000000001", "Starý obraz dávných sporů", None, "Novák, Jan", "Brno, Verlag Dimov", "1901", "120 s.", None, None, "BK1")]
    cols = "db_id string, title string, subtitle string, author string, publisher string, date_text string, pages string, series string, edition string, id string"
    plans, write = [], soft_linkage.materialize
    monkeypatch.setattr(soft_linkage, "materialize", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    cards = spark.createDataFrame([("A/1", "Novák, Jan\nStarý оbraz dávných sporů /\nBrno, Dimov 1901\n120 s.")], "card string, transcription string")  # with a Cyrillic letter
    assert [(x.card, x.db_id) for x in soft_linkage.link(cards, spark.createDataFrame(rec, cols)).collect()] == [("A/1", "000000001")]
    assert max(p.count("MapIn") for p in plans) == 1


def test_ties_pull_cards_of_one_description(spark):
    rows = [("A", "1", 3.0, 2.0, 7, False), ("B", "1", 2.0, 3.0, 7, False), ("C", "1", 2.0, 3.0, 8, False), ("B", "2", 1.0, 4.0, 7, False), ("D", "3", 1.0, 1.0, 0, True)]
    df = spark.createDataFrame(rows, "card string, db_id string, pro double, con double, same long, free boolean")
    got = {(r.card, r.db_id): r.x for r in soft_linkage.soft_values(df, close=1e-4).collect()}
    # A and B share one value, the others are as they would be alone
    assert got["A", "1"] == pytest.approx(0.5, abs=0.01) and got["B", "1"] == pytest.approx(got["A", "1"], abs=1e-3)
    assert got["C", "1"] == pytest.approx(0.4, abs=1e-3) and got["B", "2"] == pytest.approx(0.2, abs=1e-3) and got["D", "3"] == pytest.approx(0.5, abs=1e-3)


def test_weights_follow_the_labels():
    rng = np.random.default_rng(1)
    n = 4000
    right = rng.random(n) < 0.3
    agree = (rng.random((n, 9)) < 0.5) * 1.0
    agree[:, 4] = right  # the mark tells, the subtitle misleads
    agree[:, 8] = ~right
    differ = np.zeros((n, 9))
    w, v = soft_linkage.fit_weights(agree, differ, right.astype(float))
    assert w[4] > soft_linkage.FOR[4] and w[8] < soft_linkage.FOR[8] and (w >= 0).all() and np.allclose(v, soft_linkage.AGAINST)
    same = soft_linkage.fit_weights(np.zeros((0, 9)), np.zeros((0, 9)), np.zeros(0))
    assert np.allclose(same[0], soft_linkage.FOR)
