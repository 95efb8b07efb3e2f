"""Noise in text from scanned pages (problem 2).

Method: the words of all cards and of the titles of all records are counted; those in several of them are the
vocabulary. For every word a Levenshtein automaton for two errors, an error being a character too much, too few or
wrong, is run over vocabulary tries, forwards and backwards so that one half of the word has one error at most; that
gives every vocabulary word so near, two characters read for one or one for two among them. Candidates whose errors are of a kind the scanner makes
(signs of like shape, or kinds that many different words share) are ranked by the words beside them, then by number of
errors and frequency. Page furniture is found by how many cards of a collection, and of others, share a line; what is
left is joined over line ends and reflowed.

What is learned (vocabulary, kinds, headers) is a table of its own, `learn`, which can be made once from all there is
and passed in, so that a batch of cards is judged as it would be within the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.canonical import canonicalize
from cardloom.runtime import materialize

#: A vocabulary word stands in so many cards and records at least, whatever their number.
VOCAB_LEAST = 4
#: A word in n of them is a misreading of one that stands in VOCAB_LEAST + RATIO * (n - 1) or more.
RATIO = 10
#: A kind of error not among the shapes below is met in this share of the vocabulary words that hold its letters at least, and in KIND_LEAST of them.
KIND_SHARE = 0.05
KIND_WORDS = 40  # only words in so many cards and records are asked, as rarer ones, names among them, may not have been misread yet
KIND_LEAST = 3
#: A running header stands in this share of the cards of its collection at least, and so many times oftener than in others.
HEADER_SHARE = 0.04
HEADER_LIFT = 5
#: Words of a block of the vocabulary, held as a trie by one task; words looked up by one task.
BLOCK_WORDS, CHUNK_WORDS = 40_000, 8_000
# Signs of like shape, which scanners take for one another; pairs that look like one sign.
SHAPES = ("0oó", "1lií!|", "5sš§", "9gyý", "6b", "2zž", "@aá", "ceé", "ftř", "un", "bh", "yv", "ri", "üů")
SHAPE_PAIRS = (("rn", "m"), ("cl", "d"), ("li", "h"), ("lc", "k"), ("vv", "w"))
# The forms of page and side numbers; signs that break a word at a line end.
PAGE_NO = r"^(-\s*\d{1,4}\s*-|—\s*\d{1,4}\s*—|–\s*\d{1,4}\s*–|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|\d{1,3}|\d{1,3}\s*/\s*\d{1,3}|(str|list|fol|pag|p|f|S|s|Bl|Blatt|Seite|page|sheet)\.?\s*\d{1,4}\.?)$"
BREAKS = "-¬=—‐‑–"
_TOKEN = r"[\p{L}\p{N}@!§€$£|]+"


def _norm(line: Column) -> Column:
    return F.regexp_replace(F.upper(line), r"[^\p{L}]", "")


def flat_texts(cards: DataFrame) -> DataFrame:
    """coll, card, canon of cards that have a text; repeated rows count once. The collection is what stands before the first slash."""
    texts = cards.select("card", "transcription").where("card is not null and transcription is not null").distinct()
    return materialize(canonicalize(texts, "transcription", into="canon").select("card", "canon").withColumn("coll", F.substring_index("card", "/", 1)))


def header_forms(flat: DataFrame) -> DataFrame:
    """coll, forms: the letters of the lines that are running headers in a collection.

    Lines of the same words in any order count together: in 3 cards, HEADER_SHARE of the collection's and HEADER_LIFT
    times the share of the cards of collections where it isn't as frequent, at least. So a collection has at most (lines a card) / HEADER_SHARE.
    """
    split = flat.select("coll", "card", F.explode(F.split("canon", "\n")).alias("line"))
    parts = F.array_join(F.array_sort(F.filter(F.split(F.upper("line"), r"[^\p{L}]+"), lambda w: w != "")), " ")
    seen = split.select("coll", "card", _norm(F.col("line")).alias("norm"), parts.alias("bag")).where(F.length("norm") >= 8).distinct()
    norms = seen.groupBy("coll", "bag", "norm").agg(F.count("*").alias("n_norm"))
    bags = seen.groupBy("coll", "bag").agg(F.count_distinct("card").alias("n"))
    size = flat.groupBy("coll").agg(F.count_distinct("card").alias("n_cards"))
    total = size.agg(F.sum("n_cards").alias("n_all"))  # one row
    each = bags.join(size, "coll").withColumn("often", F.col("n") >= F.col("n_cards") * HEADER_SHARE)
    seldom = each.groupBy("bag").agg(F.sum(F.when(~F.col("often"), F.col("n")).otherwise(0)).alias("n_out"), F.sum(F.when(F.col("often"), F.col("n_cards")).otherwise(0)).alias("n_often"))
    both = each.where((F.col("n") >= 3) & F.col("often")).join(seldom, "bag").join(F.broadcast(total))
    lift = F.col("n") * (F.col("n_all") - F.col("n_often") + 1) >= HEADER_LIFT * F.col("n_out") * F.col("n_cards")
    return norms.join(both.where(lift).select("coll", "bag"), ["coll", "bag"], "left_semi").groupBy("coll").agg(F.sort_array(F.collect_set("norm")).alias("forms"))


def mark_lines(flat: DataFrame, forms: DataFrame) -> DataFrame:
    """Lines of the cards with their kind: card, line_no, line (canonical), kind of 'header', 'page_no', 'blank', 'text'.

    flat: as `flat_texts` gives them; forms: as `header_forms`.
    """
    lines = flat.join(forms, "coll", "left").select("card", "forms", F.posexplode(F.split("canon", "\n")).alias("line_no", "line"))
    near = lambda n: F.exists(
        F.col("forms"), lambda f: (F.abs(F.length(f) - F.length(n)) * 5 <= F.length(f)) & (F.levenshtein(n, f) * 5 <= F.length(f))
    )
    bare = F.trim("line")
    is_header = (F.length("line") >= 8) & F.coalesce(F.exists(F.array(_norm(F.col("line"))), near), F.lit(False))
    kind = F.when(bare == "", "blank").when(bare.rlike(PAGE_NO), "page_no").when(is_header, "header").otherwise("text")
    return lines.select("card", "line_no", "line", kind.alias("kind"))


def broken_lines(lines: DataFrame) -> DataFrame:
    """Text lines with where their words go on: hyphen (the last word does), tail (its rest), next_no, after_break."""
    w = Window.partitionBy("card").orderBy("line_no")
    text = lines.where("kind = 'text'").withColumn("next", F.lead("line").over(w)).withColumn("next_no", F.lead("line_no").over(w))
    ends = F.col("line").rlike(rf"\p{{L}}[{BREAKS}]\s*$")
    last = F.regexp_extract("line", rf"([\p{{L}}\p{{N}}@!§]+)[{BREAKS}]\s*$", 1)
    tail = F.regexp_extract("next", rf"^({_TOKEN})", 1)
    capital = (last == F.upper(last)) & (F.length(last) > 1)
    goes_on = ends & (tail.rlike(r"^[^\p{Lu}\p{N}]") | tail.rlike(r"^\p{N}+\p{Ll}") | (capital & tail.rlike(r"\p{Lu}")))
    hyphen = F.coalesce(goes_on, F.lit(False))
    text = text.withColumn("hyphen", hyphen).withColumn("tail", F.when(F.col("hyphen"), tail))
    return text.withColumn("after_break", F.coalesce(F.lag("hyphen").over(w), F.lit(False))).drop("next")


def words(text: DataFrame) -> DataFrame:
    """Words of text lines, broken ones joined: card, line_no, next_no, ord, word, cut (length on the first line)."""
    body = F.when(F.col("after_break"), F.regexp_replace("line", rf"^{_TOKEN}", "")).otherwise(F.col("line"))
    body = F.when(F.col("hyphen"), F.concat(F.regexp_replace(body, rf"[{BREAKS}]\s*$", ""), F.col("tail"))).otherwise(body)
    found = text.select("card", "line_no", "next_no", "hyphen", "tail", F.regexp_extract_all(body, F.lit(f"({_TOKEN})")).alias("w"))
    each = found.select("card", "line_no", "next_no", "hyphen", "tail", F.size("w").alias("n"), F.posexplode("w").alias("ord", "word"))
    broken = F.col("hyphen") & (F.col("ord") == F.col("n") - 1)
    cut = F.when(broken, F.length("word") - F.length("tail"))
    return each.where(F.col("word").rlike(r"\p{L}")).select("card", "line_no", "next_no", "ord", F.lower("word").alias("word"), cut.alias("cut"))


ERRORS = 2
_FAR = 5  # places of the word a state can look at; what is farther off is the same for a step
_states: list[tuple] = [()]
_ids: dict[tuple, int] = {(): 0}
_steps: dict[int, tuple[int, int]] = {}
_spent: dict[int, tuple[int, ...] | None] = {}


def _known(state: tuple) -> int:
    if state not in _ids:
        _ids[state] = len(_states)
        _states.append(state)
    return _ids[state]


def _next(state: int, vec: int, left: int, half: int) -> tuple[int, int]:
    """The state after one more vocabulary character, and by how much its base moves; (-1, 0) if none is left.

    A state is a set of (places of the word read, from a base on; errors). vec: which of the next places hold the character; left:
    places to the end; half: places to the half of the word, before which there is one error at most. Steps don't depend
    on the word and are kept for all.
    """
    best: dict[int, int] = {}

    def put(i: int, e: int) -> None:
        if e <= ERRORS and i <= left and not (e > 1 and i < half) and best.get(i, 9) > e:
            best[i] = e
            put(i + 1, e + 1)  # a character too much in the word

    for i, e in _states[state]:
        if i < left and vec >> i & 1:
            put(i + 1, e)
        put(i, e + 1)
        if i < left:
            put(i + 1, e + 1)
    if not best:
        return -1, 0
    base = min(best)
    return _known(tuple(sorted((i - base, e) for i, e in best.items()))), base


def _no_error_left(state: int, half: int) -> tuple[int, ...] | None:
    """The places a state can go on from if it may make no further error at once, so that only these letters need a look."""
    if all(e >= ERRORS or (e and i + 1 < half) for i, e in _states[state]):
        return tuple(i for i, _ in _states[state])
    return None


class Trie:
    """Words by their letters, from the front or from the back; '' at a node holds the word that ends there."""

    def __init__(self, words: list[str], back: bool = False):
        self.root, self.back = {}, back
        for word in words:
            node = self.root
            for ch in word[::-1] if back else word:
                node = node.setdefault(ch, {})
            node[""] = word

    def near(self, word: str) -> set[str]:
        """The words within ERRORS errors of `word` whose first error half (from this trie's side) has one at most."""
        w = word[::-1] if self.back else word
        n = len(w)
        half = n - n // 2 if self.back else n // 2
        masks: dict[str, int] = {}
        for i, ch in enumerate(w):
            masks[ch] = masks.get(ch, 0) | 1 << i
        start = _known(tuple((i, i) for i in range(ERRORS + 1) if i <= n and not (i > 1 and i < half)))
        found, todo, steps, states = set(), [(self.root, start, 0)], _steps, _states
        while todo:
            node, state, base = todo.pop()
            left, ahead = n - base, half - base
            if left <= 2 * ERRORS and "" in node and any(i == left for i, _ in states[state]):
                found.add(node[""])
            ahead = 0 if ahead < 0 else _FAR if ahead > _FAR else ahead
            key = state << 12 | (_FAR if left > _FAR else left) << 9 | ahead << 6
            only = _spent.get(state << 3 | ahead, 0)
            if only == 0:
                only = _spent[state << 3 | ahead] = _no_error_left(state, ahead)
            if only is None:
                children = [x for x in node.items() if x[0]]
            else:
                children = [(w[base + i], node[w[base + i]]) for i in only if i < left and w[base + i] in node]
            for ch, child in children:
                vec = (masks[ch] >> base & 31) if ch in masks else 0
                step = steps.get(key | vec)
                if step is None:
                    step = steps[key | vec] = _next(state, vec, min(left, _FAR), ahead)
                if step[0] >= 0:
                    todo.append((child, step[0], base + step[1]))
        return found


def scripts(read: str, was: str, errors: int = ERRORS, at: int = 0) -> Iterator[list[tuple[int, str, str]]]:
    """Ways from one word to the other: lists of (place, what was read, what it was)."""
    i = 0
    while i < min(len(read), len(was)) and read[i] == was[i]:
        i += 1
    if i == len(read) == len(was):
        yield []
    elif errors and abs(len(read) - len(was)) <= errors:
        for a, b in ((1, 1), (2, 1), (1, 2), (1, 0), (0, 1)):
            if i + a <= len(read) and i + b <= len(was):
                for rest in scripts(read[i + a :], was[i + b :], errors - 1, at + i + a):
                    yield [(at + i, read[i : i + a], was[i : i + b]), *rest]


def like_shape(read: str, was: str) -> bool:
    """Whether a scanner takes one for the other by their shape, whatever the texts say."""
    return any(len(read) == len(was) == 1 and read in g and was in g for g in SHAPES) or any((read, was) in ((a, b), (b, a)) for a, b in SHAPE_PAIRS)


def lexicon(counts: DataFrame, records: DataFrame | None) -> DataFrame:
    """word, n: in how many cards and records a word stands. counts: word, n of the cards; records: db_id and texts that
    are ordinary language, such as titles."""
    if records is None:
        return counts.select("word", "n")
    texts = [c for c in ("title", "subtitle", "series") if c in records.columns]
    rows = records.select("db_id", F.lower(F.concat_ws(" ", *texts)).alias("t")).where("db_id is not null").distinct()
    own = rows.select("db_id", F.explode(F.regexp_extract_all("t", F.lit(f"({_TOKEN})"))).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", "n").unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def look_up(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The rows of `near_words` for a block of words (word, n) and a block of the vocabulary (word, n)."""
    n_of = dict(zip(known["word"].tolist(), known["n"].tolist()))
    tries: dict[int, tuple[Trie, Trie] | None] = {}
    rows = []
    for word, n in zip(asked["word"].tolist(), asked["n"].tolist()):
        often = VOCAB_LEAST + RATIO * (n - 1)
        # the oftener a word is met, the fewer can be meant: those of too few cards are not walked
        tier = VOCAB_LEAST + RATIO * ((1 << n.bit_length() - 1) - 1)
        if tier not in tries:
            own = [v for v, k in n_of.items() if k >= tier]
            tries[tier] = (Trie(own), Trie(own, back=True)) if own else None
        if tries[tier] is None:
            continue
        front, rear = tries[tier]
        for v in sorted(front.near(word) | rear.near(word)):
            if v != word and n_of[v] >= often:
                ways = list(scripts(word, v, 1 if len(word) <= 4 else ERRORS))
                least = min(map(len, ways), default=0)
                if ways := [[{"at": a, "read": r, "was": w} for a, r, w in x] for x in ways if len(x) == least]:
                    rows.append((word, n, v, n_of[v], ways))
    return pd.DataFrame(rows, columns=["word", "n", "meant", "n_meant", "ways"])


def near_words(counts: DataFrame, words: DataFrame) -> DataFrame:
    """word, n, meant, n_meant, ways: all vocabulary words within two errors (one where a word has four letters or fewer) that stand often
    enough for the word to be their misreading, with the ways from one to the other.

    counts: word, n to be looked up; words: word, n of the lexicon. Both are cut into blocks that meet each other, each
    block of the vocabulary being a pair of tries in one task.
    """
    known = words.where((F.col("n") >= VOCAB_LEAST) & F.col("word").rlike(r"^\p{L}{2,}$"))
    asked = counts.where((F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    n_blocks, n_chunks = (-(-max(1, df.count()) // size) for df, size in ((known, BLOCK_WORDS), (asked, CHUNK_WORDS)))
    part = lambda n: F.pmod(F.xxhash64("word"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select(F.col("word").alias("w"), F.col("n").alias("n_w")).toDF("word", "n")  # other columns than those of the vocabulary
    left = asked.select("word", "n", part(n_chunks).alias("chunk"), every(n_blocks).alias("block")).repartition(n_blocks * n_chunks, "chunk", "block")
    right = known.select("word", "n", part(n_blocks).alias("block"), every(n_chunks).alias("chunk")).repartition(n_blocks * n_chunks, "chunk", "block")

    by = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
    return by.applyInPandas(look_up, "word string, n long, meant string, n_meant long, ways array<array<struct<at:int,read:string,was:string>>>")


def error_kinds(near: DataFrame, words: DataFrame) -> DataFrame:
    """read, was: the kinds of error that the scanner makes, beside those of like shape: how many vocabulary words are
    met misread so, against those that hold the letters."""
    one = near.where((F.size(F.get("ways", F.lit(0))) == 1) & (F.col("n_meant") >= KIND_WORDS)).select("meant", F.explode("ways").alias("w")).select("meant", F.col("w")[0]["read"].alias("read"), F.col("w")[0]["was"].alias("was"))
    tally = one.where("read != '' and was != ''").groupBy("read", "was").agg(F.count_distinct("meant").alias("n"))
    known = words.where((F.col("n") >= KIND_WORDS) & F.col("word").rlike(r"^\p{L}{2,}$"))
    place = F.sequence(F.lit(1), F.length("word"))
    bits = F.array_distinct(F.flatten(F.transform(place, lambda i: F.array(F.substring("word", i, 1), F.substring("word", i, 2)))))
    holds = known.select(F.explode(bits).alias("was")).groupBy("was").agg(F.count("*").alias("n_holds"))
    return tally.join(holds, "was").where((F.col("n") >= KIND_LEAST) & (F.col("n") >= KIND_SHARE * F.col("n_holds"))).select("read", "was")


@dataclass
class Learned:
    """What is known of a body of cards: words (word, n), kinds (read, was), forms (coll, forms)."""

    words: DataFrame
    kinds: DataFrame
    forms: DataFrame


def _card_words(flat: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lines = materialize(mark_lines(flat, forms))
    text = materialize(broken_lines(lines))
    each = words(text)
    return lines, text, each, materialize(each.groupBy("word").agg(F.count_distinct("card").alias("n")))


def learn(cards: DataFrame, records: DataFrame | None = None) -> Learned:
    """Vocabulary, kinds of error and running headers of all cards and records; no part of it depends on a batch."""
    flat = flat_texts(cards)
    forms = materialize(header_forms(flat))
    counts = _card_words(flat, forms)[3]
    known = materialize(lexicon(counts, records))
    return Learned(known, materialize(error_kinds(near_words(counts, known), known)), forms)


def misreadings(near: DataFrame, kinds: DataFrame) -> DataFrame:
    """Misread words: word, meant, n_meant, places (character positions in word), errors; all errors are of a known kind."""
    ways = near.select("word", "meant", "n_meant", F.posexplode("ways").alias("k", "way"))
    steps = ways.select("word", "meant", "n_meant", "k", F.size("way").alias("errors"), F.explode("way").alias("x")).select("word", "meant", "n_meant", "k", "errors", "x.*")
    shapes = [(a, b) for g in SHAPES for a in g for b in g if a != b] + [p for a, b in SHAPE_PAIRS for p in ((a, b), (b, a))]
    fixed = near.sparkSession.createDataFrame(shapes, "read string, was string")
    good = steps.join(F.broadcast(fixed.unionByName(kinds).distinct()), ["read", "was"])  # kinds are pairs of one or two letters
    whole = good.groupBy("word", "meant", "n_meant", "k", "errors").agg(F.sort_array(F.collect_list("at")).alias("places")).where(F.size("places") == F.col("errors"))
    return whole.groupBy("word", "meant", "n_meant", "errors").agg(F.min("places").alias("places"))


def _parts(cards: DataFrame, records: DataFrame | None, learned: Learned | None):
    flat = flat_texts(cards)
    forms = learned.forms if learned else materialize(header_forms(flat))
    lines, text, each, counts = _card_words(flat, forms)
    known = learned.words if learned else materialize(lexicon(counts, records))
    seen = known.select(F.col("word").alias("k"), F.col("n").alias("n_known"))
    asked = counts.join(seen, F.col("word") == F.col("k"), "left").select("word", F.greatest("n", F.coalesce("n_known", F.lit(0))).alias("n")) if learned else counts
    near = materialize(near_words(asked, known))
    kinds = learned.kinds if learned else error_kinds(near, known)
    return lines, text, each, materialize(misreadings(near, kinds))


def _chosen(each: DataFrame, wrong: DataFrame) -> DataFrame:
    """The misread words where they stand: card, line_no, next_no, ord, cut, word, meant, places.

    Where several words could be meant, the one seen most often beside the same neighbours is taken, then the one with
    fewer errors, the more frequent one, the first by letters.
    """
    one = wrong.groupBy("word").agg(F.count("*").alias("n"), F.first("meant").alias("meant"), F.first("places").alias("places"))
    hits = each.join(one, "word")
    clear = hits.where("n = 1").select("card", "line_no", "next_no", "ord", "cut", "word", "meant", "places")
    w = Window.partitionBy("card").orderBy("line_no", "ord")
    several = one.where("n > 1").select("word")
    cards = each.join(several, "word", "left_semi").select("card").distinct()
    placed = each.join(cards, "card", "left_semi").withColumns({"before": F.lag("word").over(w), "after": F.lead("word").over(w)})
    asked = placed.join(several, "word", "left_semi").join(wrong, "word")
    pairs = asked.select(F.col("before").alias("a"), F.col("meant").alias("b")).union(asked.select("meant", "after")).distinct()
    row = each.withColumn("b", F.lead("word").over(w)).select(F.col("word").alias("a"), "b")
    seen = row.join(pairs, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n_pair"))
    first = seen.select(F.col("a").alias("before"), F.col("b").alias("meant"), F.col("n_pair").alias("n_before"))
    second = seen.select(F.col("b").alias("after"), F.col("a").alias("meant"), F.col("n_pair").alias("n_after"))
    scored = asked.join(first, ["before", "meant"], "left").join(second, ["after", "meant"], "left")
    rank = F.struct((F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))).alias("c"), (-F.col("errors")).alias("e"), "n_meant", "meant")
    best = scored.groupBy("card", "line_no", "next_no", "ord", "cut", "word").agg(F.max_by(F.struct("meant", "places"), rank).alias("m"))
    return clear.unionByName(best.select("card", "line_no", "next_no", "ord", "cut", "word", "m.meant", "m.places"))


def find_noise(cards: DataFrame, records: DataFrame | None = None, learned: Learned | None = None) -> DataFrame:
    """card, line_no, noise of 'hyphen', 'header', 'page_no', 'misread', as TESTDATA states them.

    records: db_id, title, subtitle, series, whose words are known too; learned: as `learn` gives it, else it is learned
    from these cards. A null, empty or blank text has no noise; repeated rows count once; an empty table gives an empty
    result.
    """
    lines, text, each, wrong = _parts(cards, records, learned)
    furniture = lines.where("kind in ('header', 'page_no')").select("card", "line_no", F.col("kind").alias("noise"))
    hyphens = text.where("hyphen").select("card", "line_no", F.lit("hyphen").alias("noise"))
    hits = _chosen(each, wrong).select("card", "line_no", "next_no", "cut", F.explode("places").alias("place"))
    at = F.when(F.col("cut").isNull() | (F.col("place") < F.col("cut")), F.col("line_no")).otherwise(F.col("next_no"))
    misread = hits.select("card", at.alias("line_no"), F.lit("misread").alias("noise")).distinct()
    return furniture.unionByName(hyphens).unionByName(misread)


def repaired(cards: DataFrame, records: DataFrame | None = None, learned: Learned | None = None) -> DataFrame:
    """Continuous readable paragraphs: card, paragraph, text.

    Headers and page numbers are left out, broken words joined, misread words replaced. A blank line ends a paragraph.
    Cards without text have no paragraph.
    """
    lines, text, each, wrong = _parts(cards, records, learned)
    fixes = _chosen(each, wrong).groupBy("card", "line_no").agg(F.collect_list(F.struct("ord", "word", "meant")).alias("fixes"))
    para = lines.where("kind in ('text', 'blank')").withColumn(
        "paragraph", F.sum((F.col("kind") == "blank").cast("int")).over(Window.partitionBy("card").orderBy("line_no"))
    )
    joined = text.join(para.select("card", "line_no", "paragraph"), ["card", "line_no"]).join(fixes, ["card", "line_no"], "left")
    whole = joined.groupBy("card", "paragraph").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line", "hyphen", "tail", "after_break", "fixes"))).alias("rows")
    )

    def reflow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        token = regex.compile(_TOKEN)
        for f in frames:
            out = []
            for rows in f["rows"]:
                pieces = []
                for r in rows:
                    body = token.sub("", r["line"], count=1) if r["after_break"] and token.match(r["line"]) else r["line"]
                    if r["hyphen"]:
                        body = regex.sub(rf"[{BREAKS}]\s*$", "", body) + r["tail"]
                    fix = {x["ord"]: x for x in r["fixes"]} if r["fixes"] is not None else {}
                    k = -1

                    def put(m, fix=fix):
                        nonlocal k
                        k += 1
                        x = fix.get(k)
                        if x is None or x["word"] != m.group().lower():
                            return m.group()
                        t, meant = m.group(), x["meant"]
                        return meant.upper() if t.isupper() and len(t) > 2 and sum(map(str.isalpha, t)) > 1 else meant.capitalize() if t[:1].isupper() else meant

                    pieces.append(token.sub(put, body).strip())
                out.append(regex.sub(r"\s+", " ", regex.sub(r"\s+([.,;:])", r"\1", " ".join(pieces))).strip())
            yield pd.DataFrame({"card": f["card"], "paragraph": f["paragraph"].astype("int32"), "text": out})

    done = whole.mapInPandas(reflow, "card string, paragraph int, text string").where("text != ''")
    rank = F.row_number().over(Window.partitionBy("card").orderBy("paragraph")) - 1
    return done.select("card", rank.alias("paragraph"), "text")
