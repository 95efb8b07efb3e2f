"""Linking cards to records: mappings, joins, match scores, inverted index and ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions.distance import infix_distance, infix_distances
from cardloom.runtime import materialize


def card_of_file(name: Column) -> Column:
    """The card a file name stands for: dashes as slashes, cut at the first dot."""
    return F.substring_index(F.replace(name, F.lit("-"), F.lit("/")), ".", 1)


def mapping(rows: DataFrame, order: str | None = None) -> DataFrame:
    """card, db_id, score, one row a card. Of several the last by the `order` column holds, as in a file that is read line by
    line; a table without an order has the one with the highest score instead, then the largest id."""
    last = F.struct("score", "db_id") if order is None else F.struct(order, "score", "db_id")
    named = rows.withColumn("card", card_of_file(F.col("card_file"))).where("card is not null")
    best = named.groupBy("card").agg(F.max_by(F.struct("db_id", "score"), last).alias("b"))
    return best.select("card", "b.db_id", "b.score")


def numbered(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """rows with their number from 1 in the given order, which must tell all rows apart. Ranges of the order are ranked each by
    itself and moved up by the sizes of those before, so no task holds all rows or all of one value."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(sizes), "_part").withColumn(into, (F.col("_above") + own).cast("int")).drop("_part", "_above")


def latest_texts(cards: DataFrame) -> DataFrame:
    """card, transcription, one row a card that has a text."""
    kept = cards.select("card", "transcription").where("card is not null and transcription is not null")
    return kept.groupBy("card").agg(F.max("transcription").alias("transcription"))


def card_lines(cards: DataFrame) -> DataFrame:
    """card, line_no, line, line_start of lines that hold two characters or more (an unended last one: three), white space at the ends removed.

    The start is where the trimmed line stands in the raw text, so equal lines are told apart.
    """
    texts = latest_texts(cards)
    each = texts.select("card", F.posexplode(F.split("transcription", "\n")).alias("line_no", "raw"))
    w = Window.partitionBy("card").orderBy("line_no")
    start = F.coalesce(F.sum(F.length("raw") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.length("raw") - F.length(F.ltrim("raw"))
    placed = each.withColumn("line_start", (start + lead).cast("int")).withColumn("line", F.trim("raw"))
    # what counts is the length with the line break, which the last line lacks
    least = F.when(F.col("line_no") == F.max("line_no").over(Window.partitionBy("card")), 3).otherwise(2)
    return placed.withColumn("least", least).where((F.length("raw") >= F.col("least")) & (F.col("line") != "")).select("card", "line_no", "line", "line_start")


def card_record_join(links: DataFrame, cards: DataFrame, labels: DataFrame) -> DataFrame:
    """card, db_id, n_chars, n_labels of links whose card and record both exist."""
    texts = latest_texts(cards).select("card", F.length("transcription").alias("n_chars"))
    sizes = labels.groupBy("db_id").agg(F.count("*").alias("n_labels"))
    return links.select("card", "db_id").join(texts, "card").join(sizes, "db_id")


def anti_resume(todo: DataFrame, done: DataFrame, key: str = "card") -> DataFrame:
    """What is to do and isn't done."""
    return todo.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def suffix_first_match(stems: DataFrame, keys: DataFrame) -> DataFrame:
    """stem, card: for each stem the first card by name that ends in it, by the part after the last slash."""
    named = keys.select("card", F.substring_index("card", "/", -1).alias("stem")).distinct()
    return stems.select("stem").distinct().join(named, "stem").groupBy("stem").agg(F.min("card").alias("card"))


def grep_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """db_id, line_no of lines in which a wanted nine-digit id stands, in any place: ids are taken out of the lines and
    joined, so no line is held against every id."""
    found = lines.select("line_no", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"(?<!\d)(\d{9})(?!\d)")))).alias("db_id"))
    return found.join(ids.select("db_id").distinct(), "db_id").select("db_id", "line_no").distinct()


def union_prefixed(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """All rows of the parts with the key prefixed by the part's name and a dash."""
    out = None
    for name, df in parts.items():
        named = df.withColumn(key, F.concat(F.lit(f"{name}-"), key))
        out = named if out is None else out.unionByName(named)
    return out


def ranked_matches(links: DataFrame) -> DataFrame:
    """Links with rank by score, highest first, ties by the whole line backwards."""
    line = F.concat_ws(" ", "card", "db_id", "score")
    return numbered(links.select("card", "db_id", "score"), [F.desc("score"), line.desc(), F.desc("card"), F.desc("db_id")])


def task_numbering(texts: DataFrame) -> DataFrame:
    """id from 1 in order of the card, card, task as JSON."""
    row = numbered(texts.select("card", "transcription"), [F.asc("card")], "id")
    return row.select("id", "card", F.to_json(F.struct("id", F.struct(F.col("card").alias("text"), F.col("transcription").alias("body")).alias("data"))).alias("task"))


def union_dumps(dumps: list[DataFrame]) -> DataFrame:
    """Lines of several dumps one after the other: part (from 0), and the columns of each; equal lines all stay."""
    return reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(i)) for i, d in enumerate(dumps)])


def resplit(train: DataFrame, test: DataFrame, run) -> tuple[DataFrame, DataFrame]:
    """run over the rows of both at once, and the outcome parted again as it was; run must keep the column _test."""
    both = run(train.withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True))))
    return both.where("not _test").drop("_test"), both.where("_test").drop("_test")


def shuffled(rows: DataFrame, key: list[str], seed: int) -> DataFrame:
    """rows with place from 1, in an order that depends on the key columns and the seed alone."""
    h = F.xxhash64(*key, F.lit(seed))
    return numbered(rows, [h, *map(F.asc, key)], "place")


def xml_text_extract(lines: DataFrame) -> DataFrame:
    """line_no, text of lines that hold 'Unicode': without the tag and white space before it and the closing tag."""
    opened = F.regexp_replace("raw", r"^[ \t]*<Unicode>", "")
    return lines.where(F.col("raw").contains("Unicode")).select("line_no", F.regexp_replace(opened, r"</Unicode>[ \t]*$", "").alias("text"))


def records_match_score(pairs: DataFrame, lines: DataFrame, labels: DataFrame, compat: bool = False, text=lambda c: c) -> DataFrame:
    """card, db_id, n_matched: how many lines of the card (4 characters or more) lie within an infix error rate of 0.3 of
    some value of the record (4 characters or more). Pairs without such values have no row.

    The lines of a card and the values of a record are gathered once each, and the pairs, not the lines, are joined.
    """
    ls = lines.where("length(line) >= 4").groupBy("card").agg(F.collect_list(text(F.col("line"))).alias("lines"))
    vs = labels.where("length(text) >= 4").groupBy("db_id").agg(F.collect_set(text(F.col("text"))).alias("vals"))
    # the pairs of a card mostly stand together, so that what its records share is measured once
    both = pairs.select("card", "db_id").distinct().join(vs, "db_id").join(ls, "card")

    def signs(text: str) -> int:
        return reduce(lambda m, ch: m | 1 << ord(ch) % 64, text, 0)

    def near(texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each text of a and that of b at its place are near."""
        size = np.array([len(t) for t in texts])
        held = np.array([signs(t) for t in texts], dtype=np.uint64)
        short, long = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        # a sign that the longer text lacks is an error at least, so with too many of them there is no need to measure
        may = np.bitwise_count(held[short] & ~held[long]) < 0.3 * size[short]
        pair, back = np.unique(short[may] * len(texts) + long[may], return_inverse=True)
        s, t = pair // len(texts), pair % len(texts)
        fits = (size[s] <= 64) & (not compat)
        some, of = np.unique(s[fits], return_inverse=True)
        others, within = np.unique(t[fits], return_inverse=True)
        dist = np.empty(len(pair), dtype=np.int64)
        dist[fits] = infix_distances([texts[i] for i in some], [texts[i] for i in others], of, within)
        dist[~fits] = [infix_distance(texts[x], texts[y], compat) for x, y in zip(s[~fits], t[~fits])]
        out = np.zeros(len(a), dtype=bool)
        out[may] = (dist < 0.3 * size[s])[back]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[i : i + 1000] for g in frames for i in range(0, len(g), 1000)):
            ids: dict[str, int] = {}
            number = lambda xs: np.array([ids.setdefault(x, len(ids)) for x in xs], dtype=np.int64)
            a, b = [number(x) for x in f["lines"]], [number(x) for x in f["vals"]]
            n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            met = near(list(ids), np.concatenate([np.repeat(x, n) for x, n in zip(a, n_b)]), np.concatenate([np.tile(y, n) for y, n in zip(b, n_a)]))
            lines_met = np.logical_or.reduceat(met, np.cumsum(np.repeat(n_b, n_a)) - np.repeat(n_b, n_a))
            n = np.add.reduceat(lines_met.astype(np.int32), np.cumsum(n_a) - n_a)
            yield pd.DataFrame({"card": f["card"], "db_id": f["db_id"], "n_matched": pd.array(n, dtype="int32")})

    return both.mapInPandas(run, "card string, db_id string, n_matched int")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)


def build_index(docs: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, tf) and lengths (key, len)."""
    terms = docs.select(key, F.explode(words_of(text)).alias("term"))
    return terms.groupBy("term", key).agg(F.count("*").alias("tf")), terms.groupBy(key).agg(F.count("*").alias("len"))


#: Documents of a block of the index, held by one task; queries that one task holds against a block at most, and at least where there are tasks enough.
BLOCK_DOCS, CHUNK_QUERIES, LEAST_QUERIES = 200_000, 50_000, 1_000


class Index:
    """Documents by their terms and terms by their documents. Terms are numbered from the rarest on, documents as they stand.

    rest: of a term in a document the weight of it and of all that are more frequent there. A document with a score of t has a
    term of the query with a rest of t or more: the rarest that they share. So the documents of a term stand by their rest, and
    only the first of them need a look.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        named, term, df = np.unique(terms, return_inverse=True, return_counts=True)
        rank = np.empty(len(named), dtype=np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(named))
        self.named, self.rank = named, rank
        doc, term = np.repeat(np.arange(len(sizes)), sizes), rank[term]
        order = np.lexsort((term, doc))
        self.term, self.weight = term[order], weights[order]
        self.start = np.r_[0, np.cumsum(sizes)]
        total = np.r_[0.0, np.cumsum(self.weight)]
        rest = total[self.start[doc + 1]] - total[:-1]
        by = np.lexsort((-rest, self.term))
        self.docs, self.less = doc[by], -rest[by]
        self.at = np.searchsorted(self.term[by], np.arange(len(named) + 1))
        self.most = np.maximum.reduceat(self.weight[by], self.at[:-1]) if len(named) else np.zeros(0)
        self.asked, self.met = np.zeros(len(named)), np.full(len(sizes), -1)

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Sums of the weights that the documents have for the terms in `asked`."""
        n = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(n)
        i = np.arange(ends[-1]) + np.repeat(self.start[docs] - ends + n, n)
        return np.add.reduceat(self.weight[i] * self.asked[self.term[i]], ends - n)

    def best(self, number: int, terms: np.ndarray, k: int, rare: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for the terms, with scores rounded to 6 places, ties by place. number: another one for each
        query; rare: of how many documents a term is frequent."""
        i = np.searchsorted(self.named, terms)
        ids = np.sort(self.rank[i[(i < len(self.named)) & (self.named[np.minimum(i, len(self.named) - 1)] == terms)]])
        self.asked[ids] = 1.0
        left = np.cumsum(self.most[ids][::-1])[::-1]
        docs, scores, new, n_new, kth = np.zeros(0, dtype=np.int64), np.zeros(0), [], 0, -1.0
        for i, t in enumerate(ids):
            a, b = self.at[t], self.at[t + 1]
            if n_new and (n_new >= max(k, len(docs) // 4) or b - a > rare):
                d = np.concatenate(new)
                docs, scores, new, n_new = np.r_[docs, d], np.r_[scores, self.scores(d)], [], 0
                if len(docs) >= k:
                    kth = np.partition(scores, -k)[-k]
                    keep = scores >= kth - 1e-5
                    docs, scores = docs[keep], scores[keep]
            if left[i] < kth - 1e-5:
                break
            if kth > 0:
                b = a + np.searchsorted(self.less[a:b], 1e-5 - kth, side="right")
            d = self.docs[a:b]
            d = d[self.met[d] != number]
            self.met[d] = number
            new.append(d)
            n_new += len(d)
        if n_new:
            d = np.concatenate(new)
            docs, scores = np.r_[docs, d], np.r_[scores, self.scores(d)]
        self.asked[ids] = 0.0
        scores = np.round(scores, 6)
        top = np.lexsort((docs, -scores))[:k]
        return docs[top], scores[top]


def index_search(queries: DataFrame, docs: DataFrame, query_key: str, query_text: Column, doc_key: str, doc_text: Column, k: int = 5, rare_share: float = 0.01) -> DataFrame:
    """The k best documents of each query by BM25 over all terms: query key, document key, score, rank; ties go to the smaller key.

    Documents and queries are cut into blocks that meet each other, each block of documents being an `Index` in one task that
    gives the k best of it for each query. What is moved grows with the texts, not with the pairs that share a term. Before
    a term in more than rare_share of the documents is looked at, those found so far are scored, so that few of its own need be.
    """
    postings, lengths = build_index(docs, doc_key, doc_text)
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    counts = materialize(postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id()))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    each = postings.join(counts, "term").join(lengths, doc_key).join(F.broadcast(stats)).select(doc_key, F.struct("t", weight.alias("w")).alias("x"))
    index = materialize(each.groupBy(doc_key).agg(F.collect_list("x").alias("x")).select(F.col(doc_key).alias("doc"), F.col("x.t").alias("t"), F.col("x.w").alias("w")))
    known = queries.select(query_key, F.explode(F.array_distinct(words_of(query_text))).alias("term")).join(counts.select("term", "t"), "term")
    asked = materialize(known.groupBy(query_key).agg(F.collect_set("t").alias("t")).select(F.col(query_key).alias("query"), "t"))
    tasks, n_asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, asked.count())
    n_blocks = -(-max(1, index.count()) // BLOCK_DOCS)
    n_chunks = max(-(-n_asked // CHUNK_QUERIES), min(-(-2 * tasks // n_blocks), -(-n_asked // LEAST_QUERIES)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query", "t", part("query", n_chunks).alias("chunk"), every(n_blocks).alias("block")).repartition(n_blocks * n_chunks, "chunk", "block")
    right = index.select("doc", "t", "w", part("doc", n_blocks).alias("block"), every(n_chunks).alias("chunk")).repartition(n_blocks * n_chunks, "chunk", "block")
    schema = f"{query_key} {asked.schema['query'].dataType.simpleString()}, {doc_key} {index.schema['doc'].dataType.simpleString()}, score double"

    def search(some: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("doc").combine_chunks()
        some = some.combine_chunks()
        array = lambda table, name: table.column(name).combine_chunks()
        flat = lambda table, name: array(table, name).flatten().to_numpy(zero_copy_only=False)
        sizes = lambda table: array(table, "t").value_lengths().to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(some) and len(block):
            here, ask, end = Index(sizes(block), flat(block, "t"), flat(block, "w")), flat(some, "t"), np.cumsum(sizes(some))
            found = [here.best(i, ask[a:b], k, rare_share * len(block)) for i, (a, b) in enumerate(zip(np.r_[0, end[:-1]], end))]
        of = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
        docs_, scores = (np.concatenate(x) if found else np.zeros(0) for x in (list(zip(*found)) if found else ((), ())))
        return pa.table([some.column("query").take(pa.array(of, pa.int64())), block.column("doc").take(pa.array(docs_, pa.int64())), pa.array(scores, pa.float64())], names=[query_key, doc_key, "score"])

    near = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(doc_key)))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def matched_cards(cards: DataFrame, lines: DataFrame, records: DataFrame, labels: DataFrame, k: int = 5, least: int = 1) -> DataFrame:
    """card, db_id, n_matched: of the k records that the index gives for a card those of whose values at least `least` of its lines hold one.

    cards: card, transcription; lines: as `card_lines` gives them; records: db_id, text; labels: db_id, text.
    """
    near = index_search(cards, records, "card", F.col("transcription"), "db_id", F.col("text"), k)
    return records_match_score(near, lines, labels).where(F.col("n_matched") >= least)
