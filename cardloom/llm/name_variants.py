"""Variant spellings of names typed by people (problem 5).

Method: a name is a vector of character n-grams in three blocks, of the word that tells the person or firm, of the other
words, and of their initials, weighted by how rare they are. Pairs come from a distributed sparse join on the first block,
made of the distinct words rather than of the names: of each vector only the heaviest n-grams are joined, as many as any
partner above the threshold must share one of. No top-n cuts a partner off. The cosine of the whole vectors, lowered
where a check of the parts finds nothing alike and turned against the pair where it finds two different given names, is what
average-linkage clustering, in rounds of mutually nearest clusters, groups the spellings by.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.runtime import materialize, release

# Short forms of given names, without accents; others are learned from the names, see `learned_forms`.
NICKNAMES = {
    "andula": "anna", "anca": "anna", "anicka": "anna", "tonda": "antonin", "tonik": "antonin", "bohous": "bohumil", "bohus": "bohumil",
    "boza": "bozena", "bozka": "bozena", "ctik": "ctirad", "dasa": "dagmar", "dusek": "dusan", "elka": "eliska", "eli": "eliska",
    "milek": "emil", "emilek": "emil", "franta": "frantisek", "fanda": "frantisek", "fanka": "frantiska", "fany": "frantiska",
    "fritz": "friedrich", "fridrich": "friedrich", "gusta": "gustav", "gustik": "gustav", "heini": "heinrich", "heinz": "heinrich",
    "hela": "helena", "helenka": "helena", "hynes": "hynek", "ivanek": "ivan", "vana": "ivan", "honza": "jan", "jenik": "jan",
    "jarka": "jarmila", "jaruska": "jarmila", "jirka": "jiri", "jura": "jiri", "hans": "johann", "hannes": "johann", "pepa": "josef",
    "josifek": "josef", "kaja": "karel", "karlik": "karel", "katka": "katerina", "kaca": "katerina", "lada": "ladislav", "lida": "ludmila",
    "lidka": "ludmila", "mana": "marie", "maruska": "marie", "mirek": "miroslav", "mira": "miroslav", "nada": "nadezda", "norek": "norbert",
    "olda": "oldrich", "olin": "oldrich", "pavlik": "pavel", "ruda": "rudolf", "rudek": "rudolf", "ruza": "ruzena", "ruzenka": "ruzena",
    "standa": "stanislav", "slavek": "stanislav", "rezi": "terezie", "reza": "terezie", "terka": "terezie", "tomsik": "tomas",
    "tomasek": "tomas", "vasek": "vaclav", "venca": "vaclav", "vlada": "vladimir", "vladik": "vladimir", "willi": "wilhelm",
    "willy": "wilhelm", "zdenda": "zdenek", "zdenecek": "zdenek",
}
# Titles before or after a name.
TITLES = {"dr.", "prof.", "ing.", "mgr.", "bc.", "phdr.", "judr.", "mudr.", "doc.", "csc.", "dr", "prof", "ing"}
# Letters and pairs that are written for each other; all map to one.
SOUNDS = (("tz", "c"), ("ph", "f"), ("w", "v"), ("y", "i"), ("j", "i"), ("ks", "x"))


def fold(text: str) -> str:
    """Small letters without accents."""
    flat = unicodedata.normalize("NFKD", text)
    return "".join(ch for ch in flat if not unicodedata.combining(ch)).casefold()


def one_typo(a: str, b: str) -> bool:
    """Whether two words are one up to sounds, or one character left out, put in or swapped with the next."""
    if a == b:
        return True
    s, t = a, b
    for x, y in SOUNDS:
        s, t = s.replace(x, y), t.replace(x, y)
    if s == t:
        return True
    for p, q in ((a, b), (s, t)):
        if len(p) > len(q):
            p, q = q, p
        i = 0
        while i < len(p) and p[i] == q[i]:
            i += 1
        if len(q) - len(p) == 1 and p[i:] == q[i + 1 :]:
            return True
        if len(p) == len(q) and p[i : i + 2] == q[i : i + 2][::-1] and p[i + 2 :] == q[i + 2 :]:
            return True
    return False


def _forms(given: str) -> set[str]:
    bare = given.rstrip(".")
    return {bare, NICKNAMES[bare]} if bare in NICKNAMES else {bare}


def given_alike(a: str, b: str, common_a: bool, common_b: bool) -> bool:
    """Whether two given names may be one: the same, an initial or cut form, a short form, or one typo."""
    for x in _forms(a):
        for y in _forms(b):
            short, long = sorted((x, y), key=len)
            if x == y or ((len(short) == 1 or a.endswith(".") or b.endswith(".")) and long.startswith(short)):
                return True
    bare_a, bare_b = a.rstrip("."), b.rstrip(".")
    return not (common_a and common_b) and min(len(bare_a), len(bare_b)) >= 3 and one_typo(bare_a, bare_b)


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, field, name -> with tok (folded words, a dot kept) and lead (how many stand before the first comma or bracket)."""
    word = re.compile(r"[^\W\d_]+\.?")
    for f in frames:
        tok, lead = [], []
        for name in f["name"]:
            flat = fold(name).strip().strip("[]").strip(" ,")
            words = [w for w in word.findall(flat) if w not in TITLES]
            m = re.search(r"[,:(]", flat)
            tok.append(words)
            lead.append(len([w for w in word.findall(flat[: m.start()]) if w not in TITLES]) if m else 0)
        yield f.assign(tok=tok, lead=pd.array(lead, dtype="int32"))


#: Shares of the blocks in a vector: the word that tells, other words, their initials.
BLOCKS = {"k": 0.6, "g": 0.2, "i": 0.2}
#: What the check of the parts takes from the cosine: nothing where they are alike, SILENT where it can't tell, AGAINST where given names differ.
SILENT, AGAINST = 0.5, 1.5


def _grams(word: str) -> set[str]:
    """Trigrams of a word, and the set of its letters, which swapped or doubled letters leave alone."""
    w = word.rstrip(".")
    out = {"#" + "".join(sorted(set(w)))} if len(w) > 3 and not word.endswith(".") else set()
    w = f"^{w}$"
    return out | {w[i : i + 3] for i in range(max(1, len(w) - 2))}


def _features(key: str, rest: list[str], common: list[bool], firm: bool) -> set[str]:
    """Grams by block. Of a person's other words the first counts, by its full form; of a firm's those that not many have."""
    others = [w for w, c in zip(rest, common) if not c] if firm else [NICKNAMES.get(w, w) for w in rest[:1]]
    out = {"k" + g for g in _grams(key)} | {"i" + w[:1] for w in others}
    return out | {"g" + g for w in others if len(w.rstrip(".")) > 1 for g in _grams(w)}


def parsed_names(records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Distinct names with their parts: id, field, name, tok, key (what tells the person or firm), rest, common.

    The key of a person is the surname, of a firm its own name: of the words of a name the one that stands, over all
    rows, most often on that side of a comma (authors: before it, else after all others), and is rarest among equals.
    common: whether the first other word is a frequent one, so no mistyped other word.
    """
    split = [F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in fields]
    names = records.select(F.explode(F.array(*split)).alias("x")).select("x.*").where("name is not null and trim(name) != ''").groupBy("field", "name").agg(F.count("*").alias("n_rows"))
    # xxhash64 gives an id without ordering the names
    ids = names.withColumn("id", F.xxhash64("field", "name"))
    names = materialize(ids.mapInPandas(_tokens, "field string, name string, n_rows long, id long, tok array<string>, lead int"))
    # the last word that is written out
    end = F.array_max(F.transform("tok", lambda w, i: F.when(w.endswith(".") | (F.length(w) < 4), -1).otherwise(i)))
    each = names.where(F.size("tok") > 0).select("id", "field", "n_rows", "lead", end.alias("end"), F.posexplode("tok").alias("at", "word"))
    first = (F.col("lead") > 0) & (F.col("at") < F.col("lead"))
    whole = (F.col("lead") > 0) & ~F.col("word").endswith(".")
    stats = each.groupBy("field", "word").agg(
        F.count("*").alias("df"),
        F.sum(F.when(whole & first & (F.col("lead") == 1), F.col("n_rows")).otherwise(0)).alias("n_first"),
        F.sum(F.when(whole & ~first & (F.col("at") == F.col("end")), F.col("n_rows")).otherwise(0)).alias("n_last"),
    )
    total = each.groupBy("field").agg(F.countDistinct("id").alias("n_names"))  # a row a field
    stats = stats.join(F.broadcast(total), "field").withColumn("frequent", (F.col("df") >= 3) & (F.col("df") >= 0.005 * F.col("n_names")))
    known = each.join(stats, ["field", "word"])
    lean = (F.col("n_first") - F.col("n_last")) / (F.col("n_first") + F.col("n_last") + 1.0)
    side = F.when(F.col("field") == "publisher", -lean).otherwise(lean)
    # in a name with a comma the place tells, unless the statistics speak against it
    here = F.when(F.col("field") == "publisher", F.when(~first & (F.col("at") == F.col("end")), 0.2).otherwise(0.0)).otherwise(
        F.when(first, 0.2).when((F.col("lead") == 0) & (F.col("at") == F.col("end")), 0.05).otherwise(0.0)
    )
    weak = F.when(F.col("word").endswith(".") | (F.length("word") < 4), -4.0).otherwise(0.0)
    score = F.struct((side + here + weak).alias("s"), (-F.col("df")).alias("r"), F.length("word").alias("l"), F.col("word").alias("w"))
    best = known.groupBy("id").agg(
        F.max_by(F.struct("word", "at"), score).alias("k"),
        F.sort_array(F.collect_list(F.struct("at", "word", "frequent"))).alias("all"),
    )
    best = best.withColumn("others", F.filter("all", lambda x: x["at"] != F.col("k.at")))
    parts = best.select(
        "id",
        F.col("k.word").alias("key"),
        F.transform("others", lambda x: x["word"]).alias("rest"),
        F.transform("others", lambda x: x["frequent"]).alias("common"),
    )
    return names.join(parts, "id").select("id", "field", "name", "tok", "key", "rest", "common")


def _check(field: str, a: tuple, b: tuple, same_given: bool = False) -> int:
    """1 like, -1 unlike, 0 unknown; a, b: key, rest, common; same_given: whether the given names are known as forms of one."""
    (key_a, rest_a, com_a), (key_b, rest_b, com_b) = a, b
    same_key = one_typo(key_a, key_b) and min(len(key_a), len(key_b)) >= 3
    if field == "publisher":
        place_a = [x for x, c in zip(rest_a, com_a) if not c and len(x) > 2]
        place_b = [x for x, c in zip(rest_b, com_b) if not c and len(x) > 2]
        if not same_key:
            return 0
        if key_a == key_b or not place_a or not place_b:
            return 1
        near = any(one_typo(x.rstrip("."), y.rstrip(".")) or (x.endswith(".") and y.startswith(x[:-1])) or (y.endswith(".") and x.startswith(y[:-1])) for x in place_a for y in place_b)
        return 1 if near else 0
    if not rest_a or not rest_b:
        return 1 if same_key and not rest_a and not rest_b else 0
    if not same_key:
        return 0
    if same_given or given_alike(rest_a[0], rest_b[0], com_a[0], com_b[0]):
        return 1
    # a rare given name may be a mistyped one: that says nothing
    sure = all(c or x.endswith(".") or x in NICKNAMES for x, c in ((rest_a[0], com_a[0]), (rest_b[0], com_b[0])))
    return -1 if sure else 0


def _weight(n_all: Column) -> Column:
    """How much a gram counts: more the rarer it is, but by the root only, as the rarest ones are those of a slip of the pen."""
    return F.sqrt(F.log(1 + n_all / (F.col("df") + 0.003 * n_all)))


def learned_forms(names: DataFrame, least: int = 4, lift: float = 10.0) -> DataFrame:
    """given_a, given_b (both orders): given names that stand with the same surnames so much oftener than chance would have it
    that they are forms of one: with `least` surnames and `lift` times the expected number."""
    given = F.regexp_replace(F.get("rest", F.lit(0)), r"\.$", "")
    own = names.where("field = 'author'").select("key", given.alias("given")).where("length(given) >= 3").distinct()
    n_of = own.groupBy("given").agg(F.count("*").alias("n"))
    total = own.agg(F.count_distinct("key").alias("n_keys"))  # one row
    pair = own.select("key", F.col("given").alias("given_a")).join(own.select("key", F.col("given").alias("given_b")), "key").where("given_a != given_b")
    met = pair.groupBy("given_a", "given_b").agg(F.count("*").alias("n_met")).where(F.col("n_met") >= least)
    both = met.join(n_of.select(F.col("given").alias("given_a"), F.col("n").alias("na")), "given_a").join(n_of.select(F.col("given").alias("given_b"), F.col("n").alias("nb")), "given_b")
    return both.join(F.broadcast(total)).where(F.col("n_met") * F.col("n_keys") >= lift * F.col("na") * F.col("nb")).select("given_a", "given_b")


def _dot(a: str | Column, b: str | Column) -> Column:
    """Scalar product of two vectors held as maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda acc, x: acc + x["value"] * F.coalesce(F.try_element_at(b, x["key"]), F.lit(0.0)))


def _key_vectors(names: DataFrame, threshold: float) -> DataFrame:
    """field, key, kv, heads: the n-gram vector of each telling word by hashes, and its rarest grams until what is left is below
    the threshold: a partner with a cosine >= threshold must share one of them."""
    keys = names.select("field", "key").distinct()

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(gram=[sorted(_grams(k)) for k in f["key"]]).explode("gram")[["field", "key", "gram"]]

    grams = materialize(keys.mapInPandas(explode, "field string, key string, gram string"))
    df = grams.groupBy("field", "gram").agg(F.count("*").alias("df"))
    total = keys.groupBy("field").agg(F.count("*").alias("n_keys"))  # a row a field
    idf = df.join(F.broadcast(total), "field").withColumn("w0", _weight(F.col("n_keys")))
    own = Window.partitionBy("field", "key")
    rare = own.orderBy(F.asc("df"), F.asc("gram"))
    vec = grams.join(idf, ["field", "gram"]).withColumn("w", F.col("w0") / F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(own)))
    vec = vec.withColumn("left2", F.lit(1.0) - F.coalesce(F.sum(F.col("w") * F.col("w")).over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    h, kept = F.xxhash64("field", "gram"), F.col("left2") >= threshold * threshold * 0.9999
    return vec.groupBy("field", "key").agg(F.map_from_entries(F.collect_list(F.struct(h.alias("h"), "w"))).alias("kv"), F.sort_array(F.collect_list(F.when(kept, h))).alias("heads"))


#: Names of one telling word that stand in a row of the join.
MEMBERS = 200


def _near_names(vec: DataFrame, names: DataFrame, threshold: float, key_threshold: float) -> DataFrame:
    """a, b (a < b): names whose vectors have a cosine >= threshold, but for rounding, and whose telling words have >= key_threshold.

    vec: id, field, gram, block, w1 (before the whole is normed), w. Telling words are joined on a gram with all that the
    cosine needs beside them, so a pair is judged where it is met, for the first gram it shares, and only pairs
    that hold are moved or written. What is written grows with the names, not with the pairs that share a gram.
    """
    whole = vec.join(names.select("id", "key"), "id").withColumns({"h": F.xxhash64("gram"), "tells": F.col("block") == "k"})
    small = lambda w: F.struct("h", F.col(w).cast("float").alias("w"))
    told = whole.where("tells").groupBy("field", "key", "h").agg(F.max("w1").alias("w1")).groupBy("field", "key").agg(F.map_from_entries(F.collect_list(small("w1"))).alias("fv"))
    # the part of a vector that the names of a telling word don't share, and what the shared part is multiplied by
    own = whole.groupBy("field", "key", "id").agg(F.map_from_entries(F.collect_list(F.when(~F.col("tells"), small("w")))).alias("more"), F.max(F.when(F.col("tells"), F.col("w") / F.col("w1"))).alias("c"))
    parts = own.withColumn("part", F.pmod("id", F.ceil(F.count("*").over(Window.partitionBy("field", "key")) / MEMBERS)))
    packs = parts.groupBy("field", "key", "part").agg(F.collect_list(F.struct("id", "c", "more")).alias("of"))
    packs = materialize(packs.join(told, ["field", "key"]).join(_key_vectors(names, key_threshold), ["field", "key"]).select("key", "kv", "heads", "fv", "of"))
    # few bytes give many pairs: tasks by number, not by size
    tasks = max(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), packs.count() // 500)
    posted = packs.select(F.explode("heads").alias("g"), "*").repartition(tasks, "g")
    side = lambda s: posted.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "kv", "heads", "fv", "of")])
    met = side("a").join(side("b"), "g").where("key_a <= key_b").where((F.get(F.array_intersect("heads_a", "heads_b"), F.lit(0)) == F.col("g")) & (_dot("kv_a", "kv_b") >= key_threshold))
    each = met.select((F.col("key_a") < F.col("key_b")).alias("two"), _dot("fv_a", "fv_b").alias("told"), F.explode("of_a").alias("x"), "of_b").select("two", "told", "x", F.explode("of_b").alias("y"))
    held = each.where("two or x.id < y.id").where(F.col("told") * F.col("x.c") * F.col("y.c") + _dot("x.more", "y.more") >= threshold - 1e-5)
    near = materialize(held.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    release(packs)
    return near


def similar_pairs(names: DataFrame, threshold: float = 0.4, key_threshold: float = 0.25) -> DataFrame:
    """Pairs of names of one field with cosine >= threshold: field, a, b (a < b), cosine, verdict of the check of the parts.

    names: as parsed_names gives them. Every pair at or above the threshold whose telling words have at least
    `key_threshold` comes out, whatever the number of partners.
    """

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = [sorted(_features(k, list(r), list(c), field == "publisher")) for field, k, r, c in zip(f["field"], f["key"], f["rest"], f["common"])]
            yield pd.DataFrame({"id": f["id"], "field": f["field"], "gram": g}).explode("gram").dropna()

    grams = materialize(names.select("id", "field", "key", "rest", "common").mapInPandas(explode, "id long, field string, gram string"))
    df = grams.groupBy("field", "gram").agg(F.count("*").alias("df"))
    total = names.groupBy("field").agg(F.count("*").alias("n_names"))  # a row a field
    idf = df.join(F.broadcast(total), "field").withColumn("w0", _weight(F.col("n_names")))
    block = F.substring("gram", 1, 1)
    share = F.create_map(*[F.lit(x) for kv in BLOCKS.items() for x in kv])
    of_block = F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy("id", "block"))
    scaled = grams.join(idf, ["field", "gram"]).withColumn("block", block).withColumn("w1", F.col("w0") * F.sqrt(share[F.col("block")] / of_block))
    vec = materialize(scaled.withColumn("w", F.col("w1") / F.sqrt(F.sum(F.col("w1") * F.col("w1")).over(Window.partitionBy("id")))).select("id", "field", "gram", "block", "w1", "w"))
    release(grams)
    near = _near_names(vec, names, threshold, key_threshold)
    vecs = vec.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "w"))).alias("v"))
    full = materialize(names.join(vecs, "id").select("id", "field", "key", "rest", "common", "v"))
    release(vec)
    side = lambda s, *more: full.select(F.col("id").alias(s), *more, *[F.col(c).alias(f"{c}_{s}") for c in ("key", "rest", "common", "v")])
    given = lambda s: F.regexp_replace(F.get(f"rest_{s}", F.lit(0)), r"\.$", "").alias(f"given_{s}")
    forms = materialize(learned_forms(names)).withColumn("same_given", F.lit(True))
    both = near.join(side("a", "field"), "a").join(side("b"), "b")
    both = both.withColumns({"given_a": given("a"), "given_b": given("b")}).join(forms, ["given_a", "given_b"], "left").withColumn("same_given", F.coalesce("same_given", F.lit(False)))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cos, verdict = [], []
            for r in f.itertuples(index=False):
                va, vb = dict(r.v_a), dict(r.v_b)
                cos.append(min(1.0, math.fsum(x * vb[g] for g, x in va.items() if g in vb)))
                verdict.append(_check(r.field, (r.key_a, list(r.rest_a), list(r.common_a)), (r.key_b, list(r.rest_b), list(r.common_b)), r.same_given))
            out = pd.DataFrame({"field": f["field"], "a": f["a"], "b": f["b"], "cosine": cos, "verdict": pd.array(verdict, dtype="int32")})
            yield out[out["cosine"] >= threshold]

    cols = ["field", "a", "b", "key_a", "rest_a", "common_a", "v_a", "key_b", "rest_b", "common_b", "v_b", "same_given"]
    return both.select(*cols).mapInPandas(judge, "field string, a long, b long, cosine double, verdict int")


def similarity(cosine: Column, verdict: Column) -> Column:
    """What the linkage goes by: the cosine, less what the check of the parts takes from it; 0 where that leaves nothing for a silent check."""
    silent = F.greatest(cosine - SILENT, F.lit(0.0))
    return F.when(verdict > 0, cosine).when(verdict < 0, cosine - AGAINST).otherwise(silent)


def average_linkage(ids: DataFrame, sims: DataFrame, threshold: float) -> DataFrame:
    """Clusters (id, cluster) by average linkage: pairs of clusters, each the other's nearest, merge while their mean
    similarity over all cross pairs, missing ones being 0, is at least the threshold.

    ids: id. sims: a, b, sim (a < b, may be negative). The mean links of the merged clusters are kept as a sum and the
    sizes, so a round is a few joins of links; mutually nearest pairs don't touch, so all of them merge at once, which
    gives the same clusters as one by one. Ties go to the smaller id.
    """
    members = materialize(ids.select("id", F.col("id").alias("cluster")))
    links = materialize(sims.select("a", "b", F.col("sim").alias("total"), F.lit(1).alias("size_a"), F.lit(1).alias("size_b")))
    while True:  # every round merges the best pair at least
        mean = links.withColumn("mean", F.col("total") / (F.col("size_a") * F.col("size_b"))).where(F.col("mean") >= threshold)
        both = mean.select(F.col("a").alias("x"), F.col("b").alias("y"), "mean").union(mean.select("b", "a", "mean"))
        # pairs are ordered alike seen from either side, so a best pair is always mutual
        rank = F.struct("mean", (-F.least("x", "y")).alias("lo"), (-F.greatest("x", "y")).alias("hi"))
        nearest = both.groupBy("x").agg(F.max_by("y", rank).alias("y"))
        back = nearest.select(F.col("x").alias("y"), F.col("y").alias("x"))
        merge = materialize(nearest.join(back, ["x", "y"]).where("x < y").select(F.col("y").alias("old"), F.col("x").alias("new")))
        if merge.isEmpty():
            release(links, merge)
            return members
        old = (members, links, merge)
        members = materialize(
            members.join(merge, F.col("cluster") == F.col("old"), "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
        )
        sizes = members.groupBy("cluster").agg(F.count("*").cast("int").alias("size"))
        moved = (
            links.select("a", "b", "total")
            .join(merge.select(F.col("old").alias("a"), F.col("new").alias("na")), "a", "left")
            .join(merge.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b", "left")
            .select(F.coalesce("na", "a").alias("p"), F.coalesce("nb", "b").alias("q"), "total")
            .where("p != q")
            .groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .agg(F.sum("total").alias("total"))
        )
        links = materialize(
            moved.join(sizes.select(F.col("cluster").alias("a"), F.col("size").alias("size_a")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("size").alias("size_b")), "b")
            .select("a", "b", "total", "size_a", "size_b")
        )
        release(*old)


def name_clusters(records: DataFrame, fields: tuple[str, ...] = ("author", "publisher"), threshold: float = 0.4, linkage: float = 0.2) -> DataFrame:
    """field, name, cluster: spellings of one person or firm share a cluster.

    Null and blank names have no row, repeated rows and names count once, and an empty table gives an empty result.
    """
    names = materialize(parsed_names(records, fields))
    pairs = similar_pairs(names, threshold).select("a", "b", similarity(F.col("cosine"), F.col("verdict")).alias("sim")).where("sim != 0")
    clusters = average_linkage(names.select("id"), pairs, linkage)
    return names.join(clusters, "id").select("field", "name", "cluster")


def variant_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of spellings within a cluster: field, name_a, name_b (name_a < name_b by code point)."""
    a = clusters.select("field", "cluster", F.col("name").alias("name_a"))
    b = clusters.select("field", "cluster", F.col("name").alias("name_b"))
    return a.join(b, ["field", "cluster"]).where("name_a < name_b").select("field", "name_a", "name_b")
