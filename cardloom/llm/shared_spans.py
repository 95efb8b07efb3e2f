"""Long exact spans shared between records (problem 8).

Method: De Bruijn compaction. A document is cut into tokens at anchors, the code-point grams chosen by winnowing, so
that equal text is cut equally wherever it stands. Two neighbouring anchors and the text between them are a k-mer, an
edge of the graph whose nodes are anchors. Nodes seen in two or more documents are kept, paths of them that never
branch are compacted by Spark joins into unitigs, and a unitig of the wanted length is a repeated span by construction.
Around the ends of unitigs, where a span may go on inside a token, every window of the wanted length is verified at its
source coordinates, if the longer half of it is already known to be shared.

Completeness: any span of `min_len` code points holds a whole anchor, as GRAM + WINDOW - 1 <= min_len.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.runtime import materialize, release

#: Odd multipliers of the polynomial fingerprints and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)
_SLICE = 1 << 20
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(k: int, inverse: bool, n: int) -> np.ndarray:
    """b**0 .. b**(n-1) modulo 2**64."""
    have = _powers.get((k, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        step = np.full(size, (_INVERSES if inverse else _BASES)[k], dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        _powers[(k, inverse)] = have
    return have[:n]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prints:
    """Fingerprints of any substring of one array of code points, in constant time each."""

    def __init__(self, codes: np.ndarray, k: int = 0):
        self.k, n = k, len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes, 0x1234567 + k) * _power(k, False, n), dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        part = (self.sums[end] - self.sums[start]) * _power(self.k, True, len(self.sums))[start]
        return _mix(part + (end - start).astype(np.uint64), 0)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _minima(h: np.ndarray, window: int, broken: np.ndarray) -> np.ndarray:
    """Positions of h that are the minimum of some whole window; broken: windows, by their begin, that don't count."""
    n = len(h)
    best, span = h, 1  # sliding minimum by doubling
    while span * 2 <= window:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    m = n - window + 1
    if span < window:
        best = np.minimum(best[:m], best[window - span : window - span + m])
    best = np.where(broken[:m], np.uint64(0), best)
    edge = np.zeros(window - 1, dtype=np.uint64)
    top, span = np.concatenate([edge, best, edge]), 1  # the largest minimum of the windows around a position
    while span * 2 <= window:
        top = np.maximum(top[:-span], top[span:])
        span *= 2
    if span < window:
        top = np.maximum(top[:n], top[window - span : window - span + n])
    return np.flatnonzero(top == h)


def anchors(codes: np.ndarray, gram: int, window: int, seams: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the winnowed grams; what is chosen depends on the text around it alone.

    seams: where one text ends and the next begins; nothing is chosen across them.
    """
    reach, where, prints = gram + window - 1, [], []
    broken = np.zeros(len(codes) + 1, dtype=np.int32)
    if seams is not None:
        np.add.at(broken, np.maximum(seams - reach + 1, 0), 1)
        np.add.at(broken, seams, -1)
    broken = np.cumsum(broken) > 0
    for at in range(0, max(1, len(codes) - reach + 1), _SLICE):
        part = codes[at : at + _SLICE + reach - 1]
        if len(part) < reach:
            break
        i = np.arange(len(part) - gram + 1)
        h = Prints(part).of(i, i + gram)
        p = _minima(h, window, broken[at:])
        where.append(p + at)
        prints.append(h[p])
    if not where:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    p, first = np.unique(np.concatenate(where), return_index=True)
    return p, np.concatenate(prints)[first]


def _batches(ids: pd.Series, texts: pd.Series, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least `least` code points, joined to arrays of about a slice: ids, starts (with the end), codes."""
    own, parts, size = [], [], 0
    for d, t in zip(ids, texts):
        if t is None or len(t) < least:
            continue
        own.append(d)
        parts.append(code_points(t))
        size += len(parts[-1])
        if size > _SLICE // 2:
            yield np.array(own, dtype=np.int64), np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
            own, parts, size = [], [], 0
    if own:
        yield np.array(own, dtype=np.int64), np.cumsum([0, *map(len, parts)]), np.concatenate(parts)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(gram: int, window: int, least: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, starts, codes in _batches(f["doc_id"], f["text"], least):
                p, h = anchors(codes, gram, window, starts[1:-1])
                d = np.searchsorted(starts, p, side="right") - 1
                yield pd.DataFrame({"h": _signed(h), "doc_id": ids[d], "pos": (p - starts[d]).astype(np.int32)})

    return run


def _node_rows(gram: int):
    """Each repeated anchor of a document with the edges, k-mers of two anchors and what stands between, beside it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {k: [] for k in ("doc_id", "ord", "node", "edge_in", "edge_out", "pos", "pos_before", "pos_after")}
            for d, t, where in zip(f["doc_id"], f["text"], f["where"]):
                p = np.sort(np.asarray(where, dtype=np.int64))
                prints = Prints(code_points(t))
                edge = _signed(prints.of(p[:-1], p[1:] + gram))
                out["doc_id"].append(np.full(len(p), d, dtype=np.int64))
                out["ord"].append(np.arange(len(p), dtype=np.int32))
                out["node"].append(_signed(prints.of(p, p + gram)))
                out["edge_in"].append(np.concatenate([[0], edge]))
                out["edge_out"].append(np.concatenate([edge, [0]]))
                out["pos"].append(p.astype(np.int32))
                out["pos_before"].append(np.concatenate([p[:1], p[:-1]]).astype(np.int32))
                out["pos_after"].append(np.concatenate([p[1:], p[-1:]]).astype(np.int32))
            if out["node"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def _probe_rows(gram: int, half: int):
    """An anchor with `half` more characters on either side: a window of the wanted length that holds the anchor holds
    one of the two, so most anchors of short repeats end here."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {k: [] for k in ("probe", "doc_id", "pos", "right")}
            for d, t, where in zip(f["doc_id"], f["text"], f["where"]):
                p = np.asarray(where, dtype=np.int64)
                prints = Prints(code_points(t))
                for right in (False, True):
                    s = p if right else p - half
                    q = p[(s >= 0) & (s + gram + half <= len(t))]
                    s = q if right else q - half
                    out["probe"].append(_signed(prints.of(s, s + gram + half)))
                    out["doc_id"].append(np.full(len(q), d, dtype=np.int64))
                    out["pos"].append(q.astype(np.int32))
                    out["right"].append(np.full(len(q), right))
            if out["probe"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def _window_rows(gram: int, half: int, min_len: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {k: [] for k in ("g", "doc_id", "s")}
            for d, t, probes, done in zip(f["doc_id"], f["text"], f["probes"], f["done"]):
                codes = code_points(t)
                last = len(codes) - min_len
                mark = np.zeros(last + 2, dtype=np.int32)  # windows that hold a repeated probe
                at = np.array([x["pos"] - (0 if x["right"] else half) for x in probes], dtype=np.int64)
                lo, hi = np.maximum(at + gram + half - min_len, 0), np.minimum(at, last)
                np.add.at(mark, lo[lo <= hi], 1)
                np.add.at(mark, hi[lo <= hi] + 1, -1)
                todo = np.cumsum(mark[:-1]) > 0
                for span in done if done is not None else ():
                    todo[span["a"] : span["b"] + 1] = False
                s = np.flatnonzero(todo)
                if len(s):
                    out["g"].append(_signed(Prints(codes, 1).of(s, s + min_len)))
                    out["doc_id"].append(np.full(len(s), d, dtype=np.int64))
                    out["s"].append(s.astype(np.int32))
            if out["s"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return run


def _in_several(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur in two or more documents; partial aggregation keeps a hot key small."""
    ends = df.groupBy(*keys).agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    return ends.where("_lo < _hi").select(*keys)


def merge_stretches(spans: DataFrame) -> DataFrame:
    """Overlapping or touching (doc_id, s, e) as maximal stretches; a group is the spans of one document."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach >= F.col("s"), 0).otherwise(1))
    return (
        marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_island")
        .agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos"))
        .drop("_island")
    )


def shared_spans(docs: DataFrame, min_len: int = 100, gram: int = 50) -> DataFrame:
    """Maximal stretches of each document in which every character lies in a span of `min_len` code points that occurs
    verbatim in another document: (doc_id, start_pos, end_pos).

    docs: doc_id long (unique), text string; other columns are ignored. A null text, or one shorter than min_len, has
    no stretch. A document's own repetitions don't count, exact copies in other documents do. An empty table gives an
    empty result.
    """
    gram = min(gram, max(1, min_len // 2))
    window = min_len - gram + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    half = (min_len - gram) // 2
    found = materialize(docs.mapInPandas(_anchor_rows(gram, window, min_len), "h long, doc_id long, pos int"))
    repeated = found.join(_in_several(found, "h"), "h", "left_semi")
    # as long as its document at most; written, so that the anchors' files are gone before the texts are shuffled
    per_doc = materialize(repeated.groupBy("doc_id").agg(F.collect_list("pos").alias("where")))
    release(found)
    held = materialize(per_doc.join(docs, "doc_id"))
    release(per_doc)

    places = materialize(
        held.mapInPandas(_node_rows(gram), "doc_id long, ord int, node long, edge_in long, edge_out long, pos int, pos_before int, pos_after int")
    )
    # a node is inside a path if all its occurrences, in whatever document, have the same edge before and after it
    inner = (
        places.groupBy("node")
        .agg(*[f(k).alias(f"{n}_{k}") for k in ("edge_in", "edge_out") for n, f in (("lo", F.min), ("hi", F.max))])
        .where("lo_edge_in = hi_edge_in and lo_edge_out = hi_edge_out and lo_edge_in != 0 and lo_edge_out != 0")
        .select("node")
    )
    w = Window.partitionBy("doc_id").orderBy("ord")
    unitigs = (
        places.join(inner, "node", "left_semi")
        .withColumn("_path", F.col("ord") - F.row_number().over(w))
        .groupBy("doc_id", "_path")
        .agg(F.min("pos_before").alias("s"), (F.max("pos_after") + gram).alias("e"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        .where(F.col("e") - F.col("s") >= min_len)
    )
    # every document with a window that holds an inside node holds the whole path: those windows need no look
    unitigs = materialize(
        unitigs.select(
            "doc_id",
            "s",
            "e",
            F.greatest("s", F.col("first") + (gram - min_len)).alias("a"),
            F.least(F.col("e") - min_len, F.col("last")).alias("b"),
        )
    )
    done = unitigs.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("done"))
    probed = materialize(held.mapInPandas(_probe_rows(gram, half), "probe long, doc_id long, pos int, right boolean"))
    probes = probed.join(_in_several(probed, "probe"), "probe", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "right")).alias("probes"))
    texts = held.select("doc_id", "text").join(probes, "doc_id").join(done, "doc_id", "left")
    windows = materialize(texts.mapInPandas(_window_rows(gram, half, min_len), "g long, doc_id long, s int"))
    release(held, places, probed)
    verified = windows.join(_in_several(windows, "g"), "g", "left_semi")
    return merge_stretches(unitigs.select("doc_id", "s", "e").unionByName(verified.select("doc_id", "s", (F.col("s") + min_len).alias("e"))))


def shared_share(docs: DataFrame, min_len: int = 100) -> DataFrame:
    """For each document its length, how many characters are shared elsewhere and their share; null or empty text: 0."""
    spans = shared_spans(docs, min_len).groupBy("doc_id").agg(
        F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"), F.count("*").alias("n_stretches")
    )
    size = F.coalesce(F.length("text"), F.lit(0))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_chars"))
    filled = own.join(spans, "doc_id", "left").fillna(0, ["n_shared", "n_stretches"])
    return filled.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("n_shared") / F.col("n_chars"), 6)).otherwise(0.0))
