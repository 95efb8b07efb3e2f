"""Several values packed in one field (problem 3).

Method: the delimiter of a field is inferred, not given. Every candidate splits the field; a candidate scores by how
regular the types of its pieces are and how usual their number is, both measured over the whole column. The best one
splits the field, and the pieces are exploded with their position.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.runtime import materialize

#: Candidate marks before the subfields of a line.
MARKS = ("$$", "$", "|", "‡", "\x1f", "^", "#", "@", "¦", "§")
#: Candidate delimiters between the values of a list field, as patterns.
BETWEEN = {
    "tab": r" *\t\s*",
    "semicolon": r"\s*;\s*",
    "bar": r"\s*\|\s*",
    "comma": r"\s*,\s*",
    "plus": r"(?:\s+|^)\+(?:\s+|$)",
    "slash": r"(?:\s+|^)/(?:\s+|$)",
    "wide": r" {2,}",
    "space": r"\s+",
}
_QUOTED = re.compile(r'(?<![^\s;|,+/])"((?:[^"]|"")*)"(?![^\s;|,+/])')
_ATOM = "\ue000"
_DIGITS, _LARGE, _SMALL = (regex.compile(p) for p in (r"[0-9]+", r"\p{Lu}+", r"\p{Ll}+"))


def shape(text: Column) -> Column:
    """The type of a piece: runs of digits, capitals and small letters as one character each."""
    t = F.regexp_replace(text, r"\d+", "9")
    t = F.regexp_replace(t, r"\p{Lu}+", "A")
    return F.regexp_replace(t, r"\p{Ll}+", "a")


def _shape(text: str) -> str:
    return _SMALL.sub("a", _LARGE.sub("A", _DIGITS.sub("9", text)))


def strip(text: Column) -> Column:
    """Without white space at the ends; control characters that serve as delimiters stay."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def unquote(text: Column) -> Column:
    """Without the quotes around a whole field, doubled ones inside made single; other text unchanged."""
    whole = text.rlike(r'(?s)^"([^"]|"")*"$') & (F.length(text) >= 2)
    inner = F.regexp_replace(F.regexp_replace(text, r'(?s)^"(.*)"$', "$1"), '""', '"')
    return F.when(whole, inner).otherwise(text)


def unpack_marked(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Values of fields whose every value follows a mark and a one-character code: keys, pos, code, piece.

    The mark may change from row to row. A null, blank or unmarked field gives no row; an empty value has no position.
    Rows that agree in keys and field count once. pos counts the non-empty values from 0.
    """
    rows = materialize(df.select(*keys, F.col(column).alias("_f")).where(F.trim("_f") != "").distinct())

    def cut(body: Column) -> Column:
        leading = F.filter(F.array(*map(F.lit, MARKS)), lambda m: F.startswith(body, m))
        pieces = lambda m: F.split(body, F.concat(F.lit(r"\Q"), m, F.lit(r"\E")), -1)
        return F.transform(leading, lambda m: F.struct(m.alias("mark"), pieces(m).alias("p")))

    tried = rows.select(*keys, _let(strip(unquote(strip(F.col("_f")))), cut).alias("_c"))
    # types of pieces and their usual number, over all rows; both tables are bounded by their least share
    code = lambda p: F.regexp_extract(p, r"^([\p{Alnum}])", 1)
    kinds = lambda c: F.concat(F.transform(F.slice(c["p"], 2, 1 << 20), lambda p: _kind("code", code(p))), F.array(_kind("count", F.size(c["p"]).cast("string"))))
    found = _usual(tried, F.flatten(F.transform("_c", kinds)), {"code": 0.001, "count": 0.0005})
    codes, counts = found["code"], found["count"]
    regular = [c for c in codes if c]
    usual = F.create_map(*[F.lit(x) for n, s in counts.items() for x in (n, float(s))]) if counts else F.create_map(F.lit(""), F.lit(0.0))

    def score(c: Column) -> Column:
        n = F.size(c["p"]) - 1
        good = F.size(F.filter(F.slice(c["p"], 2, 1 << 20), lambda p: code(p).isin(regular)))
        common = F.coalesce(F.try_element_at(usual, F.size(c["p"]).cast("string")), F.lit(0.0))
        return good / n + 0.01 * common

    best = F.array_max(F.transform(F.col("_c"), lambda c: F.struct(score(c).alias("score"), F.length(c["mark"]).alias("n"), c["p"].alias("p"))))
    value = lambda p: F.struct(F.substring(p, 1, 1).alias("code"), strip(F.substring(p, 2, 1 << 30)).alias("piece"))
    values = F.filter(F.transform(F.slice(best["p"], 2, 1 << 20), value), lambda v: v["piece"] != "")
    return tried.select(*keys, F.posexplode(values).alias("pos", "_p")).select(*keys, "pos", "_p.code", "_p.piece")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; the optimizer copies a plain alias into each of its uses."""
    return F.transform(F.array(value), use)[0]


def _kind(what: str, kind: Column) -> Column:
    return F.struct(F.lit(what).alias("what"), kind.alias("kind"))


def _usual(df: DataFrame, kinds: Column, least: dict[str, float]) -> dict[str, dict[str, float]]:
    """By what, the kinds with at least the least share of all of that, so 1 / least of them at most, with their share; one pass
    over the rows. kinds: array of (what, kind)."""
    counts = df.select(F.explode(kinds).alias("x")).groupBy("x.what", "x.kind").agg(F.count("*").alias("n"))
    total = counts.groupBy("what").agg(F.sum("n").alias("total"))  # a row for each what
    floor = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    kept = counts.join(F.broadcast(total), "what").where((F.col("n") >= F.col("total") * floor[F.col("what")]) & F.col("kind").isNotNull())
    out: dict[str, dict[str, float]] = {what: {} for what in least}
    for r in kept.collect():
        out[r["what"]][r["kind"]] = r["n"] / r["total"]
    return out


def _cover(words: list[str], regular: frozenset[str]) -> list[str] | None:
    """The words as the fewest pieces of regular type, if they can be cut so."""
    most = max((k.count(" ") for k in regular), default=0) + 1  # as many words as a regular type has
    best: list[list[str] | None] = [[]] + [None] * len(words)
    for j in range(1, len(words) + 1):
        for i in range(max(0, j - most), j):
            piece = " ".join(words[i:j])
            if best[i] is not None and ((len(piece) == 1 and piece >= _ATOM) or _shape(piece) in regular):
                if best[j] is None or len(best[i]) + 1 < len(best[j]):
                    best[j] = [*best[i], piece]
    return best[-1]


def split_list(field: str, regular: frozenset[str], usual: dict[int, float] | None = None) -> list[str]:
    """The values of one list field; regular: types of a single value; usual: share of fields by number of values."""
    atoms: list[str] = []

    def hold(m: re.Match) -> str:
        atoms.append(m.group(1).replace('""', '"').strip())
        return chr(ord(_ATOM) + len(atoms) - 1)

    text = _QUOTED.sub(hold, field.strip()) if '"' in field else field.strip()

    def is_regular(p: str) -> bool:
        return (len(p) == 1 and p >= _ATOM) or _shape(p) in regular

    def cut(part: str) -> list[str]:  # what is cut at one delimiter holds none of it, so this ends
        part = re.sub(r"^(?:[\s;|,+]|/(?=\s))+|(?:[\s;|,+]|(?<=\s)/)+$", "", part)
        if is_regular(part):
            return [part]
        best, found = (-1.0,), [part]
        for name, pattern in BETWEEN.items():
            pieces = [p for p in re.split(pattern, part) if p and p.strip()]
            if name == "space":
                pieces = _cover(part.split(), regular) or [part]
            if pieces == [part]:
                continue
            share = sum(map(is_regular, pieces)) / len(pieces) if pieces else 0.0
            score = (share, (usual or {}).get(len(pieces), 0.0) - 1e-6 * len(pieces))
            if score > best:
                best, found = score, pieces
        if best[0] <= 0:
            return [part]
        return [x for p in found for x in cut(p.strip())]

    values = [p.strip() for p in cut(text) if p.strip()]
    return [v for v in (atoms[ord(p) - ord(_ATOM)] if len(p) == 1 and p >= _ATOM and ord(p) - ord(_ATOM) < len(atoms) else p for p in values) if v]


def unpack_list(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Values of fields that hold a list: keys, pos, piece.

    The delimiter may change from row to row and within a row; a quoted stretch is one value. A null or blank field
    gives no row. Rows that agree in keys and field count once. pos counts the non-empty values from 0.
    """
    rows = materialize(df.select(*keys, F.col(column).alias("_f")).where(F.trim("_f") != "").distinct())
    one = strip(F.col("_f"))
    # how many values a field usually has, by the single most telling sign: how often each delimiter stands in it
    signs = reduce(lambda a, b: F.greatest(a, b), [F.size(F.split(one, p)) for p in (r"\t", ";", r"\|", ",", r" \+", r" /")])
    types_of = F.when(~F.contains(F.col("_f"), F.lit('"')), F.array(_kind("type", shape(one)))).otherwise(F.array().cast("array<struct<what:string,kind:string>>"))
    found = _usual(rows, F.concat(types_of, F.array(_kind("count", signs.cast("string")))), {"type": 0.002, "count": 0.001})
    kinds = found["type"]
    # a type that another candidate cuts into types just as usual is no type of a single value
    known = {k for k in kinds if k}
    regular = frozenset(k for k in known if not any(len(q := [p for p in re.split(b, k) if p.strip()]) > 1 and all(p in known for p in q) or (len(q) == 1 and q[0] != k) for b in BETWEEN.values()))
    usual = {int(n): s for n, s in found["count"].items()}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["piece"] = [split_list(x, regular, usual) for x in f["_f"]]
            f["pos"] = [list(range(len(p))) for p in f["piece"]]
            yield f.drop(columns="_f").explode(["piece", "pos"]).dropna(subset=["piece"]).astype({"pos": "int32"})[[*keys, "pos", "piece"]]

    return rows.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "pos int", "piece string"]))


def in_packed(values: DataFrame, keys: list[str]) -> DataFrame:
    """Only the values of fields that hold two or more."""
    many = values.where("pos = 1").select(*keys)
    return values.join(many, keys, "left_semi")
