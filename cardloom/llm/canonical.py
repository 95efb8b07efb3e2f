"""Visually identical text with different characters (problem 4).

Method: every Arrow batch is a DuckDB relation inside its partition. Embedded SQL composes with nfc_normalize, maps
width and ligature forms with translate and replace, drops what can't be seen with regular expressions and brings
look-alike letters of other scripts to Latin (or, inside a word that is really Cyrillic or Greek, Latin ones to that
script).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like a Latin letter, by script.
CYRILLIC = "АВЕЅЗІЈКМНОРСТУХҮԚԜаеѕіјорсухһԁԛԝ"
CYRILLIC_AS = "ABESZIJKMHOPCTYXYQWaesijopcyxhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκχ"
GREEK_AS = "ABEZHIKMNOPTYXovaipukx"
# Spaces that look like a space; characters that can't be seen.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
UNSEEN = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
# Ligatures, each with its letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
WIDE_AS = "".join(map(chr, range(0x21, 0x7F)))

#: Letters that only a look-alike alphabet has: a word with one is really of that script. The Cyrillic letters ѕ, і, ј
#: are in no Russian word and so never make a word Cyrillic.
_ALIKE = "".join(sorted(set(CYRILLIC + GREEK)))
_WORD = r"[\p{L}\p{M}\p{N}]+"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(source: str, column: str = "txt") -> str:
    """Embedded SQL: rid, canon, is_disguised of each row of the relation `source` (rid, txt)."""
    ligatures = "nfc_normalize(translate(regexp_replace({0}, {1}, '', 'g'), {2}, {3}))".format(
        column, _lit(UNSEEN), _lit(WIDE + SPACES), _lit(WIDE_AS + " " * len(SPACES))
    )
    for form, letters in LIGATURES.items():
        ligatures = f"replace({ligatures}, {_lit(form)}, {_lit(letters)})"
    alike = f"[{_ALIKE}]"
    other = r"[\p{Cyrillic}\p{Greek}]"
    return f"""
    with plain as (select rid, {column} as txt, {ligatures} as flat from {source}),
    touched as (
        select rid, txt, flat, regexp_matches(flat, {_lit(other)}) as has_other from plain
    ),
    words as (
        select rid, unnest(w) as word, generate_subscripts(w, 1) as i
        from (select rid, regexp_extract_all(flat, {_lit(_WORD + "|[^" + _WORD[1:-2] + "]+")}) as w from touched where has_other)
    ),
    judged as (
        select *,
            regexp_matches(word, '\\p{{Latin}}') as latin,
            regexp_matches(regexp_replace(word, {_lit(alike)}, '', 'g'), {_lit(other)}) as truly_other,
            regexp_full_match(word, {_lit(alike + "+")}) as all_alike
        from words
    ),
    texts as (
        select rid, bool_or(truly_other and not latin and length(word) > 1) as other_text,
            bool_or(latin) as latin_text from judged group by rid
    ),
    mapped as (
        select j.rid, i,
            case
                when latin and truly_other
                    then translate(word, {_lit("ABEKMHOPCTXaeopcyx")}, {_lit("АВЕКМНОРСТХаеорсух")})
                when latin or regexp_matches(word, '[ѕіј]') or (all_alike and length(word) > 1 and latin_text and not other_text)
                    then translate(word, {_lit(CYRILLIC + GREEK)}, {_lit(CYRILLIC_AS + GREEK_AS)})
                else word
            end as word, word as was
        from judged j join texts using (rid)
    ),
    joined as (
        select rid, string_agg(word, '' order by i) as canon, bool_or(word <> was) as swapped from mapped group by rid
    )
    select t.rid, coalesce(j.canon, t.flat) as canon,
        t.txt is not null and (t.flat <> t.txt or coalesce(j.swapped, false)) as is_disguised
    from touched t left join joined j using (rid)
    """


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    for batch in batches:
        table = pa.table({"rid": pa.array(range(batch.num_rows), pa.int64()), "txt": batch.column("_txt")})
        con.register("part", table)
        found = con.sql(f"select canon, is_disguised from ({canonical_sql('part')}) order by rid").to_arrow_table()
        con.unregister("part")
        rest = [batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(
            [*rest, found["canon"].combine_chunks().cast(pa.string()), found["is_disguised"].combine_chunks()],
            names=[*batch.schema.names, "_canon", "_flag"],
        )


def canonical_texts(texts: list[str | None]) -> list[str | None]:
    """The one form of each text, in this process: for functions that go on with the texts, which need no second worker then."""
    if not texts:
        return []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["_txt"])
    return next(_run(iter([batch]))).column("_canon").to_pylist()


def canonicalize(df: DataFrame, column: str, into: str = "canon", flag: str = "is_disguised") -> DataFrame:
    """df with the one form of a text column, and whether the text was written otherwise.

    A null text stays null and isn't disguised; an empty one stays empty. Other columns are kept as they are; columns
    named like `into` or `flag` are replaced.
    """
    kept = df.drop(*[c for c in (into, flag) if c != column])
    packed = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), F.col(f"`{column}`").cast("string").alias("_txt"))
    row = packed.schema["_row"].dataType.simpleString()
    done = packed.mapInArrow(_run, f"_row {row}, _txt string, _canon string, _flag boolean")
    own = [F.col(f"_row.`{c}`").alias(c) for c in kept.columns if c != into]
    return done.select(*own, F.col("_canon").alias(into), F.col("_flag").alias(flag))


def disguised_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct keys of rows whose text was written with characters that only look like, or hide among, the usual ones."""
    rows = df.select(F.col(key).alias("rec_key"), F.col(column).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    return canonicalize(rows, "_t").where("is_disguised").select("rec_key").distinct()
