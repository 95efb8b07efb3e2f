"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies: a parameter of every operator that counts tokens.
DEFAULT_VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with the number of tokens of the text; a null text has 0."""
    keep = keep or tuple(c for c in df.columns if c not in (text, into))
    rows = df.select(*keep, F.col(text).alias("_text"))
    df.sparkSession.sparkContext.addFile(vocabulary)  # the workers get their own copy
    name = os.path.basename(vocabulary)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(SparkFiles.get(name)).encode_ordinary
        for f in frames:
            yield f.assign(**{into: [len(encode(t)) if isinstance(t, str) else 0 for t in f["_text"]]})[[*keep, into]]

    return rows.mapInPandas(count, ", ".join([*(f"{c} {types[c]}" for c in keep), f"{into} long"]))
