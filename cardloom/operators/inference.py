"""Running a token classifier over cards: the relational part, the model being a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.sequence import aggregate_confidence, label_islands, token_offsets

#: Takes the words of one text and gives (label, confidence) of each.
Predict = Callable[[list[str]], list[tuple[str, float]]]


def predict_words(cards: DataFrame, predict: Predict) -> DataFrame:
    """card, tok_ord, token, start_pos, end_pos, label, conf of the words of every card, in Arrow batches."""
    words = token_offsets(cards)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, own in f.groupby("card", sort=False):
                own = own.sort_values("tok_ord")
                found = predict(own["token"].tolist())
                out.append(own.assign(label=[x for x, _ in found], conf=[float(c) for _, c in found]))
            if out:
                yield pd.concat(out)

    whole = words.repartition("card").sortWithinPartitions("card", "tok_ord")  # a card's words together
    return whole.mapInPandas(run, "card string, tok_ord int, token string, start_pos int, end_pos int, label string, conf double")


def predicted_spans(words: DataFrame, how: str = "mean", least: float | None = None) -> DataFrame:
    """card, island, label, n, first, last, confidence: runs of equal labels but 'O', with the aggregated confidence of their
    words; least: runs below it are left out, unset none is."""
    runs = aggregate_confidence(label_islands(words, "card", ["start_pos", "tok_ord"], "label", "conf").where("label != 'O'"), how)
    return runs if least is None else runs.where(F.col("confidence") >= least)
