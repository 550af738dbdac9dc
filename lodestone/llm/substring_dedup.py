"""Repeated passages of words, found by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .pieces import removed

SPAN, GRAM = 35, 8


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """df without text_col, and: n_symbols (words of the text), n_removed, kept_bytes (the words that are left, joined by a space),
    spans (binary: the removed runs of words as pairs of little-endian int32, start and end).

    Removed is every word under a window of `span` words whose sequence also starts anywhere else, in the same text too.
    Null, empty and blank texts have no words. Rows stand for themselves: a repeated row removes its twin's words too.
    Every row of df comes out once; ids may be null; columns with clashing names are replaced.
    """
    return removed(df, "Factors", True, span, gram, True, id_col, text_col)
