"""Keyword labels from a description."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeflow.functions.text import as_col

# Keywords, in the order they are reported.
KEYWORDS = (
    "person", "people", "car", "building", "tree", "animal",
    "dog", "cat", "food", "nature", "urban", "indoor", "outdoor",
)
MAX_LABELS = 5


def keyword_labels(text: Column | str, words: tuple[str, ...] = KEYWORDS, limit: int = MAX_LABELS) -> Column:
    """Keywords that occur anywhere in the text, the first ``limit`` in list order."""
    folded = F.lower(as_col(text))
    none = F.array().cast("array<string>")
    found = F.concat(*[F.when(folded.contains(w), F.array(F.lit(w))).otherwise(none) for w in words])
    return F.slice(found, 1, limit)
