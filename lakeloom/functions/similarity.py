"""Similarity by matching blocks, which built-in functions cannot express. Arrow functions over pairs of texts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters; 1 for two empty texts; a missing text is empty."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _block_f1(a: str | None, b: str | None) -> float:
    x, y = (a or "").lower().split(), (b or "").lower().split()
    if not x or not y:
        return 0.0
    same = sum(m.size for m in SequenceMatcher(None, y, x).get_matching_blocks())
    return 2 * same / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def block_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """Harmonic mean of the shares of both texts' lower-case words that stand in matching blocks; 0 if one has none."""
    return pd.Series([_block_f1(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_counts(before: Column, after: Column) -> Column:
    """(replaced, inserted, deleted, equal): characters by what turns ``before`` into ``after``: those of ``before`` that are
    replaced, deleted or kept, and those of ``after`` that are inserted. Quadratic in the texts' lengths at worst."""

    @F.pandas_udf("replaced long, inserted long, deleted long, equal long")
    def counts(a, b):
        import difflib

        import pandas as pd

        rows = []
        for x, y in zip(a, b, strict=True):
            n = dict.fromkeys(("replace", "insert", "delete", "equal"), 0)
            for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes():
                n[tag] += j2 - j1 if tag == "insert" else i2 - i1
            rows.append((n["replace"], n["insert"], n["delete"], n["equal"]))
        return pd.DataFrame(rows, columns=["replaced", "inserted", "deleted", "equal"])

    return counts(before, after)
