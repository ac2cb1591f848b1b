"""Fill-in-the-middle: texts cut into prefix, middle and suffix at seeded places, and put together in another order.

One Arrow-batched pandas UDF does the work: a compiled pattern walks over a text's units and their end offsets go into a
compact array, two lookups in it give the places to cut at, and hashlib gives seeds and digests. What is drawn follows
from the seed and the document's id alone, so reruns and lost executors give the same rows."""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: white space and the word after it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """Where each unit ends, in code points."""
    return array("q", (m.end() for m in pattern.finditer(text)))


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made of."""
    if form == "plain":
        return output
    if form == "psm":
        head, _, middle = output[len(PREFIX) :].partition(MIDDLE)
        prefix, _, suffix = head.partition(SUFFIX)
    else:
        suffix, _, rest = output[len(SUFFIX) :].partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rearranged(key: str, text: str, seed: int, changed: int, suffix_first: int, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix and middle in code points, output) of one text."""
    ends = unit_ends(text, pattern)
    n, digest = len(ends), hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= changed:
        return n, "plain", None, None, text
    first, second = sorted(x % (n + 1) for x in h[:2])
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, changed: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text, if none are named) as a struct ``row``; n, form, prefix_chars,
    middle_chars, output, output_sha256 and restored_sha256 (that of the text rebuilt from output and form).

    n: units of the text. form: plain for empty texts, for those that hold a mark, and for all but ``changed`` of 100
    others; else spm for ``suffix_first`` of 100, else psm. Draws follow from seed and id, so rows that repeat an id cut
    alike where their texts have equally many units; a null id draws as an empty one. A null text is an empty one. Texts
    are worked on whole, also very long ones: eight bytes a unit, the text, its output and the rebuilt text are held of
    one at a time, beside a batch's texts and outputs. An empty table gives an empty result; clashing names stay inside
    row. Without ``texts`` output is null, so that digests alone are sent back."""
    pattern = regex.compile(UNIT)

    @F.pandas_udf(_SHAPE)
    def cut(keys: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for key, text in zip(keys, own, strict=True):
            n, form, prefix, middle, output = rearranged(key, text, seed, changed, suffix_first, pattern)
            out.append((n, form, prefix, middle, output if texts else None, _sha256(output), _sha256(restored(output, form))))
        made = pd.DataFrame(out, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"])
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(F.struct(*(keep or [c for c in docs.columns if c != text_col])).alias("row"), cut(blank(id_col), blank(text_col)).alias("made"))
    return source.select("row", "made.*")


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of (null where one of them is)."""

    @F.pandas_udf("string")
    def rebuilt(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return rebuilt(output, form)


#: The same for DuckDB; what is rebuilt is the text itself.
FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
  SELECT *, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS x,
    list_transform(regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'), lambda u: length(u)) AS u FROM d
), n AS (
  SELECT *, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 AS plain FROM h
), c AS (
  SELECT *, coalesce(list_sum(u[1:least(x[1] % (n + 1), x[2] % (n + 1))]), 0) AS a, coalesce(list_sum(u[1:greatest(x[1] % (n + 1), x[2] % (n + 1))]), 0) AS b FROM n
), f AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    substr(t, 1, CAST(a AS BIGINT)) AS p, substr(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS m, substr(t, CAST(b AS BIGINT) + 1) AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
