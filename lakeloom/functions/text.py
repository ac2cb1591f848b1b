"""Column functions over text: cleaning, extraction, scores. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation marks and articles that answer normalisation removes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
OPTION_LETTERS = "ABCDEFGHIJ"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def plain_answer(text: Column) -> Column:
    """Punctuation out (letters, digits, underscores and white space stay), lower case, trimmed."""
    return stripped(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", "")))


def first_clause(text: Column) -> Column:
    """What stands before the first semicolon, trimmed, in lower case."""
    return F.lower(stripped(F.split_part(text, F.lit(";"), F.lit(1))))


def list_answer(text: Column) -> Column:
    """Brackets and quotes out, underscores to blanks, trimmed."""
    return stripped(F.translate(F.regexp_replace(text, r"[\[\]']", ""), "_", " "))


def squad_normal(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, white space as single blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), r"\s+", " "))


def option_letter(text: Column, last: str = "D") -> Column:
    """The first option letter that stands by itself; null without one."""
    return F.nullif(F.regexp_extract(text, rf"\b([A-{last}])\b", 1), F.lit(""))


def numbers(text: Column) -> Column:
    """All numbers in the text, as strings."""
    return F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))


def between_tags(text: Column, tag: str = "answer") -> Column:
    """What stands in the first <tag>...</tag>, trimmed; null without one."""
    inside = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(inside), stripped(F.regexp_extract(text, inside, 1)))


def caption(*fields: Column, default: str = "Image.") -> Column:
    """The first field that is there; the default where that is blank or all are missing."""
    chosen = F.coalesce(*fields)
    return F.when(stripped(F.coalesce(chosen, F.lit(""))) == "", F.lit(default)).otherwise(chosen)


def points_text(points: Column, label: Column) -> Column:
    """Points (structs x, y) as ``<points coords="1 1 x y;1 2 x y">label</points>``.

    Points with both values up to 100 are per cents and count in thousandths; values are cut, not rounded. A point
    with a missing value is left out, and later points keep their numbers."""

    def one(p: Column, i: Column) -> Column:
        percent = (p["x"] <= 100) & (p["y"] <= 100)
        cut = lambda v: F.when(percent, (v * 10).cast("int")).otherwise(v.cast("int")).cast("string")
        return F.when(p["x"].isNotNull() & p["y"].isNotNull(), F.concat_ws(" ", F.lit("1"), (i + 1).cast("string"), cut(p["x"]), cut(p["y"])))

    return F.concat(F.lit('<points coords="'), F.array_join(F.array_compact(F.transform(points, one)), ";"), F.lit('">'), label, F.lit("</points>"))


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-case words; 0 where both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def ngrams(bag: Column, n: int) -> Column:
    """Runs of n neighbouring elements, joined."""
    starts = F.when(F.size(bag) >= n, F.sequence(F.lit(1), F.size(bag) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(bag, i, n), "\u0001"))


# ---- rewards -----------------------------------------------------------------------------------------------------


def tag_reward(text: Column) -> Column:
    """An eighth for each of the four answer tags that stands exactly once, and a quarter if they stand in order."""
    tags = ["<reasoning>", "</reasoning>", "<answer>", "</answer>"]
    once = [F.when(F.size(F.split(text, t)) == 2, 0.125).otherwise(0.0) for t in tags]
    ordered = F.when(text.rlike(r"(?s)<reasoning>.*</reasoning>.*<answer>.*</answer>"), 0.25).otherwise(0.0)
    return reduce(lambda a, b: a + b, [*once, ordered])


def concise_reward(text: Column) -> Column:
    """By words: under 10 nothing, up to 300 one, up to 600 a half, beyond nothing."""
    n = word_count(text)
    return F.when(n < 10, 0.0).when(n <= 300, 1.0).when(n <= 600, 0.5).otherwise(0.0)


def correct_reward(text: Column, answer: Column) -> Column:
    """One if equal (trimmed, lower case), a half if the answer is contained, else nothing; nothing without answer."""
    t, a = F.lower(stripped(text)), F.lower(stripped(answer))
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(t == a, 1.0).when(F.contains(t, a), 0.5).otherwise(0.0)
