"""Column functions that turn raw records into training samples. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import caption, points_text, stripped

# The delimiters a list of numbers is tried with, in this order.
DELIMITERS = (",", " ", "\t", ";")
# First bytes of image formats (hexadecimal).
MAGIC = {"jpg": "FFD8FF", "png": "89504E470D0A1A0A", "gif": "47494638", "bmp": "424D", "tif": "49492A00"}


def sample_text(turns: Column, points: Column, label: Column, text: Column, min_turns: int = 2) -> Column:
    """(text, kind) of a sample: its turns (structs role, content) if it has turns at all and at least ``min_turns``;
    without turns its points with their label; else its caption. A short conversation falls to the caption."""
    chat = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    pointed = turns.isNull() & (F.size(F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>"))) > 0) & (F.coalesce(label, F.lit("")) != "")
    return (
        F.when(F.coalesce(F.size(turns), F.lit(0)) >= min_turns, F.struct(chat.alias("text"), F.lit("pointing_conversation").alias("kind")))
        .when(pointed, F.struct(points_text(points, label).alias("text"), F.lit("pointing_pixmo").alias("kind")))
        .otherwise(F.struct(caption(text, default="An image.").alias("text"), F.lit("caption").alias("kind")))
    )


def number_list(text: Column) -> Column:
    """Numbers of a text: a bracketed list, else what the first delimiter that gives more than one value gives; null
    where nothing does or a value is no number."""

    def cut(body: Column, by: str) -> Column:
        parts = F.filter(F.split(body, by if by != " " else r" +"), lambda x: F.trim(x) != "")
        values = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
        return F.when(F.forall(values, lambda v: v.isNotNull()), values)

    bracketed = text.rlike(r"^\s*\[.*\]\s*$")
    inside = cut(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ",")
    tried = [F.when(F.size(v) > 1, v) for v in (cut(text, d) for d in DELIMITERS)]
    return F.when(bracketed, inside).otherwise(F.coalesce(*tried))


def rectangle(rows: Column) -> Column:
    """Rows of numbers with zeros up to the length of the longest."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), width - F.size(r))))


def upright(rows: Column) -> Column:
    """Rows and columns exchanged where there are fewer rows than columns."""
    wide = F.size(rows) < F.size(rows[0])
    turned = F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda k: F.transform(rows, lambda r: r[k]))
    return F.when(wide, turned).otherwise(rows)


def with_statistics(prompt: Column, means: Column, deviations: Column, marker: str = "<ts>") -> Column:
    """After each marker of the prompt the mean and deviation of the series it stands for, as long as there are some."""
    parts = F.split(prompt, rf"\Q{marker}\E")
    told = lambda i: F.format_string(f"{marker} Mean: %.2f, Std: %.2f ", means[i], deviations[i])
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == last, p).when(i < F.size(means), F.concat(p, told(i))).otherwise(F.concat(p, F.lit(marker)))), "")


def table_text(header: Column, rows: Column, width: int = 50) -> Column:
    """Lines of a table, cells cut to ``width`` characters and joined by bars; missing cells are empty."""
    line = lambda r: F.array_join(F.transform(r, lambda c: F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, width)), " | ")
    return F.array_join(F.concat(F.array(line(header)), F.transform(rows, line)), "\n")


def kept_edges(edges: Column, nodes: int = 128) -> Column:
    """Edges (structs src, dst) between the first ``nodes`` nodes."""
    return F.filter(edges, lambda e: (e["src"] < nodes) & (e["dst"] < nodes))


def motifs(smiles: Column) -> Column:
    """Names of the bond kinds and rings a SMILES string shows, comma-joined."""
    shown = [F.when(F.contains(smiles, F.lit(mark)), name) for mark, name in (("=", "Double Bond"), ("#", "Triple Bond"), ("1", "Ring"))]
    return F.concat_ws(", ", *shown)


def repaired_path(path: Column, root: str, folder: str = "images/") -> Column:
    """Absolute paths stay; of others what follows the last ``folder``, else the file's name, goes under ``root``."""
    tail = F.when(F.contains(path, F.lit(folder)), F.concat(F.lit(folder), F.element_at(F.split(path, folder), -1))).otherwise(F.regexp_extract(path, r"[^/]*$", 0))
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), tail))


def first_text(*fields: Column) -> Column:
    """The first field that is neither missing nor blank."""
    return F.coalesce(*(F.when(stripped(c) != "", c) for c in fields))


def image_kind(content: Column) -> Column:
    """Image format by first bytes; null if none fits."""
    start = F.hex(F.substring(content, 1, 12))
    webp = start.startswith("52494646") & (F.substring(start, 17, 8) == "57454250")
    return F.coalesce(*(F.when(start.startswith(magic), kind) for kind, magic in MAGIC.items()), F.when(webp, "webp"))


def loose_json(text: Column) -> Column:
    """The JSON in an answer: the whole of it, what stands in a code fence, or from the first { to the last }; null if
    none of them parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(*(F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in map(stripped, (text, fenced, braced))))


def sentences(text: Column, most: int | None = None) -> Column:
    """Sentences: cuts in white space after a point, an exclamation or a question mark; at most the first ``most``."""
    parts = F.filter(F.split(stripped(text), r"(?<=[.!?])\s+"), lambda s: s != "")
    return parts if most is None else F.slice(parts, 1, most)


def split_answer(text: Column, mark: str = "Answer:") -> Column:
    """(question, answer) around the first mark; the answer is null without one."""
    at = F.instr(text, mark)
    cut = F.when(at > 0, F.substring_index(text, mark, 1)).otherwise(text)
    return F.struct(stripped(F.regexp_replace(cut, r"^\s*Question:", "")).alias("question"), F.when(at > 0, stripped(F.substr(text, at + len(mark)))).alias("answer"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(a.bitwiseXOR(b))


def rendered_turns(role_contents: Column, end: str = "") -> Column:
    """A prompt of turns (structs role, content), each between its marks, for models that take such turns."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(role_contents, one), ""), F.lit(end))


def choices_text(question: Column, options: Column) -> Column:
    """A question with its options under letters from A on, asking for one."""
    letters = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(letters, "\n"), F.lit("\nAnswer:"))
