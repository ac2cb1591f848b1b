"""Column functions over raw records: captions, answers, series, metadata, tokens. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.samples import number_list
from lakeloom.functions.text import caption, stripped, words


def labelled_points(label: Column, points: Column) -> Column:
    """``label (x,y) (x,y)`` of structs x, y; points without both are left out."""
    told = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.array_join(F.concat(F.array(F.coalesce(label, F.lit(""))), F.transform(told, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit(")")))), " ")


def dense_caption(first: Column, other: Column, tag: str, id_: Column) -> Column:
    """(text, meta): the caption, else the other text, else "No caption"; blank texts are "An image."."""
    text = F.coalesce(first, other, F.lit("No caption"))
    return F.struct(caption(text, default="An image.").alias("text"), row_label(tag, id_).alias("meta"))


def typed_turns(messages: Column) -> Column:
    """(user, assistant, image) of messages (role, content: array of (type, text, image)): a role's texts joined by
    blanks, and the first image."""
    parts = F.flatten(F.transform(messages, lambda m: F.transform(m["content"], lambda c: F.struct(m["role"].alias("role"), c["type"].alias("type"), c["text"].alias("text"), c["image"].alias("image")))))
    said = lambda role: stripped(F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (p["role"] == role)), lambda p: p["text"]), " "))
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image"), lambda p: p["image"])
    return F.struct(said("user").alias("user"), said("assistant").alias("assistant"), F.when(F.size(images) > 0, images[0]).alias("image"))


def training_text(user: Column, assistant: Column, style: Column) -> Column:
    """The turns as a caption, a question with its answer, or a conversation (any other style)."""
    return F.when(style == "caption", assistant).when(style == "qa", F.concat(F.lit("Question: "), user, F.lit("\nAnswer: "), assistant)).otherwise(F.concat(F.lit("User: "), user, F.lit("\nAssistant: "), assistant))


def defined_label(task: Column, label: Column, definitions: dict[str, dict[str, str]], otherwise: dict[str, str], unknown: str = "This timeseries exhibits the following characteristic: {}.") -> Column:
    """A sentence on a label: for the first kind whose name the task holds, the label's definition of that kind, else
    the kind's own phrase (``{}``: the label); for other tasks ``unknown``."""
    clean = F.lower(stripped(label))

    def put(phrase: str, value: Column) -> Column:
        before, _, after = phrase.partition("{}")
        return F.concat(F.lit(before), value, F.lit(after))

    def sentence(kind: str) -> Column:
        known = F.create_map(*(F.lit(x) for pair in definitions[kind].items() for x in pair))
        return F.concat(F.lit("This timeseries has "), F.coalesce(F.try_element_at(known, clean), put(otherwise[kind], clean)), F.lit("."))

    cases = [(F.contains(F.lower(task), F.lit(kind)), sentence(kind)) for kind in definitions]
    first = F.when(*cases[0])
    for c, v in cases[1:]:
        first = first.when(c, v)
    return first.otherwise(put(unknown, stripped(label)))


def fixed_length(values: Column, length: int, dynamic: bool = False) -> Column:
    """The first ``length`` numbers, with zeros up to it unless ``dynamic``."""
    cut = F.slice(values, 1, length)
    return cut if dynamic else F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def question_and_target(prompts: list[Column], targets: list[Column], description: Column, characteristics: Column, text: Column) -> Column:
    """(prompt, target): the first field present of each; without both, the description as target of a fixed prompt;
    else what stands around the first ``Answer:`` of a text with ``Question:``, else the text as prompt."""
    prompt, target = F.coalesce(*prompts, F.lit("")), F.coalesce(*targets, F.lit(""))
    neither, described = (prompt == "") & (target == ""), F.coalesce(description, F.lit("")) != ""
    both = F.contains(text, F.lit("Question:")) & F.contains(text, F.lit("Answer:"))
    at = F.instr(text, "Answer:")
    asked = stripped(F.regexp_replace(F.substr(text, F.lit(1), at - 1), r"(?s)^(.*?)Question:", "$1"))
    told = F.concat(F.lit("Description: "), description, F.lit("\nCharacteristics: "), F.coalesce(characteristics, F.lit("")))
    return (
        F.when(~neither, F.struct(prompt.alias("prompt"), target.alias("target")))
        .when(described, F.struct(F.lit("Describe this time series.").alias("prompt"), stripped(told).alias("target")))
        .when(both, F.struct(asked.alias("prompt"), stripped(F.substr(text, at + 7)).alias("target")))
        .otherwise(F.struct(stripped(F.coalesce(text, F.lit(""))).alias("prompt"), F.lit("").alias("target")))
    )


def series_values(fields: list[Column], lists: list[Column], text: Column) -> Column:
    """The numbers of a record's series: those of the first text field present, a bracketed list; where
    it has none the first of ``lists`` with more than ten numbers; else what a text marked with ``###`` holds besides the
    marks, if all of it is numbers. Null where there is no series."""
    numbers = lambda c: F.when(c.rlike(r"^\s*\["), number_list(c))
    first = F.coalesce(*fields)
    long_ = F.coalesce(*(F.when((F.size(v) > 10) & F.get(v, F.lit(0)).isNotNull(), v.cast("array<double>")) for v in lists)) if lists else F.lit(None).cast("array<double>")
    parts = F.filter(F.split(F.replace(text, F.lit("###"), F.lit(" ")), r"\s+"), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    marked = F.when(F.contains(text, F.lit("###")) & F.forall(values, lambda v: v.isNotNull()), values)
    some = lambda v: F.when(F.size(v) > 0, v)
    return F.coalesce(some(numbers(first)), some(long_), some(marked))


def variates_kept(rows: Column, budget: int, length: int) -> Column:
    """The first rows of a multivariate series that leave a quarter of the budget free, one at least."""
    return F.slice(rows, 1, max(1, (budget - budget // 4) // length))


def instruction_pair(description: Column, short: Column, tiny: Column, characteristics: Column) -> Column:
    """(prompt, target): a fixed prompt with the characteristics, and the short, tiny or long description."""
    some = lambda c: F.nullif(stripped(c), F.lit(""))
    prompt = F.concat(F.lit("Describe this time series."), F.coalesce(F.concat(F.lit("\nCharacteristics:\n"), some(characteristics)), F.lit("")))
    return F.struct(prompt.alias("prompt"), F.coalesce(some(short), some(tiny), some(description)).alias("target"))


def about_text(title: str, facts: list[tuple[str, Column]]) -> Column:
    """A line of facts: the title, then ``name: value`` pairs; unknown ones are left out."""
    told = F.array(*(F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in facts))
    return F.concat(F.lit(f"{title} "), F.array_join(F.filter(told, lambda x: x.isNotNull()), ", "), F.lit("."))


def atoms_text(atoms: Column, most: int = 11) -> Column:
    """The first atoms (structs element, x, y, z) of a crystal, with two decimals, and how many more there are."""
    one = lambda a: F.format_string("%s(%.2f, %.2f, %.2f)", a["element"], a["x"], a["y"], a["z"])
    more = F.when(F.size(atoms) > most, F.format_string(" and %d more", F.size(atoms) - most)).otherwise("")
    return F.concat(F.array_join(F.transform(F.slice(atoms, 1, most), one), "; "), more)


def reasoned_chat(question: Column, reasoning: Column, answer: Column, end: str, prompt_only: bool = False) -> Column:
    """A user turn, and an assistant turn with its reasoning and answer in their marks; ``prompt_only``: up to where the
    assistant begins."""
    asked = F.concat(F.lit("<|im_start|>user\n"), question, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    if prompt_only:
        return asked
    return F.concat(asked, F.lit("<think>\n"), F.coalesce(reasoning, F.lit("")), F.lit("\n</think>\n<answer>"), F.coalesce(answer, F.lit("")), F.lit(f"</answer>{end}"))


def token_split(prompt: Column, joint: Column) -> Column:
    """(prompt_len, target_len) in words: the target's are those of the joint text less the prompt's."""
    n, every = F.size(words(prompt)), F.size(words(joint))
    return F.struct(n.cast("long").alias("prompt_len"), F.greatest(every - n, F.lit(0)).cast("long").alias("target_len"))


def prompt_words(text: Column, mark: str = "Answer:") -> Column:
    """Words up to and with the first mark; 0 without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.size(words(F.substr(text, F.lit(1), at + len(mark) - 1)))).otherwise(0).cast("long")


def projected_metadata(ids: list[Column], kept: dict[str, Column]) -> Column:
    """A JSON object of the first id as text and the kept fields that are not null."""
    fields = [F.coalesce(*(i.cast("string") for i in ids)).alias("id"), *(c.alias(name) for name, c in kept.items())]
    return F.to_json(F.struct(*fields))  # to_json leaves nulls out


def rendered_result(answer: Column, classes: Column, contain: Column, start: Column, rest: Column) -> Column:
    """A structured result as text: its answer; else its classes, comma-joined; else whether and from when it contains
    the event; else its JSON."""
    labels = F.filter(F.transform(classes, stripped), lambda x: x != "")
    held = F.concat(F.lit("contain="), F.initcap(contain.cast("string")))
    return F.coalesce(F.nullif(stripped(answer), F.lit("")), F.when(F.size(labels) > 0, F.array_join(labels, ", ")), F.when(contain.isNotNull(), F.concat(held, F.coalesce(F.concat(F.lit(", start_time="), start.cast("string")), F.lit("")))), rest)


def question_answer_text(question: Column, answer: Column, neither: str) -> Column:
    """``Question: …`` and ``Answer: …`` of what is not blank; ``neither`` where both are."""
    q, a = F.nullif(stripped(question), F.lit("")), F.nullif(stripped(answer), F.lit(""))
    both = F.concat_ws("\n", F.concat(F.lit("Question: "), q), F.concat(F.lit("Answer: "), a))
    return F.coalesce(F.nullif(both, F.lit("")), F.lit(neither))


def looked_up(key: Column, table: dict[str, str], default: Column | str) -> Column:
    """The key's entry of a short table, else the default."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.lit(default) if isinstance(default, str) else default)


def first_matching(text: Column, patterns: list[tuple[str, str]], default: str = "Unknown") -> Column:
    """The label of the first substring, in the list's order, that the lower-cased text holds."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(p)), label) for p, label in patterns), F.lit(default))


def cross_references(lines: Column, sources: list[str]) -> Column:
    """(source, id) of every id on ``Source: id id`` lines; sources by any case, named as in ``sources``."""
    names = {s.lower(): s for s in sources}
    own = F.filter(F.split(lines, "\n"), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z]+)\s*:", 1) != "")
    name = lambda x: looked_up(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)\s*:", 1)), names, F.lit(None).cast("string"))
    ids = lambda x: words(F.regexp_replace(x, r"^[^:]*:", ""))
    return F.filter(F.flatten(F.transform(own, lambda x: F.transform(ids(x), lambda i: F.struct(name(x).alias("source"), i.alias("id"))))), lambda p: p["source"].isNotNull())


def gene_of_token(token: Column, genes: Column) -> Column:
    """The symbol of a token's gene: the line of ``genes`` ("id  SYMBOL; …") that begins with the number before its v."""
    number = F.regexp_extract(token, r"^(\d+)v", 1)
    own = F.filter(F.transform(F.split(genes, "\n"), stripped), lambda g: F.regexp_extract(g, r"^(\d+)\s", 1) == number)
    return F.when((number != "") & (F.size(own) > 0), stripped(F.split_part(F.regexp_replace(own[0], r"^\d+\s+", ""), F.lit(";"), F.lit(1))))


def without_id(values: Column, separator: str) -> Column:
    """Entries without the id they begin with, joined."""
    return F.array_join(F.transform(values, lambda v: stripped(F.regexp_replace(v, r"^\s*\S+\s+", ""))), separator)


def encoded(text: Column, places: Column, unknown: int = 1, most: int = 512) -> Column:
    """Ids of a text's words by a map word -> id, at most ``most``; unknown words and empty texts are ``unknown``."""
    ids = F.transform(F.slice(words(F.lower(text)), 1, most), lambda w: F.coalesce(F.try_element_at(places, w), F.lit(unknown)))
    return F.when(F.size(ids) > 0, ids).otherwise(F.array(F.lit(unknown)))


def with_examples(examples: Column, prompt: Column, subject: Column) -> Column:
    """A prompt after the answered examples (structs question, answer) of its subject."""
    head = F.concat(F.lit("The following are questions about "), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit(".\n\n"))
    told = F.array_join(F.transform(examples, lambda e: F.concat(e["question"], F.lit(" "), e["answer"], F.lit("\n\n"))), "")
    return F.concat(head, told, prompt)


def since(spec: Column, now: Column) -> Column:
    """A point in time: seconds since 1970, ``now-7d`` (d, h, m or s), or a date or timestamp; null for anything else."""
    back = F.regexp_extract(spec, r"^now-(\d+)[dhms]$", 1).try_cast("long")
    unit = reduce(lambda a, u: F.when(F.regexp_extract(spec, r"^now-\d+([dhms])$", 1) == u[0], u[1]).otherwise(a), {"d": 86400, "h": 3600, "m": 60, "s": 1}.items(), F.lit(0))
    epoch = F.unix_timestamp(now)
    seconds = F.when(spec == "now", epoch).when(back.isNotNull(), epoch - back * unit).when(spec.rlike(r"^\d+(\.\d+)?$"), spec.try_cast("double").cast("long"))
    return F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(spec))


def with_provenance(metadata: Column, provenance: dict[str, Column], name: str = "_origin") -> Column:
    """A JSON object with a further member that says where the sample is from; what is no object is taken as empty."""
    origin = F.to_json(F.struct(*(c.cast("string").alias(k) for k, c in provenance.items())))
    body = stripped(metadata)
    is_object = F.try_parse_json(body).isNotNull() & body.startswith("{")
    inside = F.when(is_object, stripped(F.regexp_replace(body, r"(?s)^\{|\}$", ""))).otherwise("")
    return F.concat(F.lit("{"), F.when(inside == "", "").otherwise(F.concat(inside, F.lit(","))), F.lit(f'"{name}":'), origin, F.lit("}"))


def row_label(tag: str, *ids: Column) -> Column:
    """``[tag] id`` with the first id present, else "unknown"."""
    return F.concat(F.lit(f"[{tag}] "), F.coalesce(*(i.cast("string") for i in ids), F.lit("unknown")))


def number_key(name: Column) -> Column:
    """The first digits of a name as a number to sort by; names without any sort last, as infinity."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("double"), F.lit(float("inf")))
