"""SentencePiece merges by a table of prefixes.

For merges of neighbours by score each prefix of a text has one last token: the vocabulary entry that ends it, whose own
merges give it back, and that is compatible with the last token of the prefix before it (the merges of the two, side by
side, leave their border alone). An automaton over the vocabulary names the entries that end at each character; the one
that passes the test goes into a table of one number a character, and the ids are read from the table backwards.

Texts are cut first where no vocabulary entry reaches across: in front of a word's blank, at characters of no entry, and
in long pieces between any two characters that never stand side by side in an entry. Ids of short pieces are remembered
(at most twice ``MEMO`` of ``MEMO_CHARS`` characters a task; the half not asked for lately is forgotten)."""

from __future__ import annotations

import math
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices

BLANK = "▁"
MEMO, MEMO_CHARS = 300_000, 48
#: Answers of the compatibility test that a task remembers.
PAIRS = 1 << 19
#: What a word may end with and is looked up apart from it, where no entry has it behind the character before it.
MARKS = frozenset(".,;:!?")
#: Kinds of vocabulary entries in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# ---- model files -------------------------------------------------------------------------------------------------


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    at = 0
    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceModel:
    """A model file's vocabulary: pieces, scores and kinds by id."""

    def __init__(self, raw: bytes) -> None:
        self.pieces, self.scores, self.kinds = [], [], []
        self.key = xxhash.xxh3_64_hexdigest(raw)
        trainer, normalizer = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.prefix = bool(normalizer.get(3, 1))
        for wrong, why in (
            (trainer.get(3, 1) != 2, "its kind is not BPE"),
            (not trainer.get(35, 0), "it has no bytes for unknown characters"),
            (trainer.get(24, 0), "blanks are suffixes"),
            (normalizer.get(2, b""), "it rewrites characters"),
            (normalizer.get(4, 1), "it removes blanks"),
            (not normalizer.get(5, 1), "it keeps blanks as they are"),
            ({USER, UNUSED} & set(self.kinds), "it has user-defined or unused pieces"),
        ):
            if wrong:
                raise ValueError(f"the model cannot be used here: {why}")


# ---- encoding ----------------------------------------------------------------------------------------------------


def merged(text: str, score: dict[str, float]) -> list[str]:
    """What merging the neighbours with the highest score first, the leftmost of equals, makes of a short text."""
    get, none = score.get, -math.inf
    parts = list(text)
    found = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found and (best := max(found)) > none:
        k = found.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del found[k]
        if k < len(found):
            found[k] = get(parts[k] + parts[k + 1], none)
        if k:
            found[k - 1] = get(parts[k - 1] + parts[k], none)
    return parts


class PieceEncoder(dict):
    """piece of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, model: PieceModel, memo: int = MEMO) -> None:
        super().__init__()
        self.model, self.memo, self.older, self.fits = model, memo, {}, {}
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        self.score = {model.pieces[i]: model.scores[i] for i in normal}
        self.tokens = list(model.pieces)
        alphabet = sorted({c for p in self.score for c in p})
        #: characters that stand in longer pieces only take part in merges; their ids are their bytes
        extra = [c for c in alphabet if c not in self.score]
        self.tokens += extra
        self.automaton = ahocorasick.Automaton()
        for i in (*normal, *range(len(model.pieces), len(self.tokens))):
            t = self.tokens[i]
            if len(t) == 1 or merged(t, self.score) == [t]:
                self.automaton.add_word(t, (i, len(t)))
        if alphabet:
            self.automaton.make_automaton()
        byte = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)]
        self.is_byte, self.is_control = np.array(model.kinds) == BYTE, np.array(model.kinds) == CONTROL
        self.raw = [p.replace(BLANK, " ").encode() for p in model.pieces]
        for i, kind in enumerate(model.kinds):
            if kind != NORMAL:
                self.raw[i] = {CONTROL: b"", UNKNOWN: " \u2047 ".encode()}.get(kind, bytes([int(model.pieces[i][3:5], 16)]) if kind == BYTE else b"")
        self.sizes = list(map(len, self.tokens))
        self.touching = {(ord(a) << 21) | ord(b) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(self.touching), dtype=np.int64)
        none = re.escape("".join(c for c in map(chr, range(128)) if c not in alphabet))
        inside = any(a != BLANK and b == BLANK for p in self.score for a, b in zip(p, p[1:], strict=False))
        word = f"[^{none}]+" if inside else f"{BLANK}*[^{BLANK}{none}]+|{BLANK}+"
        self.cut = re.compile(f"[{none}]|{word}" if none else word)

    def together(self, a: int, b: int) -> bool:
        """Whether merging leaves the border of two neighbouring tokens alone."""
        key = (a << 32) | b
        if (out := self.fits.get(key)) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            x, y = self.tokens[a], self.tokens[b]
            out = self.fits[key] = merged(x + y, self.score) == [x, y]
        return out

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix the last of its tokens; -1 for the empty one and after a character that no piece has."""
        last = [-1] * (len(text) + 1) if len(text) <= MEMO_CHARS else array("i", [-1]) * (len(text) + 1)
        known, together = self.fits.get, self.together
        for end, (token, size) in self.automaton.iter(text) if self.score else ():
            if last[end + 1] < 0:  # a prefix has one
                before = last[end + 1 - size]
                if before < 0 or (together(before, token) if (fits := known((before << 32) | token)) is None else fits):
                    last[end + 1] = token
        return last

    def _ids(self, text: str) -> bytes:
        if len(text) > 2 and text[-1] in MARKS and (ord(text[-2]) << 21) | ord(text[-1]) not in self.touching:
            return self[text[:-1]] + self[text[-1]]
        last, known, sizes, out, end = self.last_tokens(text), len(self.model.pieces), self.sizes, array("i"), len(text)
        append = out.append
        while end:
            token = last[end]
            if 0 <= token < known:
                append(token)
                end -= sizes[token]
            else:
                out.extend(self.bytes[b] for b in reversed(text[end - 1].encode("utf-8", "surrogatepass")))
                end -= 1
        out.reverse()
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _pieces(self, text: str) -> list[str]:
        """A long text cut between characters that no entry has side by side."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        pair = (code[:-1] << 21) | code[1:]
        at = np.searchsorted(self.beside, pair)
        apart = self.beside[np.minimum(at, len(self.beside) - 1)] != pair if len(self.beside) else np.ones(len(pair), dtype=bool)
        cuts = (np.flatnonzero(apart) + 1).tolist()
        return [text[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def __missing__(self, text: str) -> bytes:
        if len(text) > MEMO_CHARS:
            pieces = self._pieces(text)
            return self._ids(text) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))
        if len(self) >= self.memo:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(text)) is None:
            out = self._ids(text)
        self[text] = out
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = text.replace(" ", BLANK)
        return b"".join(map(self.__getitem__, self.cut.findall(BLANK + text if self.model.prefix else text)))

    # ---- decoding ----

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: blanks for their marks, without the blank put in front; bytes that are no characters
        as U+FFFD each; control ids are nothing."""
        first = next((i for i in ids.tolist() if self.model.kinds[i] != CONTROL), None)
        front = self.model.prefix and first is not None and self.model.pieces[first].startswith(BLANK)
        if not self.is_control[ids].any():  # which would part bytes
            out = b"".join(map(self.raw.__getitem__, ids.tolist()))
            try:
                str(out, "utf-8")
                return out[front:]
            except UnicodeDecodeError:
                pass
        cuts = (np.flatnonzero(np.diff(self.is_byte[ids])) + 1).tolist() if len(ids) else []
        runs = [b"".join(map(self.raw.__getitem__, ids[lo:hi].tolist())) for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        return b"".join(_characters(r) for r in runs)[front:]


def _characters(raw: bytes) -> bytes:
    """The bytes, U+FFFD for each that is part of no character."""
    out, at = [], 0
    while at < len(raw):
        try:
            raw[at:].decode("utf-8")
            bad = len(raw)
        except UnicodeDecodeError as e:
            bad = at + e.start
        out.append(raw[at:bad])
        if bad < len(raw):
            out.append("\ufffd".encode())
        at = bad + 1
    return b"".join(out)


# ---- on Spark ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _worker_encoder(key: str, shared: _Shared) -> PieceEncoder:
    return PieceEncoder(shared.model.value)


class _Shared:
    """The broadcast model; all are equal, as the key beside them tells models apart."""

    def __init__(self, model) -> None:
        self.model = model

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shared)


def _encoded(batches: Iterator[pa.RecordBatch], key: str, shared: _Shared, decode: bool) -> Iterator[pa.RecordBatch]:
    encoder = _worker_encoder(key, shared)
    for b in slices(batches, "text"):
        ids = [encoder.encode(t or "") for t in b.column("text").to_pylist()]
        n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        values = np.frombuffer(b"".join(ids), dtype="<i4")
        offsets = np.concatenate([[0], np.cumsum(n)])
        columns = [b.column("row"), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))]
        names = ["row", "n_tokens", "ids"]
        if decode:
            columns.append(pa.array([encoder.decode(values[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()).cast(pa.string()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names)


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def piece_encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all but the text, if none are named) as a struct ``row``; n_tokens, ids (an array
    of integers), and with ``decode`` the text ``decoded`` from the ids.

    Ids are those of the merges by score of the file ``model``, without begin and end; characters that it lacks are their
    bytes. A null or empty text has no ids and decodes to an empty text. A text is worked on whole: its ids and four bytes
    a character of its longest stretch without a cut are held, also for very long texts, words and runs of blanks.
    Repeated rows get equal ids, null ids of documents stay; an empty table gives an empty result; clashing names stay
    inside row. The vocabulary, of a fixed size, is read by the driver and sent to tasks once."""
    own = read_model(model)
    key, shared = own.key, _Shared(docs.sparkSession.sparkContext.broadcast(own))
    source = docs.select(F.struct(*(keep or [c for c in docs.columns if c != text_col])).alias("row"), F.col(text_col).cast("string").alias("text"))
    row = source.schema["row"].dataType.simpleString()
    schema = f"row {row}, n_tokens long, ids array<int>" + ", decoded string" * decode
    return source.mapInArrow(lambda batches: _encoded(batches, key, shared, decode), schema)


def piece_decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of its ids (null for null)."""
    own = read_model(model)
    key, shared = own.key, _Shared(encoded.sparkSession.sparkContext.broadcast(own))

    @F.pandas_udf("string")
    def decoded(ids):
        encoder = _worker_encoder(key, shared)
        return ids.map(lambda x: None if x is None else encoder.decode(np.asarray(x, dtype=np.int64)).decode())

    return encoded.withColumn("decoded", decoded(ids_col))
