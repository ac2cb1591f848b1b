"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its unary potential is linear in its own features and those of the lines before and after
it; a 2x2 table of potentials joins neighbouring lines. Forward-backward gives each line's marginal, and the mean of
the marginals, weighted by line length, is the document's raw quality, which a logistic curve of one variable
calibrates. Weights maximise the chain likelihood of a bounded sample of labelled documents, where each line bears
its document's label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices
from lakeloom.llm.near_dedup import _mixed, _Words

#: At most so many labelled documents are fitted on, those with the smallest hashes of their id.
SAMPLE = 3000
#: Lines that these have together at most: rows whose text would exceed them are passed over.
SAMPLE_LINES = 500_000
#: A text of more bytes is worked on in pieces of whole lines of about so many, and lines in runs of LINES.
PIECE, LINES = 1 << 22, 1 << 16
#: Ridge penalty on the weights, and steps of the fit.
RIDGE, STEPS = 1.0, 60

_KINDS = {
    "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "capitals": bytes(range(65, 91)),
    "digits": b"0123456789",
    "spaces": b" \t\r\v\f",
    "stops": b".,;:?",
    "bangs": b"!",
    "symbols": b"$%&*#@^~=+_<>\\`",
    "bars": b"|",
}
_TABLES = np.stack([np.isin(np.arange(256), np.frombuffer(k, dtype=np.uint8)) for k in _KINDS.values()]).astype(np.uint8)
_OWN = len(_KINDS) + 8
#: The feature that says whether the text has had the line before.
_REPEATED = _OWN - 2
WIDTH = 3 * _OWN + 3


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def line_features(raw: list[bytes], hasher: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line with its neighbours', bytes by line, first line of each text and the end)."""
    own, size, first, _ = _own_features(raw, hasher)
    lead, trail = np.zeros(len(own)), np.zeros(len(own))
    lead[first[:-1]] = trail[first[1:] - 1] = 1
    before, after = np.roll(own, 1, axis=0) * (1 - lead)[:, None], np.roll(own, -1, axis=0) * (1 - trail)[:, None]
    return np.column_stack([own, before, after, lead, trail, np.ones(len(own))]), size, first


def _times(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row times the weights, added up column by column: a row's sum does not depend on the rows beside it."""
    out = np.zeros(len(x))
    for column, w in zip(x.T, weights.tolist(), strict=True):
        out += column * w
    return out


def line_odds(raw: list[bytes], hasher: _Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log odds by line, bytes by line, first line of each text and the end), as the features of whole texts give them.

    What is held is some 40 bytes for each byte of a piece, and 40 for each line of a text."""
    if len(raw) > 1 or not raw or len(raw[0]) <= PIECE:
        x, size, first = line_features(raw, hasher)
        return _times(x, weights), size, first
    text, at, own_w = raw[0], 0, weights[: 3 * _OWN].reshape(3, _OWN)
    parts, sizes, seen = [], [], np.zeros(0, dtype=np.uint64)
    while at <= len(text):
        end = text.find(b"\n", at + PIECE)
        end = len(text) if end < 0 else end
        own, size, _, key = _own_features([text[at:end]], hasher)
        own[:, _REPEATED] = np.maximum(own[:, _REPEATED], np.isin(key, seen))
        seen = np.union1d(seen, key)
        parts.append(np.column_stack([_times(own, w) for w in own_w]))
        sizes.append(size)
        at = end + 1
    own, before, after = np.concatenate(parts).T
    odds = own + weights[-1]
    odds[1:] += before[:-1]
    odds[:-1] += after[1:]
    odds[0] += weights[-3]
    odds[-1] += weights[-2]
    return odds, np.concatenate(sizes), np.array([0, len(odds)])


def _own_features(raw: list[bytes], hasher: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes by line, first line of each text and the end, a hash of each line's words)."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    size = (end - start).astype(np.float64)
    doc_end = np.cumsum([len(r) + 1 for r in raw]) - 1
    first = np.concatenate([[0], np.searchsorted(end, doc_end) + 1])
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    safe = np.maximum(size, 1)

    counts = np.stack([np.add.reduceat(t[data], start, dtype=np.int64) for t in _TABLES]) / safe
    words, at = hasher(data.tobytes())
    line = np.searchsorted(start, at, side="right") - 1
    n_words = np.bincount(line, minlength=len(start)).astype(np.float64)
    many = np.maximum(n_words, 1)
    again = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    twice = np.bincount(line[1:][again], minlength=len(start)) / many
    key = _mixed(words + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, kept = np.unique(key, return_index=True)
    distinct = np.bincount(line[kept], minlength=len(start)) / many
    total = np.zeros(len(start), dtype=np.uint64)
    np.add.at(total, line, words)
    _, kept = np.unique(_mixed(total + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    repeated = np.ones(len(start))
    repeated[kept] = 0
    last = data[np.maximum(end - 1, 0)]
    own = np.column_stack(
        [
            *counts,
            np.log1p(size) / 6,
            np.log1p(n_words) / 4,
            np.minimum(size / many, 30) / 10,
            twice,
            distinct,
            np.log1p(n_words) * (1 - distinct),
            repeated,
            (size > 0) & np.isin(last, [33, 34, 46, 63]),
        ]
    ).astype(np.float64)
    return own, size, first, total


@dataclass(frozen=True)
class QualityModel:
    """weights: of the features, for good against bad; pair: log potentials [bad or good before][bad or good after]."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each line is good, from the log odds of lines by themselves."""
        odds = np.exp(np.clip(odds, -30, 30))
        (bb, bg), (gb, gg) = np.exp(self.pair).tolist()
        begins, ends = np.zeros(len(odds), dtype=bool), np.zeros(len(odds), dtype=bool)
        begins[first[:-1]] = ends[first[1:] - 1] = True
        forward, backward = np.empty(len(odds)), np.empty(len(odds))
        r = 1.0
        for at in range(0, len(odds), LINES):
            out = []
            for x, new in zip(odds[at : at + LINES].tolist(), begins[at : at + LINES].tolist(), strict=True):
                r = x if new else min(max(x * (gg * r + bg) / (gb * r + bb), 1e-60), 1e60)
                out.append(r)
            forward[at : at + LINES] = out
        following = 1.0  # what the lines after this one say, and the next one's odds
        for at in range((len(odds) - 1) // LINES * LINES, -1, -LINES):
            out = []
            for x, last in zip(odds[at : at + LINES][::-1].tolist(), ends[at : at + LINES][::-1].tolist(), strict=True):
                r = 1.0 if last else (gg * following + gb) / (bg * following + bb)
                following = x * r
                out.append(r)
            backward[at : at + LINES] = out[::-1]
        m = forward * backward
        return m / (1 + m)

    def raw(self, odds: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each text's lines."""
        m, w = self.marginals(odds, first), size + 1.0
        return np.add.reduceat(m * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def scores(self, odds: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        r = np.clip(self.raw(odds, size, first), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(r / (1 - r)) + self.shift)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _pair_counts(model: QualityModel, odds: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected neighbouring states, from log odds and marginals of one chain after another."""
    odds = np.exp(np.clip(odds, -30, 30)).tolist()
    pot = np.exp(model.pair)
    out = np.zeros((2, 2))
    bounds = first.tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo < 2:
            continue
        back = [1.0] * (hi - lo)
        for k in range(hi - lo - 2, -1, -1):
            o = odds[lo + k + 1] * back[k + 1]
            back[k] = (pot[1, 1] * o + pot[1, 0]) / (pot[0, 1] * o + pot[0, 0])
        # P(next | state) = pair potential * odds of next * what follows
        after = np.array(odds[lo + 1 : hi]) * np.array(back[1:])
        good_b, good_g = pot[0, 1] * after / (pot[0, 1] * after + pot[0, 0]), pot[1, 1] * after / (pot[1, 1] * after + pot[1, 0])
        p = m[lo : hi - 1]
        out += [[((1 - p) * (1 - good_b)).sum(), ((1 - p) * good_b).sum()], [(p * (1 - good_g)).sum(), (p * good_g).sum()]]
    return out


def fit_quality(features: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray) -> QualityModel:
    """Maximum likelihood by gradient steps from a line-wise logistic start; every line bears its text's label."""
    none = QualityModel(np.zeros(WIDTH), np.zeros((2, 2)))
    if not len(label):
        return none
    if label.min() == label.max():
        return QualityModel(none.weights, none.pair, 1.0, 4.0 if label[0] else -4.0)
    lines = np.diff(first)
    y = np.repeat(label.astype(np.float64), lines)
    # a long text counts as much as a short one
    share = np.repeat(1.0 / np.maximum(lines, 1), lines)
    w = _weighted(features, y, share)
    pair = np.zeros((2, 2))
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (lines - 1)[label == 0].sum(), (lines - 1)[label == 1].sum()
    moment_w, moment_p, n = np.zeros_like(w), np.zeros((2, 2)), len(label)
    square_w, square_p = np.zeros_like(w), np.zeros((2, 2))
    for step in range(1, STEPS + 1):
        model = QualityModel(w, pair)
        odds = features @ w
        m = model.marginals(odds, first)
        grad_w = (features.T @ (y - m) - RIDGE * w) / n
        grad_p = (seen - _pair_counts(model, odds, first, m) - RIDGE * pair * 10) / n
        moment_w, moment_p = 0.9 * moment_w + 0.1 * grad_w, 0.9 * moment_p + 0.1 * grad_p
        square_w, square_p = 0.99 * square_w + 0.01 * grad_w**2, 0.99 * square_p + 0.01 * grad_p**2
        rate = 0.05 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        w, pair = w + rate * moment_w / (np.sqrt(square_w) + 1e-8), pair + rate * moment_p / (np.sqrt(square_p) + 1e-8)
    model = QualityModel(w, pair)
    r = np.clip(model.raw(features @ w, size, first), 1e-4, 1 - 1e-4)
    slope, shift = _logistic(np.column_stack([np.log(r / (1 - r)), np.ones(len(r))]), label.astype(np.float64), 1e-2)
    return QualityModel(w, pair, float(slope), float(shift))


def _weighted(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (share * (p - y)) + RIDGE * w)
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _Words()
    for b in slices(batches, "text"):
        x, size, first = line_features([_utf8(t) for t in b.column("text").to_pylist()], hasher)
        parts = [x[lo:hi].astype("<f4").tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
        sizes = [size[lo:hi].astype("<f8").tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(parts, pa.binary()), pa.array(sizes, pa.binary())], ["id", "label", "x", "size"])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> QualityModel:
    """A model fitted on at most ``sample`` rows of ``labels`` (id_col, label_col 0 or 1) and their whole texts in
    ``docs``, which have at most ``sample_lines`` lines together.

    Rows come in the order of hashes of their id, and one whose text would exceed the lines left is passed over, so the
    choice depends on ids and texts alone. Rows with a null id or label are left out. With no labelled text every score is
    0.5; with one label only, all scores lean to it."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    # the broadcast side has at most ``sample`` rows of two numbers
    rows = texts.join(F.broadcast(chosen), "id").withColumn("lines", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n]+", "")) + 1).withColumn("key", F.xxhash64("text"))
    order = [F.xxhash64("id"), "id", "label", "lines", "key"]
    left, wanted = sample_lines, []
    for r in rows.select("id", "label", "lines", "key").orderBy(*order).limit(sample).collect():
        if r.lines <= left:
            left -= r.lines
            wanted.append((r.id, r.label, r.lines, r.key))
    if not wanted:
        return fit_quality(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(1, dtype=np.int64), np.zeros(0))
    known = docs.sparkSession.createDataFrame(wanted, f"id {kind}, label int, lines int, key long").distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("id", "label", "lines", "key")]
    some = rows.alias("r").join(F.broadcast(known).alias("k"), same, "left_semi")
    got = some.select("id", "label", "text").mapInArrow(_featured, f"id {kind}, label int, x binary, size binary").orderBy(F.xxhash64("id"), "id", "label", F.length("x"), F.xxhash64("x")).limit(len(wanted)).collect()
    x = [np.frombuffer(r.x, dtype="<f4").reshape(-1, WIDTH).astype(np.float64) for r in got]
    first = np.cumsum([0, *(len(v) for v in x)])
    return fit_quality(np.concatenate(x), np.concatenate([np.frombuffer(r.size, dtype="<f8") for r in got]), first, np.array([r.label for r in got]))


def _scored(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    hasher = _Words()
    for b in slices(batches, "text"):
        odds, size, first = line_odds([_utf8(t) for t in b.column("text").to_pylist()], hasher, model.weights)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(model.scores(odds, size, first), pa.float64())], ["row", "score"])


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if none are named) as a struct ``row``, and ``score`` from 0 to 1.

    Only the text is scored. A null or empty text is one empty line. Repeated rows get equal scores; an empty table
    gives an empty result. A column of ``docs`` named score or row stays inside ``row``."""
    source = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))
    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _scored(batches, model), f"row {row}, score double")
