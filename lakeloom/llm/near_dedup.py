"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Minima of ``bands * rows`` hash functions over a document's word shingles are kept twice: whole, as one key a
band, to find candidates; and as ``BITS`` low bits each, packed into 64-bit words, to estimate similarity by
counting equal bit groups (corrected for the chance that unequal minima share their low bits).

Documents with equal shingle sets form one class; what follows works on classes only. In each band bucket the
class that meets most others is the hub, and every other class is compared with it: rows grow with the members,
not with their pairs. Where a bucket then holds more than one component, its members outside the hub's component
meet the others: pair by pair in buckets of at most ``SMALL`` members, else in bounded blocks. Packed signatures
screen pairs and blocks, and full sets confirm what is left, so that no link between classes that share a band is
lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import components, drop_saved, saved, slices, spread_join

BANDS, ROWS, BITS = 48, 5, 4
#: Estimates this far below the threshold are screened out: six standard errors of 240 minima.
MARGIN = 0.165
#: Shingles and members in one block of a crowded bucket.
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 256
#: Buckets of at most so many members are compared pair by pair.
SMALL = 16

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8
_P_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 2**64))
_MUL = (_rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND_MUL = _rng.integers(1, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Words:
    """Word hashes of many texts at once; powers are kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of every word of A-Z-lower-cased data; words end at bytes 0x20 and 0x09-0x0D."""
        raw = np.frombuffer(data.lower(), dtype=np.uint8)
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(len(raw) * 5 // 4 + 1, _P), _powers(len(raw) * 5 // 4 + 1, _P_INV)
        inside = np.empty(len(raw) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=total[1:])
        return _mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[str | None], words: int, hasher: _Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; none without words."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    hashes, start = hasher(b"\n".join(raw) + b"\n")
    bound = np.searchsorted(start, first)
    out = []
    for lo, hi in zip(bound[:-1], bound[1:], strict=True):
        n = min(words, hi - lo)
        if not n:
            out.append(hashes[:0])
            continue
        h = hashes[lo : hi - n + 1]
        for k in range(1, n):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + hashes[lo + k : hi - n + 1 + k])
        out.append(np.unique(h))
    return out


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048] * _MUL).min(axis=1), out=least)
    m = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _mixed((m * _BAND_MUL[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _BAND_MUL[:, ROWS])
    # the products' lowest bits repeat those of the shingle hash; bits above them are as good as random
    low_bits = ((least >> np.uint32(3)) & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    packed = (low_bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimates of packed signatures, broadcast over leading axes, corrected for chance matches."""
    z = a.view(np.uint64) ^ b.view(np.uint64)
    z = z | (z >> np.uint64(1))
    z = (z | (z >> np.uint64(2))) & np.uint64(0x1111111111111111)
    unequal = np.bitwise_count(z).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((1 - unequal / (BANDS * ROWS)) - chance) / (1 - chance)


_SIGNED = "id long, n long, cls binary, bands array<long>, sig binary"
#: Name of the column with a text's digest.
_DIGEST = "lakeloom text digest"
#: The bytes between words.
_BLANK = " \t\n\x0b\x0c\r"


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A column digest, where there is one, is handed on."""
    hasher = _Words()
    for b in slices(batches, "text"):
        sets = shingle_sets(b.column("text").to_pylist(), words, hasher)
        cls, bands, sig = [], [], []
        for s in sets:
            if not len(s):
                cls.append(None), bands.append(None), sig.append(None)
                continue
            keys, packed = signature(s)
            cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(keys), sig.append(packed.tobytes())
        handed = [c for c in ("digest",) if c in b.schema.names]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), *map(b.column, handed)],
            ["id", "n", "cls", "bands", "sig", *handed],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    hasher = _Words()
    for b in slices(batches, "text"):
        sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), words, hasher)]
        cls = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], ["cls", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, sa, sb), the pairs whose full sets reach the threshold."""
    for b in batches:
        sa, sb = b.column("sa"), b.column("sb")
        keep = []
        for k in range(b.num_rows):
            x, y = np.frombuffer(sa[k].as_buffer(), dtype=np.uint64), np.frombuffer(sb[k].as_buffer(), dtype=np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _screen(g, threshold: float):
    """Members of a block that have a partner in the other block, of another component, whose estimate is near enough."""
    x, y = g[g.left], g[~g.left]
    if not len(x) or not len(y):
        return g.loc[[], ["band", "xb", "yb", "left", "cls", "comp"]]
    sx, sy = (np.frombuffer(b"".join(s.sig), dtype=np.int64).reshape(len(s), -1) for s in (x, y))
    near = np.concatenate([estimate(sx[at : at + 32, None, :], sy[None, :, :]) >= threshold for at in range(0, len(sx), 32)])
    near &= x.comp.to_numpy()[:, None] != y.comp.to_numpy()[None, :]
    nx, ny = x.n.to_numpy()[:, None], y.n.to_numpy()[None, :]
    near &= np.minimum(nx, ny) >= (threshold * np.maximum(nx, ny))
    import pandas as pd

    return pd.concat([x[near.any(axis=1)], y[near.any(axis=0)]])[["band", "xb", "yb", "left", "cls", "comp"]]


def _confirm(g, percent: int):
    """Links between the two sides of a block on full sets: for each member one link with each other component."""
    import pandas as pd

    x, y = g[g.left].reset_index(drop=True), g[~g.left].reset_index(drop=True)
    none = pd.DataFrame({"a": [], "b": []}, dtype=object)
    if not len(x) or not len(y):
        return none
    sx, sy = ([np.frombuffer(v, dtype=np.uint64) for v in s.shingles] for s in (x, y))
    values = np.concatenate(sy)
    owner = np.repeat(np.arange(len(sy)), [len(s) for s in sy])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    ny = np.array([len(s) for s in sy])
    comp, found = y.comp.to_numpy(), []
    for i, s in enumerate(sx):
        lo, hi = np.searchsorted(values, s), np.searchsorted(values, s, side="right")
        count = hi - lo
        at = np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(sy))
        seen = {x.comp[i]}
        for j in np.flatnonzero(100 * common >= percent * (len(s) + ny - common)):
            if comp[j] not in seen:
                seen.add(comp[j])
                found.append((x.cls[i], y.cls[j]))
    return pd.DataFrame(found, columns=["a", "b"]) if found else none


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``docs``.

    Rows are linked when 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles
    (words: runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a text of fewer words is one shingle).
    component_id is the smallest id reachable over links; kept marks the row that bears it.
    Null or wordless texts have no shingles and are linked with nothing. A row with a null id takes no part: its
    component_id is null and it is kept. Rows that repeat an id are separate rows with that id. An empty table gives
    an empty result. Other columns of ``docs`` are not read, whatever their names."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = saved(source.mapInArrow(partial(_signed, words=words), _SIGNED))
    least = _labelled(source, signed, words, percent, F.min("id").alias("least"))
    smallest = least.groupBy("label").agg(F.min("least").alias("component"))
    named = spread_join(least, smallest, "label", "cls").select("cls", "component")
    rows = spread_join(signed.select("id", "n", "cls"), named, "cls", "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each component, linked as in ``near_duplicates``.

    Rows are decided on by their texts, not by their ids: of a component the row with the smallest id stays; of
    several with that id, that whose text's SHA-256 is the smallest, and of those with the same text the first by the other
    columns. Rows of one id with unlike texts are in components of their own, so each has its own row. Null or
    wordless texts are linked with nothing and stay, as do rows with a null id."""
    key = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("digest"))
    signed = saved(source.mapInArrow(partial(_signed, words=words), f"{_SIGNED}, digest string"))
    least = _labelled(source.select("id", "text"), signed, words, percent, F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("first"))
    first = least.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.id").alias("id"), F.col("first.digest").alias(_DIGEST))
    alone = F.col(id_col).isNull() | F.coalesce(F.btrim(F.col(text_col).cast("string"), F.lit(_BLANK)) == "", F.lit(True))
    keyed = docs.where(~alone).withColumn(_DIGEST, key)
    bearing = keyed.join(first, (keyed[id_col].cast("long") == first["id"]) & (keyed[_DIGEST] == first[_DIGEST]), "left_semi")
    rest = [c for c in docs.columns if c != id_col]
    once = bearing.groupBy(id_col, _DIGEST).agg(F.min(F.struct(*rest)).alias("row"))
    return once.select(id_col, "row.*").select(docs.columns).unionByName(docs.where(alone))


def _labelled(source: DataFrame, signed: DataFrame, words: int, percent: int, *of_class: Column) -> DataFrame:
    """(cls, of_class, label) of each class: rows of one component have one label. of_class: aggregates of the class's
    rows, of which one is named least, its smallest id."""
    classes = saved(
        signed.where("id is not null and cls is not null").groupBy("cls").agg(*of_class, F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    own = [c for c in classes.columns if c not in ("n", "bands", "sig")]
    keys = classes.select("cls", F.explode("bands").alias("band"))
    crowded = keys.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = saved(keys.join(crowded, "band"))
    degree = members.groupBy("cls").agg(F.sum("members").alias("degree"))
    hubs = saved(members.join(degree, "cls").groupBy("band").agg(F.max(F.struct("degree", "cls")).alias("top")).select("band", F.col("top.cls").alias("hub")))
    wanted = members.select("cls").distinct()
    ids = classes.join(wanted, "cls", "left_semi").select(F.col("least").alias("id")).distinct()
    sets = saved(source.join(ids, "id", "left_semi").mapInArrow(partial(_sets, words=words), "cls binary, shingles binary").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))

    # every member against its bucket's hub: packed signatures first, then full sets
    threshold = percent / 100 - MARGIN
    sig = classes.select("cls", "n", "sig")
    pairs = members.join(hubs, "band").where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    side = lambda c, s: sig.select(F.col("cls").alias(c), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"sig{s}"))
    has = lambda c: sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"s{c}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").where(_near(threshold)).select("a", "b")
        return near.join(has("a"), "a").join(has("b"), "b").select("a", "b", "sa", "sb").mapInArrow(partial(_linked, percent=percent), "a binary, b binary")

    links = saved(confirmed(pairs))
    label = components(links)

    # buckets that still hold several components: the members outside the hub's component against all others
    of = label.withColumnRenamed("node", "cls")
    placed = saved(members.join(of, "cls", "left").select("band", "cls", "members", F.coalesce("label", "cls").alias("comp")))
    main = hubs.join(of.withColumnRenamed("cls", "hub"), "hub", "left").select("band", F.coalesce("label", "hub").alias("main"))
    several = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    apart = saved(placed.join(several, "band").join(main, "band").select("band", "cls", "members", "comp", (F.col("comp") != F.col("main")).alias("out")))
    few = apart.where(F.col("members") <= SMALL)
    x, y = few.where("out").select("band", F.col("cls").alias("x"), F.col("comp").alias("cx")), few.select("band", F.col("cls").alias("y"), F.col("comp").alias("cy"))
    pairs = x.join(y, "band").where("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links_few = saved(confirmed(pairs))

    open_ = saved(apart.where(F.col("members") > SMALL).join(sig, "cls"))
    blocks = open_.groupBy("band").agg(
        *(F.greatest(F.ceil(F.sum(F.when(w, 1).otherwise(0)) / BLOCK_MEMBERS), F.ceil(F.sum(F.when(w, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int").alias(c) for c, w in (("nx", F.col("out")), ("ny", F.lit(True))))
    )
    placed_in = open_.join(blocks, "band").withColumn("h", F.xxhash64("cls"))
    common = ["band", "cls", "comp", "n", "sig"]
    left = placed_in.where("out").select(*common, F.lit(True).alias("left"), F.pmod("h", "nx").cast("int").alias("xb"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("yb"))
    right = placed_in.select(*common, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("xb"), F.pmod("h", "ny").cast("int").alias("yb"))
    screened = saved(left.unionByName(right).groupBy("band", "xb", "yb").applyInPandas(partial(_screen, threshold=threshold), "band long, xb int, yb int, left boolean, cls binary, comp binary"))
    more = saved(screened.join(sets, "cls").groupBy("band", "xb", "yb").applyInPandas(partial(_confirm, percent=percent), "a binary, b binary").distinct())

    # those links join whole components, so only they are gone over again, between labels
    new = links_few.union(more)
    for c in ("a", "b"):
        new = new.join(label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
    new = new.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    joined = components(new)
    labelled = classes.select(own).join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("_joined"))
    out = saved(spread_join(labelled, moved, "label", "cls", "left").select(*own, F.coalesce("_joined", "label").alias("label")))
    drop_saved(members, hubs, sets, links, links_few, label, placed, apart, open_, screened, more, classes, joined)
    return out


def _near(threshold: float):
    @F.pandas_udf("boolean")
    def near(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), dtype=np.int64).reshape(len(s), -1) for s in (a, b))
        return pd.Series(estimate(x, y) >= threshold)

    return near("siga", "sigb")


def near_duplicates_sql(words: int = 2, percent: int = 80) -> str:
    """The same for DuckDB over documents with distinct ids, by a join of all shingles: for small tables."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {" || ' ' || ".join(f"w[i + {k}]" for k in range(words))})) END AS g FROM w
), s AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM g WHERE doc_id IS NOT NULL
), e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c AS component_id, coalesce(doc_id = c, true) AS kept FROM g LEFT JOIN m USING (doc_id)
"""
