"""Global order without a single task: indexes, splits, shards, buckets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's order is cut into; at least and at most those of a global order; those of a range that ties
#: have left too large.
RANGES, LEAST_RANGES, MOST_RANGES, TIE_RANGES = 64, 8, 4096, 64
#: Cuts that are looked through one by one; a longer list is first narrowed to so many.
STEP = 64
#: Rows that a range is to have; one of no more is never cut again.
RANGE_ROWS = 500_000


def with_index(df: DataFrame, *order: str, name: str = "idx", ranges: int | None = None) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of the columns ``order``.

    Ranges are as many as the rows ask for, if their number is not given. The first column's approximate quantiles cut the rows into ranges; a range that one value of it has made too large
    is cut by the next column, and so on. Each range is ordered by itself and begins where the rows before it end. The
    driver holds one number a range. Nulls come first."""
    values = _numbers(order, dict(df.dtypes))
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, df.count() // RANGE_ROWS))
    cuts = df.select(F.percentile_approx(values[0], [k / ranges for k in range(1, ranges)], max(10_000, 25 * ranges))).first()[0] or []
    placed = df.withColumn("_part", F.when(values[0].isNull(), 0).otherwise(1 + _below(sorted(set(cuts)), values[0])).cast("long"))
    counts = _counts(placed)
    limit = max(RANGE_ROWS, 4 * sum(counts.values()) // ranges)
    spark = df.sparkSession
    for value, following in zip(values, values[1:], strict=False):
        large = [(p,) for p, n in counts.items() if n > limit]
        if not large:
            break
        # a large range is mostly one value, so its median is that value; rows on either side of it keep their order
        of = F.broadcast(spark.createDataFrame(large, "_part long"))
        tie = placed.join(of, "_part").groupBy("_part").agg(F.percentile_approx(value, 0.5, 10_000).alias("_tie"))
        inside = placed.join(F.broadcast(tie), "_part").where(value.eqNullSafe(F.col("_tie")))
        own = inside.groupBy("_part").agg(F.percentile_approx(following, [k / TIE_RANGES for k in range(1, TIE_RANGES)], 10_000).alias("_cuts"))
        marks = spark.createDataFrame(tie.join(own, "_part", "left").select("_part", "_tie", "_cuts").collect(), "_part long, _tie double, _cuts array<double>")
        among = 1 + F.when(following.isNull(), 0).otherwise(1 + F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < following)))
        sub = F.when(value.eqNullSafe(F.col("_tie")), among).when(F.col("_tie").isNull() | (value > F.col("_tie")), TIE_RANGES + 2).otherwise(0)
        wide = F.col("_part") * (TIE_RANGES + 3)
        known = marks.withColumn("_large", F.lit(True))  # a row a large range
        placed = placed.join(F.broadcast(known), "_part", "left").withColumn("_part", F.when(F.col("_large"), wide + sub).otherwise(wide)).drop("_tie", "_cuts", "_large")
        counts = _counts(placed)
    return _indexed(placed, counts, order, name)


def with_hash_index(df: DataFrame, key: str, *ties: str, name: str = "idx") -> DataFrame:
    """The same in the order of a hexadecimal digest: its first three digits are the range."""
    placed = df.withColumn("_part", F.coalesce(F.conv(F.substring(key, 1, 3), 16, 10).cast("long"), F.lit(-1)))
    return _indexed(placed, _counts(placed), (key, *ties), name)


def number_of(df: DataFrame, name: str) -> Column:
    """A number whose order is the column's, though unequal values may share one."""
    return _numbers((name,), dict(df.dtypes))[0]


def _numbers(order: tuple[str, ...], kinds: dict[str, str]) -> list[Column]:
    """Numbers whose order, one after the other, is that of the columns as far as they go: a text gives its first 24
    bytes, six at a time, and what comes after it none, as texts may differ further on."""
    out: list[Column] = []
    for name in order:
        c, kind = F.col(name), kinds[name]
        if kind in ("string", "binary"):
            raw = F.encode(c, "UTF-8") if kind == "string" else c
            return out + [F.conv(F.rpad(F.hex(F.substring(raw, 1 + 6 * k, 6)), 12, "0"), 16, 10).cast("double") for k in range(4)]
        if kind in ("date", "timestamp_ntz"):  # without regard to time zones, whose hours may repeat
            c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
        number = c.cast("double")
        out.append(number)
        if kind == "bigint":  # what a double cannot hold of it
            out.append(F.coalesce((c - number.try_cast("bigint")).cast("double"), F.lit(0.0)))
        elif kind.startswith("decimal"):
            return out
    return out


def _below(cuts: list[float], value: Column) -> Column:
    """How many of the ordered cuts lie below the value."""
    if not cuts:
        return F.lit(0)
    under = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    array = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    if len(cuts) <= STEP:
        return under(array(cuts))
    runs = [cuts[k : k + STEP] for k in range(0, len(cuts), STEP)]
    run = F.least(under(array([r[-1] for r in runs])), F.lit(len(runs) - 1))
    return run * STEP + under(F.array(*map(array, runs))[run])


def _counts(placed: DataFrame) -> dict[int, int]:
    return {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}


def _indexed(placed: DataFrame, counts: dict[int, int], order: tuple[str, ...], name: str) -> DataFrame:
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    starts = F.broadcast(placed.sparkSession.createDataFrame(offsets, "_part long, _start long"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1
    return placed.withColumn("_rank", rank).join(starts, "_part").withColumn(name, (F.col("_rank") + F.col("_start")).cast("long")).drop("_part", "_rank", "_start")


def md5_share(value: Column) -> Column:
    """A number in 0..1 from the first 8 digits of the md5 of a string."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def sha_share(value: Column, seed: int) -> Column:
    """A number in 0..1 from the sha-256 of ``seed:value``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def shuffle_key(seed: int, *parts: Column) -> Column:
    """The md5 of the seed and parts, each ended by a zero byte but the last."""
    zero = F.lit("\u0000")
    columns = [F.lit(str(seed)), *(p.cast("string") for p in parts)]
    joined = [x for c in columns for x in (c, zero)][:-1]
    return F.md5(F.concat(*joined).cast("binary"))


def equal_shard(index: Column, total: int, shards: int) -> Column:
    """Shard of a row if ``shards`` shards share ``total`` rows, the first ones one row more where they must."""
    base, extra = divmod(total, shards)
    head = extra * (base + 1)
    tail = F.lit(extra) + F.floor((index - head) / max(base, 1))
    return F.when(index < head, F.floor(index / (base + 1))).otherwise(tail).cast("long")


def length_buckets(df: DataFrame, index: str, length: str, buffer: int, buckets: int) -> DataFrame:
    """Adds buffer (runs of ``buffer`` rows) and bucket: rows of a buffer by length, in ``buckets`` equal runs, the last
    with the remainder; a buffer of fewer rows than buckets is one bucket."""
    df = df.withColumn("buffer", F.floor(F.col(index) / buffer).cast("long"))
    own = Window.partitionBy("buffer")
    rank = F.row_number().over(own.orderBy(length, index)) - 1
    n = F.count(F.lit(1)).over(own)
    size = F.floor(n / buckets)
    return df.withColumn("bucket", F.when(n < buckets, F.lit(0)).otherwise(F.least(F.floor(rank / size), F.lit(buckets - 1))).cast("long"))


def padding(df: DataFrame, batch: str, length: str, *by: str) -> DataFrame:
    """By group: batches, rows, padding efficiency (kept over padded cells) overall, least and most, wasted cells."""
    per = df.groupBy(*by, batch).agg(F.sum(length).alias("kept"), (F.max(length) * F.count(F.lit(1))).alias("cells"), F.count(F.lit(1)).alias("rows"))
    share = F.when(F.col("cells") > 0, F.col("kept") / F.col("cells")).otherwise(0.0)
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("rows").alias("rows"),
        F.round(F.try_divide(F.sum("kept"), F.sum("cells")), 6).alias("efficiency"),
        F.round(F.min(share), 6).alias("least"),
        F.round(F.max(share), 6).alias("most"),
        (F.sum("cells") - F.sum("kept")).alias("wasted"),
    )


def nearest_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """By group: the value at place floor(n * p) (from 0) of the ordered values, for each name and p of ``ranks``.

    Values are counted first, so what is ordered are a group's distinct values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(*by)
    counts = counts.withColumn("_up_to", F.sum("_n").over(every.orderBy(value))).withColumn("_all", F.sum("_n").over(every))
    return counts.groupBy(*by).agg(*(F.min(F.when(F.col("_up_to") > F.floor(F.col("_all") * F.lit(float(p))), F.col(value))).alias(name) for name, p in ranks.items()))
