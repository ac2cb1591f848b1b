"""Greedy selection: rows in order, each taken unless it conflicts with one that was taken before it.

What a sequential pass takes is the first independent set of the conflict graph in the rows' order. Rounds find it in
parallel: an undecided row with no undecided row before it among its conflicts is taken, and the rows that conflict with
it fall. Conflicts are shared keys (a row a member, never pairs) and pairs. After ``ROUNDS`` rounds what is undecided has
mostly come apart: components of up to ``COMPONENT`` rows and links are each finished by one task in one pass, and only
larger ones go on in rounds. (A chain of undecided rows in a larger one takes a round for every two of its rows: the
problem is as sequential as any.)

Where conflicts are so many that they should not all be listed, as those of near hashes, rows go block by block: what a
block takes falls upon all rows behind it at once, so that only conflicts within a block, of rows that are left, and with
taken rows, which are few about any row, are ever looked for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ordering import with_index
from lakeloom.sources.scratch import Scratch

#: Rounds before components are looked for, and the rows and links of a component that one task finishes.
ROUNDS, COMPONENT = 3, 200_000
#: Rows of the first block, and how many times as many each further block has.
BLOCK, WIDER = 8192, 4
#: From classes (c) and other classes (c; null: the same) to pairs (a, b) of them that are near.
Near = Callable[[DataFrame, DataFrame | None], DataFrame]


def linked(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, label): the smallest node of the component of each node of edges (a, b), by least labels that jump."""
    both = scratch.saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = scratch.saved(both.groupBy(F.col("a").alias("i")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("i", "b"), "b").groupBy(F.col("a").alias("i")).agg(F.min("label").alias("near"))
        step = label.join(near, "i").select("i", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = label.select(F.col("i").alias("label"), F.col("label").alias("further"))
        after = scratch.saved(step.join(jump, "label", "left").select("i", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = not after.where("old <> label").isEmpty()
        scratch.drop(label)
        label = after
        if not moved:
            scratch.drop(both)
            return label.select("i", "label")


def _pass(rows: pd.DataFrame) -> pd.DataFrame:
    """One sequential pass over a component: rows (i, key or null, before or null), a row a conflict."""
    keys, before = {}, {}
    for i, key, other in zip(rows["i"], rows["key"], rows["before"], strict=True):
        if key is not None:
            keys.setdefault(i, []).append(key)
        if not pd.isna(other):
            before.setdefault(i, []).append(int(other))
    used, taken, out = set(), set(), []
    for i in sorted(set(rows["i"])):
        free = not used.intersection(keys.get(i, ())) and not taken.intersection(before.get(i, ()))
        if free:
            used.update(keys.get(i, ()))
            taken.add(i)
        out.append((i, free))
    return pd.DataFrame(out, columns=["i", "free"])


def first_independent(nodes: DataFrame, members: DataFrame, pairs: DataFrame, rounds: int = ROUNDS, component: int = COMPONENT) -> DataFrame:
    """(i): the nodes (i) that a pass in order of i takes; members (i, key): nodes that share a key conflict; pairs (a, b)
    of nodes conflict too. Members and pairs of unknown nodes don't count."""
    scratch = Scratch(nodes.sparkSession)
    live = scratch.saved(nodes.select(F.col("i").cast("long")).distinct())
    members = scratch.saved(members.select("i", "key").where("key is not null").distinct().join(live, "i", "left_semi"))
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = scratch.saved(ends.join(live.withColumnRenamed("i", "a"), "a", "left_semi").join(live.withColumnRenamed("i", "b"), "b", "left_semi"))
    found, turn = [], 0
    while True:
        first = members.groupBy("key").agg(F.min("i").alias("first"))
        late = members.join(first, "key").where("i > first").select("i").union(pairs.select(F.col("b").alias("i"))).distinct()
        taken = scratch.saved(live.join(late, "i", "left_anti"))
        found.append(taken)
        lost = members.join(members.join(taken, "i", "left_semi").select("key").distinct(), "key", "left_semi").select("i").union(pairs.join(taken.withColumnRenamed("i", "a"), "a", "left_semi").select("b")).distinct()
        after = scratch.saved(live.join(taken, "i", "left_anti").join(lost, "i", "left_anti"))
        turn += 1
        if after.isEmpty():
            break
        now_members = scratch.saved(members.join(after, "i", "left_semi"))
        now_pairs = scratch.saved(pairs.join(after.withColumnRenamed("i", "a"), "a", "left_semi").join(after.withColumnRenamed("i", "b"), "b", "left_semi"))
        scratch.drop(live, members, pairs)
        live, members, pairs = after, now_members, now_pairs
        if turn % rounds:
            continue
        first = members.groupBy("key").agg(F.min("i").alias("b"))
        label = linked(members.join(first, "key").select(F.col("i").alias("a"), "b").union(pairs.select("a", "b")).union(live.select(F.col("i").alias("a"), F.col("i").alias("b"))), scratch)
        none = F.lit(None)
        conflicts = members.select("i", "key", none.cast("long").alias("before")).union(pairs.select(F.col("b").alias("i"), none.cast("string"), F.col("a"))).union(live.select("i", none.cast("string"), none.cast("long")))
        conflicts = scratch.saved(conflicts.join(label, "i"))
        small = conflicts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= component).select("label")
        own = conflicts.join(small, "label", "left_semi").withColumn("key", F.col("key").cast("string"))
        done = scratch.saved(own.groupBy("label").applyInPandas(lambda pdf: _pass(pdf), "i long, free boolean"))
        found.append(done.where("free").select("i"))
        rest = scratch.saved(live.join(done, "i", "left_anti"))
        if rest.isEmpty():
            break
        live = rest
        members, pairs = scratch.saved(members.join(live, "i", "left_semi")), scratch.saved(pairs.join(live.withColumnRenamed("i", "a"), "a", "left_semi"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def first_apart(nodes: DataFrame, members: DataFrame, near: Near, block: int = BLOCK) -> DataFrame:
    """(i): the nodes (i, c: a class or null) that a pass in order of i takes; members (i, key) as for first_independent();
    nodes of one class conflict, and so do those of two classes that are near."""
    scratch = Scratch(nodes.sparkSession)
    live = scratch.saved(nodes.select(F.col("i").cast("long"), "c"))
    members = scratch.saved(members.select("i", "key").where("key is not null").distinct())
    out = None
    while True:
        n = live.count()
        cut = live.agg(F.percentile_approx("i", block / n, 10_000)).first()[0] if n > block else None
        now = live if cut is None else live.where(F.col("i") <= cut)
        classes = scratch.saved(now.select("c").where("c is not null").distinct())
        pairs = near(classes, None).select(F.explode(F.array("a", "b")).alias("c"), F.concat_ws("|", "a", "b").alias("key"))  # all of two near classes share a text
        shared = now.where("c is not null").select("i", F.col("c").cast("string").alias("key")).unionByName(now.join(pairs, "c").select("i", "key"))
        no_pairs = now.select(F.col("i").alias("a"), F.col("i").alias("b")).where("false")
        taken = scratch.saved(first_independent(now.select("i"), members.join(now, "i", "left_semi").unionByName(shared), no_pairs))
        out = taken if out is None else out.unionByName(taken)
        if cut is None:
            return out
        behind = live.where(F.col("i") > cut)
        gone = scratch.saved(now.join(taken, "i", "left_semi").select("c").where("c is not null").distinct())
        others = scratch.saved(behind.select("c").where("c is not null").distinct().join(gone, "c", "left_anti"))
        fallen = gone.union(near(gone, others).select("b")).distinct()
        used = members.join(taken, "i", "left_semi").select("key").distinct()
        after = scratch.saved(behind.join(fallen, "c", "left_anti").join(members.join(used, "key", "left_semi").select("i").distinct(), "i", "left_anti"))
        rest = scratch.saved(members.join(after, "i", "left_semi"))
        scratch.drop(live, members, classes, gone, others)
        live, members, block = after, rest, block * WIDER


def select_first(df: DataFrame, order: list[str], reason: Column, keys: dict[str, Column], shared: dict[str, DataFrame] | None = None, pairs: tuple[str, DataFrame] | None = None, key: str = "id", count: int | None = None, near: tuple[str, str, Near] | None = None) -> DataFrame:
    """Adds place (in the order), taken and reason: rows in order are taken, up to ``count`` of them, unless ``reason``
    excludes them (a text; null for eligible rows) or they conflict with a row taken before.

    keys: by reason, in the order in which they are looked at, an array of texts (or a text); rows that share one of the
    same kind conflict. shared: after them, by reason, rows (the column ``key``, v) of such texts in a table of their own;
    all of two classes conflict if each row of both has a text for the two. pairs: a reason, looked at last, and pairs (a, b) of the column ``key`` that conflict. near, in place
    of pairs: a reason, the column of a row's class, and what finds near classes; rows of one class or near ones conflict. What a row
    is excluded for is the first reason that holds; rows behind the last taken are ``not_reached``."""
    if pairs and near:
        raise ValueError("either pairs or near classes")
    scratch, shared = Scratch(df.sparkSession), shared or {}
    placed = scratch.saved(with_index(df.withColumn("_reason", reason), *order, name="place"))
    able = placed.where("_reason is null")
    kinds = dict(able.select(*(c.alias(k) for k, c in keys.items())).dtypes)

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("v")))

    listed = [named(k, c if kinds[k].startswith("array") else F.array(c)) for k, c in keys.items()]
    each = F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<struct<kind:string,v:string>>")) for x in listed))) if listed else None
    members = able.select(F.col("place").alias("i"), each.alias("k")).select("i", "k.kind", F.col("k.v").alias("v")).where("v is not null") if listed else able.select(F.col("place").alias("i"), F.lit("").alias("kind"), F.lit("").alias("v")).where("false")
    for kind, own in shared.items():
        members = members.unionByName(own.select(F.col(key).alias("_k"), F.col("v").cast("string").alias("v")).where("v is not null").join(able.select(F.col(key).alias("_k"), F.col("place").alias("i")), "_k").select("i", F.lit(kind).alias("kind"), "v"))
    members = scratch.saved(members.distinct())
    order_of = [*keys, *shared]
    if pairs is None:
        ends = members.select(F.col("i").alias("a"), F.col("i").alias("b")).where("false")
    else:
        at = able.select(F.col(key).alias("_k"), "place")
        ends = pairs[1].select("a", "b").join(at.select(F.col("_k").alias("a"), F.col("place").alias("x")), "a").join(at.select(F.col("_k").alias("b"), F.col("place").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    ends = scratch.saved(ends)
    named_keys = members.select("i", F.to_json(F.struct("kind", "v")).alias("key"))
    if near:
        chosen = first_apart(able.select(F.col("place").alias("i"), F.col(near[1]).alias("c")), named_keys, near[2])
    else:
        chosen = first_independent(able.select(F.col("place").alias("i")), named_keys, ends)
    if count is not None:
        chosen = with_index(chosen, "i", name="_n").where(F.col("_n") < count).drop("_n")
    chosen = scratch.saved(chosen)
    rank = F.coalesce(*(F.when(F.col("kind") == k, n) for n, k in enumerate(order_of)), F.lit(len(order_of)))
    by_key = members.join(members.join(chosen, "i", "left_semi").select("kind", "v", F.col("i").alias("first")), ["kind", "v"]).where("i > first").select("i", rank.alias("_why"))
    by_pair = ends.join(chosen.withColumnRenamed("i", "a"), "a", "left_semi").select(F.col("b").alias("i"), F.lit(len(order_of)).alias("_why"))
    why = by_key.union(by_pair).groupBy("i").agg(F.min("_why").alias("_why"))
    names = F.array(*map(F.lit, [*order_of, pairs[0] if pairs else ""]))
    out = placed.join(chosen.select(F.col("i").alias("place"), F.lit(True).alias("_taken")), "place", "left").join(why.withColumnRenamed("i", "place"), "place", "left")
    last = chosen.agg(F.max("i").alias("_last"), F.count(F.lit(1)).alias("_all"))  # one row
    beyond = (F.col("place") > F.col("_last")) & (F.col("_all") >= F.lit(count)) if count is not None else F.lit(False)
    said = F.when(F.coalesce("_taken", F.lit(False)), None).when(beyond, "not_reached").otherwise(F.coalesce("_reason", F.get(names, F.col("_why")), F.lit(near[0] if near else None)))  # nothing else has kept out what is near
    return out.join(F.broadcast(last)).select(*df.columns, "place", F.coalesce("_taken", F.lit(False)).alias("taken"), said.alias("reason"))


def exclusions(selected: DataFrame) -> DataFrame:
    """(reason, n): how many rows each reason has kept out, of those that were reached."""
    return selected.where("reason is not null and reason <> 'not_reached'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
