"""Relational operators that Spark has no single call for, as compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.session import written


def cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# --- one row a key -------------------------------------------------------------------------------


def first_per_key(df: DataFrame, keys, *order) -> DataFrame:
    """The first row of each key in a total order: first or last wins, arg-max, upsert by priority (SNK-06, SET-02..04, AGG-10)."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_k(df: DataFrame, keys, k: int, *order, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered (WIN-09)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order))).filter(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Rows of new, and rows of old whose key new does not have (SNK-05)."""
    return new.unionByName(old.join(new.select(*cols(keys)), cols(keys), "left_anti"))


def retain(old: DataFrame, new: DataFrame, keys, referenced: Sequence[DataFrame], close: dict[str, Column]) -> DataFrame:
    """New rows, and stale ones that something refers to, which stay but are closed (SNK-08)."""
    k = cols(keys)
    stale = old.join(new.select(*k), k, "left_anti")
    held = None
    for r in referenced:
        held = r.select(*k) if held is None else held.union(r.select(*k))
    return new.unionByName(stale.join(held.distinct(), k, "left_semi").withColumns(close))


# --- joins ---------------------------------------------------------------------------------------


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, on=(), how: str = "inner") -> DataFrame:
    """Points with the inclusive integer ranges that hold them (JOI-14), as an equi-join on buckets of `width`.

    A range is laid into every bucket that it touches, an open end is not allowed; so no nested loop runs over both sides.
    """
    p = points.withColumn("__b", F.floor(F.col(point) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    keys = ["__b", *cols(on)]
    cond = (p[point] >= r[start]) & (p[point] <= r[end])
    for k in keys:
        cond &= p[k] == r[k]
    out = p.join(r, cond, how)
    for k in keys:
        out = out.drop(r[k])
    return out.drop("__b")


def asof_backward(left: DataFrame, right: DataFrame, keys, time: str, right_time: str, tie: str, strict: bool = True) -> DataFrame:
    """Each left row with the latest right row of its key before it; unmatched rows are dropped, ties go to the greater `tie` (JOI-15).

    Both sides are laid on end and the last right row is carried forward, so the join needs one sort and no pairs.
    """
    k = cols(keys)
    r = right.select(*k, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.struct(*[F.col(c) for c in right.columns]).alias("__r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__l"), F.col(tie).cast("string").alias("__tie"))
    a = left.select(*k, F.col(time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__r"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit("").alias("__tie"))
    w = Window.partitionBy(*k).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(r).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__l IS NOT NULL AND __r IS NOT NULL")
    return out.select("__l.*", *[F.col(f"__r.{c}").alias(f"right_{c}") for c in right.columns])


def nearest_gap(source: DataFrame, target: DataFrame, keys, s_time: str, t_time: str, s_id: str, t_id: str) -> DataFrame:
    """One pair a key: the least non-negative target - source, then the latest source, then ids (JOI-16).

    Each target only needs the latest source at or before it, of least id: one window over both sides, no pairs.
    """
    k = cols(keys)
    own = [c for c in source.columns if c not in k], [c for c in target.columns if c not in k]
    a = source.select(*k, F.col(s_time).alias("__t"), F.struct(*own[0]).alias("__s"), F.lit(None).cast(target.select(F.struct(*own[1]).alias("x")).schema["x"].dataType).alias("__e"))
    b = target.select(*k, F.col(t_time).alias("__t"), F.lit(None).cast(source.select(F.struct(*own[0]).alias("x")).schema["x"].dataType).alias("__s"), F.struct(*own[1]).alias("__e"))
    # of the sources of one time the one of least id comes last; targets follow the sources of their time
    w = Window.partitionBy(*k).orderBy("__t", F.col("__e").isNotNull(), F.desc(f"__s.{s_id}")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).filter("__t IS NOT NULL").withColumn("__s", F.last("__s", ignorenulls=True).over(w)).filter("__e IS NOT NULL AND __s IS NOT NULL")
    j = both.select(*k, "__s.*", "__e.*").withColumn("gap", F.col(t_time) - F.col(s_time))
    return first_per_key(j, keys, "gap", F.desc(s_time), s_id, t_id)


def pairs(df: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """Items that share groups: left < right, in how many (JOI-17). Rows must be distinct; a group's pairs grow with its square, so groups are for the caller to bound."""
    a, b = df.select(F.col(group), F.col(item).alias("left_id")), df.select(F.col(group), F.col(item).alias("right_id"))
    return a.join(b, group).filter("left_id < right_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def greedy_overlap(spans: Column) -> Column:
    """Of an array of (start, end, ...) structs in order of priority, those that overlap no earlier kept one; half-open (JOI-13)."""
    return F.aggregate(
        spans,
        F.slice(spans, 1, 0),
        lambda kept, s: F.when(F.exists(kept, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(s))),
    )


def diff(base: DataFrame, cur: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """added, removed, updated or unchanged for every key, and the fields that changed (JOI-20)."""
    a = base.select(F.col(key), F.lit(1).alias("__a"), *[F.col(f).alias(f"__a_{f}") for f in fields])
    b = cur.select(F.col(key), F.lit(1).alias("__b"), *[F.col(f).alias(f"__b_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return a.join(b, key, "full_outer").select(key, state.alias("change"), F.when(both, F.array_join(changed, ",")).otherwise(F.lit("")).alias("changed_fields"))


def override_lookup(df: DataFrame, override: DataFrame, rules: DataFrame, key: str, label: str, value: str, default: str) -> DataFrame:
    """A value by key, else by label, else a default, with its basis (JOI-09)."""
    o = override.select(key, F.col(value).alias("__o"))
    r = rules.select(label, F.col(value).alias("__r"))
    basis = F.when(F.col("__o").isNotNull(), "override").when(F.col("__r").isNotNull(), "rule").otherwise("default")
    return df.join(o, key, "left").join(r, label, "left").select(*[df[c] for c in df.columns if c != label], label, F.coalesce("__o", "__r", F.lit(default)).alias(value), basis.alias("basis"))


def not_exactly_one(df: DataFrame, key: str, groups: DataFrame, member: str) -> DataFrame:
    """Keys whose member stands in no group, or in several (JOI-10); must be empty for a sound grouping."""
    return df.join(groups, member, "left").groupBy(key).agg(F.count(groups.columns[0]).alias("matches")).filter("matches <> 1")


def overlay(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Snapshots in order: the last one that has a key wins (JOI-33, SET-03)."""
    every = None
    for i, d in enumerate(layers):
        d = d.withColumn("__layer", F.lit(i))
        every = d if every is None else every.unionByName(d)
    return first_per_key(every, key, F.desc("__layer")).drop("__layer")


def fill(first: DataFrame, second: DataFrame, keys, value: str, names=("first", "second")) -> DataFrame:
    """A value from the first source, gaps from the second, with its origin (JOI-32)."""
    k = cols(keys)
    a, b = first.select(*k, F.col(value).alias("__a")), second.select(*k, F.col(value).alias("__b"))
    return a.join(b, k, "full_outer").select(*k, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), names[0]).otherwise(names[1]).alias("origin"))


def closure(spark, nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth, path (root first), cyclic: parent chains by a recursive query that stops at a cycle (JOI-26).

    A chain longer than Spark's recursion limits (spark.sql.cteRecursionLevelLimit, ...RowLimit) is an error, not a shorter path.
    """
    t = nodes.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"))
    return spark.sql("""
WITH RECURSIVE up(node, at, depth, path, cyclic) AS (
  SELECT node, parent, 0, array(node), false FROM {t}
  UNION ALL
  SELECT u.node, c.parent, u.depth + 1, concat(array(c.node), u.path), array_contains(u.path, c.node)
  FROM up u JOIN {t} c ON u.at = c.node WHERE NOT u.cyclic)
SELECT node, max(depth) AS depth, max_by(path, depth) AS path, bool_or(cyclic) AS cyclic FROM up GROUP BY node""", t=t)


# --- ordered operators ---------------------------------------------------------------------------


def ordinals(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """df with the place of each row, from 1, in a total order: ranges of it are sorted each in its partition, and only a count a partition is summed.

    The ranges are written once, for Spark draws their bounds from samples that may differ when they are made again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    placed = written(ranged.select("*", part.alias("__part"), row.alias("__row")).drop("__id"))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__row") + 1).drop("__part", "__row", "__base")


def consecutive(df: DataFrame, keys, order: Sequence, id: str) -> DataFrame:
    """An edge from each row to the next one of its key (WIN-01)."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order)
    return df.select(*cols(keys), F.lag(id).over(w).alias("source"), F.col(id).alias("target")).filter("source IS NOT NULL")


def islands(df: DataFrame, keys, position: str, *same: str) -> DataFrame:
    """Runs of consecutive positions in which further columns stay the same: first, last, length (WIN-05)."""
    k = [*cols(keys), *same]
    w = Window.partitionBy(*k).orderBy(position)
    marked = df.withColumn("__run", F.col(position) - F.row_number().over(w))
    return marked.groupBy(*k, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def carry_forward(df: DataFrame, keys, order: Sequence, value: str, name: str) -> DataFrame:
    """The last value that was not null, up to each row (WIN-06, WIN-08)."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def lead_ranges(df: DataFrame, keys, start: str, last: Column) -> DataFrame:
    """Each start with an end just before the next start, the last one with `last` (WIN-04)."""
    w = Window.partitionBy(*cols(keys)).orderBy(start)
    return df.withColumn("range_end", F.coalesce(F.lead(start).over(w) - 1, last))


def drop_adjacent(df: DataFrame, keys, order: Sequence, *same: str) -> DataFrame:
    """Without rows that equal the one before them, nulls alike (WIN-07)."""
    w = Window.partitionBy(*cols(keys)).orderBy(*order)
    new = F.row_number().over(w) == 1
    for c in same:
        new |= ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__new", new).filter("__new").drop("__new")


def breaks(df: DataFrame, keys, start: str, end: str, contiguous: bool = True) -> DataFrame:
    """Ranges that do not begin right after the one before (WIN-16), or, if gaps are allowed, that overlap it (WIN-17)."""
    w = Window.partitionBy(*cols(keys)).orderBy(start)
    before = F.lag(end).over(w)
    bad = (before + 1 != F.col(start)) if contiguous else (before >= F.col(start))
    return df.withColumn("__bad", F.coalesce(bad, F.lit(False))).filter("__bad").drop("__bad")


# --- aggregates ----------------------------------------------------------------------------------


def histogram(df: DataFrame, c: Column, name: str, keys: Sequence[str] | None = None, missing: str = "unknown") -> DataFrame:
    """Counts by value, null as `missing`; with keys, exactly these, zeros included (AGG-08)."""
    out = df.groupBy(F.coalesce(c, F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    if keys is None:
        return out
    every = df.sparkSession.createDataFrame([(k,) for k in keys], f"{name} string")
    return every.join(out, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def rate(n: Column, d: Column, per: float = 10000, digits: int = 4, empty=None) -> Column:
    """n a `per` of d; `empty` if d is 0 (AGG-14)."""
    return F.when(d > 0, F.round(n / d * per, digits)).otherwise(F.lit(empty).cast("double"))


def digest(order: Column, text: Column) -> Column:
    """Aggregate: SHA-256 of texts joined by line feeds in an order (AGG-29)."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").cast("binary"), 256)


def bounds(*columns: str) -> list[Column]:
    """Aggregates: the bounding box (AGG-27)."""
    return [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]


# --- gates ---------------------------------------------------------------------------------------


def reasons(**conditions: Column) -> Column:
    """The names of all conditions that hold, in the order given; null counts as not (FLT-18)."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))


def checks(*frames: tuple[str, DataFrame]) -> DataFrame:
    """check, violations, passed for frames that must be empty (GAT-11, GAT-12, GAT-19)."""
    out = None
    for name, df in frames:
        one = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))
        out = one if out is None else out.union(one)
    return out


def require(df: DataFrame, what: str) -> None:
    """Fail closed: raise if a frame that must be empty is not."""
    if row := df.limit(1).collect():
        raise ValueError(f"{what}: {row[0].asDict()}")


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with multiplicity, and which (SET-05, SNK-02, SNK-03)."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))
