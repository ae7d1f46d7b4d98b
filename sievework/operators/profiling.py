"""Column and table profiles in one scan, deterministic statistics, ranks, scores and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIGH_CARDINALITY = 0.9


def _cells(df: DataFrame, names: list[str], order: list[Column] | None = None) -> DataFrame:
    """(name, value, number[, at]) of all cells, one scan: a row for each cell."""
    numeric = lambda c: isinstance(df.schema[c].dataType, T.NumericType)
    cell = [
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value"), (F.col(f"`{c}`").cast("double") if numeric(c) else F.lit(None).cast("double")).alias("number"))
        for c in names
    ]
    out = df.select(F.explode(F.array(*cell)).alias("c"), *([F.struct(*order).alias("at")] if order else []))
    return out.select("c.*", *(["at"] if order else []))


def column_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each column: n, n_null, null_ratio, n_distinct, min, max, mean and median of numbers, flags.

    One scan and one exchange of the distinct values of each column, whatever the number of columns.
    """
    names = names or df.columns
    values = _cells(df, names).groupBy("name", "value").agg(F.count("*").alias("c"), F.first("number").alias("number"))
    there = F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0)
    number, mass = F.col("number"), F.sum(F.when(F.col("number").isNotNull(), F.col("c")))
    out = values.groupBy("name").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") - there).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min(number).alias("min_value"),
        F.max(number).alias("max_value"),
        F.round(F.sum(number * F.col("c")) / mass, 6).alias("mean_value"),
    )
    ranks = out.where("n > n_null and min_value is not null").select(
        "name", F.explode(F.array_distinct(F.array(F.floor((F.col("n") - F.col("n_null") - 1) / 2), F.ceil((F.col("n") - F.col("n_null") - 1) / 2)))).alias("rank")
    )
    counted = values.where("number is not null").select("name", F.col("number").alias("value"), "c")
    middle = at_ranks(counted, "name", ranks).groupBy("name").agg(F.round(F.avg("value"), 6).alias("median_value"))
    out = out.join(middle, "name", "left")
    filled = F.col("n") - F.col("n_null")
    return out.select(
        F.col("name").alias("column_name"),
        "n",
        "n_null",
        F.round(F.try_divide("n_null", "n"), 6).alias("null_ratio"),
        "n_distinct",
        "min_value",
        "max_value",
        "mean_value",
        "median_value",
        ((filled > 0) & (F.col("n_distinct") <= 1)).alias("constant"),
        ((filled >= 10) & (F.col("n_distinct") >= HIGH_CARDINALITY * filled)).alias("high_cardinality"),
    )


def sample_values(df: DataFrame, order: list[Column], names: list[str] | None = None, n: int = 5) -> DataFrame:
    """(column_name, sample_values): the first ``n`` values of each column in row order that aren't null."""
    cells = _cells(df, names or df.columns, order).where("value is not null")
    first = cells.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("at"))).where(F.col("r") <= n)
    listed = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("sample_values"))
    return listed.withColumnRenamed("name", "column_name")


def time_range(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, first_value, last_value) of columns of dates and times."""
    one = df.agg(*[F.struct(F.min(c).cast("string").alias("first_value"), F.max(c).cast("string").alias("last_value")).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`.first_value").alias("first_value"), F.col(f"`{c}`.last_value").alias("last_value")) for c in names])
    return one.select(F.inline(rows))


def table_profile(df: DataFrame, names: list[str] | None = None, long: int = 200) -> DataFrame:
    """One row: row_count, column_count, null_count, empty_cell_ratio, long_text_cell_ratio, chars."""
    names = names or df.columns
    text = [F.col(f"`{c}`").cast("string") for c in names]
    total = lambda f: reduce(lambda a, b: a + b, [F.coalesce(f(t), F.lit(0)) for t in text])
    one = df.agg(
        F.count("*").alias("row_count"),
        total(lambda t: F.count_if(t.isNull())).alias("null_count"),
        total(lambda t: F.count_if(F.length(t) > long)).alias("__long"),
        total(lambda t: F.sum(F.length(t))).cast("bigint").alias("chars"),
    )
    cells = F.col("row_count") * len(names)
    ratio = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), cells), F.lit(0.0)), 6)
    return one.select("row_count", F.lit(len(names)).cast("bigint").alias("column_count"), "null_count", ratio("null_count").alias("empty_cell_ratio"), ratio("__long").alias("long_text_cell_ratio"), "chars")


#: Ranges that values are dealt into when ranks are looked for.
RANGES = 512


def at_ranks(counts: DataFrame, group: str, ranks: DataFrame) -> DataFrame:
    """(group, rank, value) for wanted zero-based (group, rank) among the values of each group in (group, value, c).

    The bounds of the ranges are taken from the data by a sketch and joined to it, so the same value is in the
    same range in every pass. Only ranges that hold a wanted rank are sorted.
    """
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = counts.groupBy(group).agg(F.percentile_approx("value", shares, 4 * RANGES).alias("bounds"))
    placed = counts.join(F.broadcast(bounds), group)
    part = F.aggregate("bounds", F.lit(0), lambda n, x: n + F.when(x < F.col("value"), 1).otherwise(0))
    placed = placed.select(group, "value", "c", part.alias("part"))
    totals = placed.groupBy(group, "part").agg(F.sum("c").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = totals.withColumn("before", before)
    hit = spans.join(F.broadcast(ranks), group).where("rank >= before and rank < before + t").select(group, "part", "before", "rank")
    some = placed.join(F.broadcast(hit.select(group, "part", "before").distinct()), [group, "part"])
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    some = some.select(group, "part", "value", "c", upto.alias("upto"))
    return some.join(F.broadcast(hit.select(group, "part", "rank")), [group, "part"]).where("rank < upto and rank >= upto - c").select(group, "rank", "value")


def duplicate_marks(df: DataFrame) -> DataFrame:
    """Every row with ``is_duplicate``: an equal row exists. Counts meet the rows in a join that can be split."""
    names = df.columns
    counts = df.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1")
    on = reduce(lambda a, b: a & b, [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in names])
    return df.alias("l").join(counts.alias("r"), on, "left").select(*[F.col(f"l.`{c}`") for c in names], F.col("r.__n").isNotNull().alias("is_duplicate"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    return df.agg(F.min(v).alias("lowest"), F.max(v).alias("highest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("deviation"))


def outlier_count(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further from the mean than ``sigmas`` sample deviations; the moments are one row."""
    moments = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__d"))
    far = F.abs(F.col(column) - F.col("__m")) > sigmas * F.col("__d")
    return df.select(column).join(F.broadcast(moments)).where(F.col("__d").isNotNull() & far).agg(F.count("*").alias("outliers"))


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), "value").limit(n)


def trend(df: DataFrame, period: Column, value: str, n: int = 50) -> DataFrame:
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean")).orderBy("period").limit(n)


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at rank (n - 1) * share, rounded half to even, among all that aren't null."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.lit(0).alias("g"), F.col(column).alias("value")).agg(F.count("*").alias("c"))
    n = counts.groupBy("g").agg(F.sum("c").alias("n"))
    wanted = n.select("g", "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    wanted = wanted.select("g", "share", F.bround((F.col("n") - 1) * F.col("share")).cast("bigint").alias("rank"))
    found = at_ranks(counts, "g", wanted.select("g", "rank").distinct())
    return wanted.join(F.broadcast(found), ["g", "rank"]).select("share", "value")


def head_middle_tail(df: DataFrame, order: str, limit: int = 18) -> DataFrame:
    """Rows of the start, the middle and the end in the order of a unique column, with their part.

    The middle's bounds come from ranks, so it is a filter on the column and no sort of half the table.
    """
    head = limit // 3
    middle = limit - 2 * head
    n = df.count()
    start = max(head, (n - middle) // 2)
    first = df.orderBy(order).limit(head).withColumn("part", F.lit("head"))
    last = df.orderBy(F.desc(order)).limit(head).withColumn("part", F.lit("tail"))
    counts = df.select(F.lit(0).alias("g"), F.col(order).alias("value"), F.lit(1).cast("bigint").alias("c"))
    ranks = df.sparkSession.createDataFrame([(0, r) for r in sorted({min(start, n - 1), min(start + middle - 1, n - 1)}) if r >= 0], "g int, rank bigint")
    ends = [r.value for r in at_ranks(counts, "g", ranks).collect()]
    mid = df.where(F.col(order).between(min(ends), max(ends)) if ends and start < n else F.lit(False)).withColumn("part", F.lit("middle"))
    rank = F.when(F.col("part") == "head", 1).when(F.col("part") == "middle", 2).otherwise(3)
    w = Window.partitionBy(order).orderBy(rank)
    return first.unionByName(mid).unionByName(last).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stratified_sample(df: DataFrame, key: str, strata: str, n: int) -> DataFrame:
    """``n`` rows of each class in the order of a stable hash."""
    w = Window.partitionBy(strata).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return df.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= n)


def cell_score(expected: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters of a comparison cell by cell: matched, differing, missing, extra."""
    e = expected.select(*keys, F.col(value).alias("__e"), F.lit(True).alias("__in_e"))
    f = found.select(*keys, F.col(value).alias("__f"), F.lit(True).alias("__in_f"))
    both = e.join(f, keys, "full_outer")
    here = F.col("__in_e").isNotNull() & F.col("__in_f").isNotNull()
    return both.agg(
        F.count_if(here & F.col("__e").eqNullSafe(F.col("__f"))).alias("matched"),
        F.count_if(here & ~F.col("__e").eqNullSafe(F.col("__f"))).alias("differing"),
        F.count_if(F.col("__in_f").isNull()).alias("missing"),
        F.count_if(F.col("__in_e").isNull()).alias("extra"),
    )


def halves(df: DataFrame, positive: Column, order: list[Column], n: int) -> DataFrame:
    """A sample of ``n`` rows: half positive at most, negatives up to ``n``, then what is left of either; ``place`` from 1."""
    rows = df.withColumn("__p", positive)
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    first = rows.withColumn("__own", own).where(F.col("__own") <= n)
    count = rows.agg(F.count_if(F.col("__p")).alias("pos"), F.count_if(~F.col("__p")).alias("neg"))
    p = F.least(F.col("pos"), F.lit(n // 2))
    limits = count.select(p.alias("p"), F.least(F.col("neg"), F.lit(n) - p).alias("q"))
    tier = F.when(F.col("__p") & (F.col("__own") <= F.col("p")), 0).when(~F.col("__p") & (F.col("__own") <= F.col("q")), 1).when(F.col("__p"), 2).otherwise(3)
    chosen = first.join(F.broadcast(limits)).withColumn("__tier", tier).orderBy("__tier", "__own").limit(n)
    place = F.row_number().over(Window.orderBy("__tier", "__own")).cast("bigint")  # n rows at most
    return chosen.withColumn("place", place).select(*df.columns, "place")


def throughput(df: DataFrame, count: str, seconds: str) -> Column:
    """Items a second, 0 without any time."""
    return F.coalesce(F.try_divide(F.col(count), F.when(F.col(seconds) > 0, F.col(seconds))), F.lit(0.0))


def match_tables(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(e_id, f_id, page) of tables matched on their page: (id, page, idx), idx null in ``expected`` for any.

    Expected tables go in order of page and index, those without an index first; each takes the first free
    candidate. So the k-th without an index takes the k-th candidate, and one with an index takes its own
    unless that is among the first taken.
    """
    order = Window.partitionBy("page").orderBy(F.coalesce("idx", F.lit(0)), "id")
    named = Window.partitionBy("page", "idx").orderBy("id")
    e = expected.select("page", F.col("id").alias("e_id"), "idx", F.row_number().over(order).alias("k"), F.row_number().over(named).alias("again"))
    free = e.groupBy("page").agg(F.count_if(F.col("idx").isNull()).alias("free"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("idx", "id"))
    f = found.select("page", F.col("id").alias("f_id"), F.col("idx").alias("f_idx"), rank.alias("rank"), F.row_number().over(Window.partitionBy("page", "idx").orderBy("id")).alias("f_again"))
    any_table = Window.partitionBy("page").orderBy("e_id")
    first = e.where("idx is null").withColumn("rank", F.row_number().over(any_table)).join(f, ["page", "rank"]).select("e_id", "f_id", "page")
    own = e.where("idx is not null").join(f.join(free, "page", "left").where("rank > coalesce(free, 0)"), ["page"]).where("idx = f_idx")
    # equal indexes on a page pair up in order of id
    own = own.withColumn("a", F.dense_rank().over(Window.partitionBy("page", "idx").orderBy("e_id"))).withColumn("b", F.dense_rank().over(Window.partitionBy("page", "idx").orderBy("f_id")))
    return first.unionByName(own.where("a = b").select("e_id", "f_id", "page"))


def table_scores(expected: DataFrame, found: DataFrame, e_cells: DataFrame, f_cells: DataFrame) -> DataFrame:
    """The counters of a comparison of whole tables: (id, page, idx, rows, columns) and cells (id, row, col, value)."""
    from sievework.functions.text import cell

    pairs = match_tables(expected, found)
    e, f = (t.select(F.col("id").alias(f"{k}_id"), F.col("rows").alias(f"{k}_rows"), F.col("columns").alias(f"{k}_columns")) for t, k in ((expected, "e"), (found, "f")))
    both = e.join(pairs.select("e_id", "f_id"), "e_id", "left").join(f, "f_id", "full_outer")
    size = lambda k: F.coalesce(F.col(f"{k}_rows") * F.col(f"{k}_columns"), F.lit(0))
    hit, rows, columns = F.col("e_id").isNotNull() & F.col("f_id").isNotNull(), F.col("e_rows") == F.col("f_rows"), F.col("e_columns") == F.col("f_columns")
    tables = both.agg(
        F.count("e_id").alias("expected_tables"),
        F.count("f_id").alias("detected_tables"),
        F.count_if(hit).alias("true_positives"),
        F.count_if(F.col("f_id").isNull()).alias("false_negatives"),
        F.count_if(F.col("e_id").isNull()).alias("obvious_false_positives"),
        F.count_if(hit & rows & columns).alias("exact_shape_matches"),
        F.count_if(hit & rows).alias("row_count_matches"),
        F.count_if(hit & columns).alias("column_count_matches"),
        F.coalesce(F.sum(size("e")), F.lit(0)).alias("expected_cells"),
        F.coalesce(F.sum(size("f")), F.lit(0)).alias("detected_cells"),
    )
    key = ["e_id", "row", "col"]
    value = F.struct("value", cell(F.col("value")).alias("norm"))
    a = e_cells.select(F.col("id").alias("e_id"), "row", "col", value.alias("x"))
    b = f_cells.join(pairs.select("e_id", "f_id"), F.col("id") == F.col("f_id"), "left").select(F.coalesce(F.col("e_id").cast("string"), F.concat(F.lit("?"), F.col("id").cast("string"))).alias("e_id"), "row", "col", value.alias("y"))
    cells = a.withColumn("e_id", F.col("e_id").cast("string")).join(b, key, "full_outer")
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = cells.agg(
        F.count_if(here & F.col("x.value").eqNullSafe(F.col("y.value"))).alias("exact_cell_matches"),
        F.count_if(here & F.col("x.norm").eqNullSafe(F.col("y.norm"))).alias("normalized_cell_matches"),
        F.count_if(F.col("y").isNull()).alias("missing_cells"),
        F.count_if(F.col("x").isNull()).alias("extra_cells"),
    )
    return tables.crossJoin(F.broadcast(counts))


def cell_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overlap, cells): cells equal at the same place, and the cells of the larger of two matrices (keys, row, col, value)."""
    area = lambda t, k: t.groupBy(*keys).agg(((F.max("row") + 1) * (F.max("col") + 1)).alias(k))
    same = a.alias("a").join(b.alias("b"), [*keys, "row", "col"]).where(F.col("a.value").eqNullSafe(F.col("b.value"))).groupBy(*keys).agg(F.count("*").alias("overlap"))
    sizes = area(a, "x").join(area(b, "y"), keys, "full_outer").select(*keys, F.greatest("x", "y").cast("bigint").alias("cells"))
    return sizes.join(same, keys, "left").select(*keys, F.coalesce("overlap", F.lit(0)).alias("overlap"), "cells")


def page_consistency(native: DataFrame, image: DataFrame) -> DataFrame:
    """(page, count_equal, shapes_equal) of tables (page, ordinal, rows, columns) seen natively and on pictures, paired in order."""
    sides = [t.select("page", "ordinal", F.struct("rows", "columns").alias(k)) for t, k in ((native, "a"), (image, "b"))]
    both = sides[0].join(sides[1], ["page", "ordinal"], "full_outer")
    return both.groupBy("page").agg((F.count("a") == F.count("b")).alias("count_equal"), F.count_if(F.col("a") == F.col("b")).alias("shapes_equal"))
