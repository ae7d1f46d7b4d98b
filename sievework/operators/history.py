"""Append-only history: the latest row of a key, and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Catalyst prunes to ``n`` rows a task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def classify_changes(before: DataFrame, now: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """(key, change) with change new, changed, unchanged or missing; a key is one row in either snapshot."""
    old = before.select(F.col(key), F.lit(True).alias("__had"), *[F.col(m).alias(f"__{m}") for m in marks])
    new = now.select(F.col(key), F.lit(True).alias("__has"), *marks)
    same = F.lit(True)
    for m in marks:
        same = same & F.col(m).eqNullSafe(F.col(f"__{m}"))
    both = new.join(old, key, "full_outer")
    change = F.when(F.col("__has").isNull(), "missing").when(F.col("__had").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def status_ladder(latest: DataFrame, key: str, route: str, status: str, routes: list[str]) -> DataFrame:
    """One status for each key from its routes' latest statuses."""
    wide = latest.groupBy(key).pivot(route, routes).agg(F.max(status))
    any_is = lambda value: F.coalesce(F.array_contains(F.array(*[F.coalesce(F.col(r), F.lit("")) for r in routes]), value), F.lit(False))
    return wide.select(key, *routes, F.when(any_is("failed"), "failed").when(any_is("partial"), "partial").when(any_is("done"), "done").otherwise("pending").alias("overall"))


def current_flags(runs: DataFrame, keys: list[str], content: str, ok: str, order: list[Column]) -> DataFrame:
    """Runs with ``is_current``: the latest successful one, unless a later failure saw other content.

    A failure retires what it contradicts for good: a later failure on the old content doesn't bring it back.
    ``order`` is newest first.
    """
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later_ok = F.coalesce(F.max(F.col(ok).cast("int")).over(after), F.lit(0))
    # the contents of all later failures are one and the same as this run's, or there are none
    low = F.min(F.when(~F.col(ok), F.col(content))).over(after)
    high = F.max(F.when(~F.col(ok), F.col(content))).over(after)
    same = low.isNull() | (low.eqNullSafe(F.col(content)) & high.eqNullSafe(F.col(content)))
    return runs.withColumn("is_current", F.col(ok) & (later_ok == 0) & same)


def upserted(before: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """Known rows after a batch: the newest values of each key, with the first and last time that it was seen."""
    old = before.select(*[c for c in before.columns if c not in ("first_seen", "last_seen")], F.col("first_seen"), F.col("last_seen"))
    new = rows.withColumn("first_seen", F.col(at)).withColumn("last_seen", F.col(at)).drop(at)
    both = old.unionByName(new)
    seen = both.groupBy(key).agg(F.min("first_seen").alias("__a"), F.max("last_seen").alias("__b"))
    last = latest_by(both, [key], [F.desc("last_seen"), *[F.desc(c) for c in sorted(both.columns) if c not in (key, "first_seen", "last_seen")]])
    return last.drop("first_seen", "last_seen").join(seen, key).withColumnsRenamed({"__a": "first_seen", "__b": "last_seen"})


def reconciled(runs: DataFrame, status: str = "status") -> DataFrame:
    """After a restart nothing is running any more: running runs were interrupted, queued ones wait again."""
    return runs.withColumn(status, F.when(F.col(status) == "running", "interrupted").otherwise(F.col(status)))


def to_do(candidates: DataFrame, runs: DataFrame, identity: list[str], ok: tuple[str, ...] = ("successful", "partial")) -> DataFrame:
    """Candidates without a finished run of the same identity; the others' results are used again."""
    done = runs.where(F.col("status").isin(*ok)).select(*identity).distinct()
    return candidates.join(done, identity, "left_anti")


def reusable(candidates: DataFrame, runs: DataFrame, identity: list[str], order: list[Column], ok: tuple[str, ...] = ("successful", "partial")) -> DataFrame:
    """Candidates with the newest finished run of their identity."""
    return candidates.join(latest_by(runs.where(F.col("status").isin(*ok)), identity, order), identity)


def missing_paths(before: DataFrame, seen: DataFrame, unreadable: DataFrame, path: str = "path") -> DataFrame:
    """Known paths that are gone: not seen, not missing already, and not below a folder that could not be read."""
    gone = before.where("state <> 'missing'").join(seen.select(path), path, "left_anti")
    below = F.expr(f"startswith({path}, concat(folder, '/'))")
    return gone.join(F.broadcast(unreadable.select("folder")), below, "left_anti")  # folders that failed: few


def first_last_seen(rows: DataFrame, key: str, at: str, what: str) -> DataFrame:
    """(key, first_seen, last_seen, first_what, last_what, n); ties in time go to the smaller value."""
    order = F.struct(F.col(at), F.col(what))
    g = rows.groupBy(key).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n"))
    return g.select(key, F.col(f"a.{at}").alias("first_seen"), F.col(f"b.{at}").alias("last_seen"), F.col(f"a.{what}").alias(f"first_{what}"), F.col(f"b.{what}").alias(f"last_{what}"), "n")
