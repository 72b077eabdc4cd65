"""Anomalies of a run against the run history.

History is reduced before it meets the current files: to one row per payload hash, per certified
day, and per baseline day. What is joined is then bounded by days and hashes, not by how many runs
one property has, and no join has to pair every run with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import blank_to_null, call


# -- reading history -------------------------------------------------------------------------

def first_json(doc: Column, paths: list[str], as_type: str) -> Column:
    """First alias, in order, that holds a value of the wanted type (blank strings do not count)."""
    parsed = call("try_parse_json", doc)
    out = []
    for p in paths:
        v = call("try_variant_get", parsed, p, "string")
        v = blank_to_null(v)
        out.append(v.try_cast(as_type) if as_type != "string" else v)
    return F.coalesce(*out)


def row_count(doc: Column, strict_aliases: bool = True) -> Column:
    paths = fx.ROW_COUNT_PATHS if strict_aliases else [*fx.ROW_COUNT_PATHS, "$.total_read_rows"]
    return first_json(doc, paths, "bigint")


def checksum(doc: Column) -> Column:
    return first_json(doc, fx.CHECKSUM_PATHS, "string")


def net_amount(doc: Column) -> Column:
    return first_json(doc, fx.NET_AMOUNT_PATHS, "double")


def history_scope(history: DataFrame, keys: list[str], date: str, since: Column, newest: int,
                  tie: str) -> DataFrame:
    """Runs inside the lookback, newest first, at most `newest` per scope.

    The rank filter is pushed below the shuffle, so each task forwards at most `newest` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc(), F.col(tie).desc())
    return (
        history.where(F.col(date) >= since).withColumn("age_rank", F.row_number().over(w))
        .where(F.col("age_rank") <= newest)
    )


def scoped(asked: DataFrame, reduced: DataFrame, scope: list[str]) -> DataFrame:
    """Reduced history under the scopes asked for: a key that is null on either side matches every value.

    `asked` has one row per scope, `reduced` one row per scope and day or hash, never one per run. Askers look up each
    combination of their values and null, so a row with keys is found by an equi-join. Askers that lack a key
    themselves meet the rows on the keys they have; the one scope without any key meets them all.
    """
    parts = []
    for mask in range(1 << len(scope)):
        have = [k for i, k in enumerate(scope) if not mask >> i & 1]
        mine = asked
        for k in scope:
            mine = mine.where(F.col(k).isNotNull() if k in have else F.col(k).isNull())
        left = mine.select(*[F.col(k).alias(f"_a_{k}") for k in scope])
        for k in have:
            left = left.withColumn(f"_k_{k}", F.explode(F.array(F.col(f"_a_{k}"), F.lit(None).cast("string"))))
        on = [F.col(f"_k_{k}").eqNullSafe(reduced[k]) for k in have]
        if not have:  # at most the one scope of nulls, which every row meets under an empty key
            left = F.broadcast(left.limit(1))
            empty = lambda key: F.substring(F.coalesce(key, F.lit("")), 1, 0)
            on = [empty(F.col(f"_a_{scope[0]}")) == empty(reduced[scope[0]])]
        parts.append(left.join(reduced, on).drop(*scope, *[f"_k_{k}" for k in have]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnsRenamed({f"_a_{k}": k for k in scope})


def regrouped(found: DataFrame, by: list[str]) -> DataFrame:
    """Reduced rows that `scoped` brought together, reduced again: sums of counts and moments, extremes of the rest."""
    merge = {"low_hash": F.min, "high_hash": F.max, "last_released_on": F.max}
    return found.groupBy(*by).agg(*[merge.get(c, F.sum)(c).alias(c) for c in found.columns if c not in by])


def joined_by_scope(left: DataFrame, right: DataFrame, scope: list[str], keys: list[str], how: str = "left") -> DataFrame:
    """Join on the scope, where null equals null, and on further keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in [*scope, *keys]})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in scope] + [F.col(k) == F.col(f"_r_{k}") for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in [*scope, *keys]])


def upper_outcome(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


# -- duplicates and drift --------------------------------------------------------------------

def released_hashes(history: DataFrame, scope: list[str], date: str, checksum: str, outcome: str) -> DataFrame:
    """Payload hashes already released, one row per scope and hash, with the last day of each."""
    return (
        history.where(upper_outcome(F.col(outcome)).isin(fx.RELEASED) & (F.coalesce(F.col(checksum), F.lit("")) != ""))
        .groupBy(*scope, checksum).agg(F.count(F.lit(1)).alias("released_runs"), F.max(date).alias("last_released_on"))
    )


EVIDENCE = 10


def first_rows(rows: DataFrame, by: list[str], order: list[Column], keep: int = EVIDENCE) -> DataFrame:
    """The first rows of every group. Tasks pass on no more than `keep` of a group, so no group is ever gathered."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= keep).drop("_rank")


def listed(rows: DataFrame, by: list[str], item: list[str], name: str) -> DataFrame:
    """One list per group of rows that `first_rows` has bounded, in the order of the item's columns."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*item))).alias(name))


def matching_runs(history: DataFrame, asked: DataFrame, scope: list[str], date: str, checksum: str, outcome: str, run: str,
                  keep: int = EVIDENCE) -> DataFrame:
    """Evidence for duplicates: (scope, checksum, matches), the newest released runs with the payload asked about.

    asked: scope and checksum, a row each. Ties of a date go by run id. matches: array of (age, run, date, outcome).
    """
    wanted = asked.select(checksum).distinct()
    order = [F.col(date).desc_nulls_last(), F.col(run)]
    rows = history.where(upper_outcome(F.col(outcome)).isin(fx.RELEASED)).join(wanted, checksum, "left_semi").select(*scope, checksum, run, date, outcome)
    found = first_rows(scoped(asked.select(*scope).distinct(), first_rows(rows, [*scope, checksum], order, keep), scope), [*scope, checksum], order, keep)
    age = F.coalesce(-F.unix_date(F.col(date)), F.lit(1 << 30))
    return listed(found.withColumn("age", age), [*scope, checksum], ["age", run, date, outcome], "matches")


def conflicting_runs(history: DataFrame, asked: DataFrame, scope: list[str], date: str, checksum: str, outcome: str, run: str,
                     keep: int = EVIDENCE) -> DataFrame:
    """Evidence for drift: (scope, date, certified), certified runs of the days asked about: of each of the keep + 1 hashes
    that come first by run id, the first `keep` runs. Whatever hash an asker has, its first conflicts are among them."""
    days = asked.select(date).distinct()
    certified = upper_outcome(F.col(outcome)).isin(fx.CERTIFIED) & (F.coalesce(F.col(checksum), F.lit("")) != "")
    rows = history.where(certified).join(days, date, "left_semi").select(*scope, date, checksum, run, outcome)

    def bounded(some: DataFrame) -> DataFrame:
        some = first_rows(some, [*scope, date, checksum], [F.col(run)], keep)
        best = F.min(run).over(Window.partitionBy(*scope, date, checksum))
        rank = F.dense_rank().over(Window.partitionBy(*scope, date).orderBy("_best", checksum))
        return some.withColumn("_best", best).withColumn("_rank", rank).where(F.col("_rank") <= keep + 1).drop("_best", "_rank")

    found = bounded(scoped(asked.select(*scope).distinct(), bounded(rows), scope))
    return listed(found, [*scope, date], [run, checksum, outcome], "certified")


def conflicts(certified: Column, checksum: str, own: Column, keep: int = EVIDENCE) -> Column:
    """The first certified runs with another hash than one's own."""
    return F.slice(F.filter(certified, lambda r: r[checksum] != own), 1, keep)


def certified_days(history: DataFrame, scope: list[str], date: str, checksum: str, outcome: str) -> DataFrame:
    """Smallest and largest certified hash per day: another hash than mine exists iff one differs."""
    return (
        history.where(upper_outcome(F.col(outcome)).isin(fx.CERTIFIED) & (F.coalesce(F.col(checksum), F.lit("")) != ""))
        .groupBy(*scope, date, checksum).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*scope, date).agg(
            F.min(checksum).alias("low_hash"), F.max(checksum).alias("high_hash"), F.sum("_n").alias("certified_runs"))
    )


def drifted(own_hash: Column, low: Column, high: Column) -> Column:
    return F.coalesce((low != own_hash) | (high != own_hash), F.lit(False))


# -- frozen window ---------------------------------------------------------------------------

def frozen_verdict(day: Column, as_of: Column, open_days: Column) -> Column:
    return (
        F.when(day.isNull(), "UNPARSEABLE")
        .when(day < F.date_sub(as_of, F.greatest(F.lit(0), open_days)), "FROZEN")
        .otherwise("OPEN")
    )


# -- rolling baseline ------------------------------------------------------------------------

def baseline_days(history: DataFrame, scope: list[str], date: str, rows: str, amount: str | None,
                  outcome: str) -> DataFrame:
    """Count, sum and sum of squares of the baseline runs per day, exact in decimals."""
    kept = history.where(F.upper(F.coalesce(F.col(outcome), F.lit("PASS"))).isin(fx.BASELINE) & F.col(date).isNotNull())
    x = F.col(rows).cast("decimal(18,0)")
    aggs = [F.count(rows).alias("n"), F.sum(x).alias("s"), F.sum((x * x).cast("decimal(38,0)")).alias("ss")]
    if amount:
        a = F.round(F.col(amount) * 100).try_cast("decimal(18,0)")  # what cannot be summed is not counted either
        aggs += [F.count(a).alias("an"), F.sum(a).alias("asum"), F.sum((a * a).cast("decimal(38,0)")).alias("ass")]
    return kept.groupBy(*scope, date).agg(*aggs)


def spread(n: Column, s: Column, ss: Column) -> Column:
    """Population standard deviation from exact sums; zero stays exactly zero."""
    wide = n.cast("decimal(18,0)")
    exact = F.try_subtract(call("try_multiply", wide, ss.cast("decimal(38,0)")),
                           call("try_multiply", s.cast("decimal(38,0)"), s.cast("decimal(38,0)")))
    rough = n * ss.cast("double") - s.cast("double") * s.cast("double")
    return F.sqrt(F.greatest(F.coalesce(exact.cast("double"), rough), F.lit(0.0))) / n


def rolling(days: DataFrame, scope: list[str], date: str, window_days: int, same_weekday: bool = False,
            sums: tuple[str, ...] = ("n", "s", "ss")) -> DataFrame:
    """Baseline sums over [day - window, day) for every day of the table itself (back-test form).

    The window runs over day totals, so a partition has as many rows as there are days.
    """
    by = [*scope, F.weekday(date)] if same_weekday else scope
    w = Window.partitionBy(*by).orderBy(F.unix_date(F.col(date))).rangeBetween(-max(1, window_days), -1)
    return days.select("*", *[F.sum(c).over(w).alias(f"base_{c}") for c in sums])


def baseline_for(asked: DataFrame, days: DataFrame, scope: list[str], date: str, window_days: Column,
                 same_weekday: Column, sums: tuple[str, ...] = ("n", "s", "ss"),
                 oldest: Column | None = None) -> DataFrame:
    """Baseline sums for the (scope, day) pairs asked for (current-batch form), by differences of running sums.

    A scope's day totals are summed up along its days, once over all days and once per weekday; a window is what the
    sum has gained between its two ends. Ends are rows among the days, so both lookups are one running sum: no
    row per day of a window, and a partition holds as many rows as a scope has days and ends. `sums` come in threes: a
    count, a sum and a sum of squares. Windows without any run have no row.
    """
    settings = [c for c in asked.columns if c not in scope and c != date]
    low = F.date_sub(F.col(date), F.greatest(F.lit(1), window_days).cast("int"))
    if oldest is not None:
        low = F.greatest(low, oldest)
    # contracts with other windows on one scope and day have baselines of their own
    pairs = asked.distinct().withColumn("_low", F.least(low, F.col(date))).withColumn("_lane", F.when(same_weekday, F.weekday(date)).otherwise(-1))
    pairs = pairs.where(F.col(date).isNotNull())
    ends = pairs.select(*scope, "_lane", F.explode(F.array("_low", date)).alias("_day")).distinct()
    zero = [F.lit(0).cast(days.schema[c].dataType).alias(c) for c in sums]
    lanes = days.select(*scope, F.explode(F.array(F.lit(-1), F.weekday(date))).alias("_lane"), F.col(date).alias("_day"), F.lit(1).alias("_kind"), *sums)
    both = ends.select(*scope, "_lane", "_day", F.lit(0).alias("_kind"), *zero).unionByName(lanes)
    so_far = Window.partitionBy(*scope, "_lane").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.select(*scope, "_lane", "_day", "_kind", *[F.sum(c).over(so_far).alias(c) for c in sums]).where("_kind = 0").drop("_kind")
    at = lambda day, name: summed.withColumnsRenamed({"_day": day, **{c: f"_{name}_{c}" for c in sums}})
    found = joined_by_scope(joined_by_scope(pairs, at("_low", "from"), scope, ["_lane", "_low"], "inner"), at(date, "to"), scope, ["_lane", date], "inner")
    gain = {c: F.col(f"_to_{c}") - F.col(f"_from_{c}") for c in sums}
    values = [(gain[c] if i % 3 == 0 else F.when(gain[sums[i - i % 3]] > 0, gain[c])).alias(f"base_{c}") for i, c in enumerate(sums)]
    some = F.greatest(*[gain[c] for c in sums[::3]], F.lit(0)) > 0
    return found.where(some).select(*scope, date, *settings, *values)


def z_score(value: Column, n: Column, s: Column, ss: Column) -> Column:
    """(value - mean) / std; with no spread, 0 for the mean itself and infinity for all else."""
    mean = s.cast("double") / n
    std = spread(n, s, ss)
    return F.when(std == 0, F.when(F.abs(value - mean) <= 1e-9 * F.greatest(F.abs(value), F.abs(mean)), 0.0)
                  .otherwise(float("inf"))).otherwise((value - mean) / std)


def z_verdict(n: Column, min_samples: Column, z: Column, limit: Column) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) < F.greatest(F.lit(1), min_samples), "COLD_START")
        .when(F.abs(z) > limit, "ANOMALY")
        .otherwise("NORMAL")
    )
