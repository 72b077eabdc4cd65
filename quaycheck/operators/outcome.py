"""Combining checks into outcomes: worst-of, fail-closed ladders, reasons, flat findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaycheck.functions import fixed_values as fx
from quaycheck.functions.common import details, lookup


def rank(outcome: Column, ranks: dict[str, int] = fx.GATE_RANK) -> Column:
    return lookup(ranks, outcome)


def by_rank(value: Column, ranks: dict[str, int] = fx.GATE_RANK) -> Column:
    return lookup({r: o for o, r in ranks.items()}, value)


def worst(outcomes: list[Column], ranks: dict[str, int] = fx.GATE_RANK) -> Column:
    """Worst of several outcome columns of one row."""
    return by_rank(F.greatest(*[rank(o, ranks) for o in outcomes], F.lit(0)), ranks)


def worst_of_group(outcome: Column, ranks: dict[str, int] = fx.GATE_RANK) -> Column:
    """Aggregate: worst outcome. A maximum of small integers, so it combines before the shuffle."""
    return by_rank(F.coalesce(F.max(rank(outcome, ranks)), F.lit(0)), ranks)


def stored_outcome(status: Column) -> Column:
    return F.coalesce(lookup(fx.STATUS_OUTCOME, status), F.lit("QUARANTINE_FILE"))


@dataclass
class Rung:
    """One check of a ladder.

    stop: a failure skips the rungs below. quiet: listed only when it fails. final: a failure ends
    the ladder with nothing listed after it.
    """

    rule: str
    passed: Column
    on_fail: str | Column
    message: Column
    stop: bool = True
    quiet: bool = False
    final: bool = False
    info: dict[str, Column] = field(default_factory=dict)


def with_ladder(df: DataFrame, name: str, rungs: list[Rung]) -> DataFrame:
    """Adds the evaluations of a ladder: rungs below a stopping failure are marked skipped.

    Narrow and compiled: each rung is computed once as a column of the file's own row, and which
    rungs lie below a failure is plain boolean logic over those columns.
    """
    held = {
        f"_{name}_{i}": F.struct(
            F.coalesce(r.passed, F.lit(False)).alias("passed"), (F.lit(r.on_fail) if isinstance(r.on_fail, str) else r.on_fail).alias("on_fail"),
            r.message.alias("message"), details(**r.info).alias("details"))
        for i, r in enumerate(rungs)
    }
    entries, below, ended = [], F.lit(False), F.lit(False)
    for r, column in zip(rungs, held):
        own = F.col(column)
        entry = F.struct(
            F.lit(r.rule).alias("rule_name"), (below | own["passed"]).alias("passed"), below.alias("skipped"),
            F.when(below, "Skipped after prior failure.").otherwise(own["message"]).alias("message"),
            F.when(~below, own["on_fail"]).alias("on_fail"),
            F.when(below, F.create_map().cast("map<string,string>")).otherwise(own["details"]).alias("details"))
        hidden = (ended | below | own["passed"]) if r.quiet else ended
        entries.append(F.when(~hidden, entry))
        if r.stop:
            halts = ~below & ~own["passed"]
            ended = (ended | halts) if r.final else ended
            below = below | ~own["passed"]
    return df.withColumns(held).withColumn(name, F.array_compact(F.array(*entries))).drop(*held)


def first_failure(evaluations: Column) -> Column:
    return F.get(F.filter(evaluations, lambda e: ~e["passed"]), 0)


def ladder_outcome(evaluations: Column) -> Column:
    """The first failure decides."""
    return F.coalesce(first_failure(evaluations)["on_fail"], F.lit("PASS"))


def ladder_from_rows(checks: DataFrame, key: str, order: str, passed: str) -> DataFrame:
    """Long form: the first failed check per file, by an aggregate over integers."""
    failed = F.when(~F.col(passed), F.col(order))
    return checks.groupBy(key).agg(
        F.min(failed).alias("failed_at"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col(passed)).alias("failures"))


def gate_reason(parts: list[tuple[str, Column, Column]], all_passed: str) -> Column:
    """'G1: ...; G3: ...' over the gates that did not pass."""
    texts = [F.when(o != "PASS", F.concat(F.lit(f"{g}: "), r)) for g, o, r in parts]
    joined = F.concat_ws("; ", *texts)
    return F.when(joined == "", all_passed).otherwise(joined)


def skip_gate_two(gate_one: Column) -> Column:
    return gate_one.isin("REJECT_FILE", "QUARANTINE_FILE")


def flat_findings(reports: DataFrame, keep: list[str], gates: list[tuple[str, str]]) -> DataFrame:
    """One row per evaluation of every gate: (gate, evaluations column) pairs, no shuffle."""
    def tag(gate: str, evaluations: str) -> Column:
        return F.transform(F.col(evaluations), lambda e, i: F.struct(
            F.lit(gate).alias("gate"), i.alias("ord"), e["rule_name"].alias("rule_name"), e["passed"].alias("passed"),
            e["skipped"].alias("skipped"), e["message"].alias("message"), e["details"].alias("details")))

    tagged = [tag(g, c) for g, c in gates]
    return reports.select(*keep, F.inline(F.flatten(F.array(*tagged))))
