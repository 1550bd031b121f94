"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted, with their tokens, in cells of (source, language, topic). Token weights are
raked until each of the three margins meets its target; a cell's factor is fitted over present
weight. Its documents' sampling probability comes from raking again with no cell above 1, and a document
stays if a hash of its doc_id falls below it, so that the same row is decided alike in every run and on
every machine.

Targets: shares by value, or by default each margin's present shares flattened by `power` (1: as they are,
0: uniform). The expected tokens are `keep` of all. Sampling repeats no document, so that at a given keep a
value can't have more than share / keep: one whose target is above that is kept whole and falls short, and
what it lacks goes to the others in proportion. `margins` reports the expected share of each value beside its
target; with keep at most 1 / (largest factor) no cell is bounded and all targets are met.

The topic is a column of the documents, or any expression over them; `surface_topic` is only the default,
a coarse rule by patterns.

Defined results: a null source, language or topic is a value of its own (""); null and empty texts have no
tokens and the factor of their cell (1 before the rate, if the cell has no tokens); rows repeated
with one doc_id are decided alike; a null doc_id counts as 0; an empty table gives no rows; other
columns pass through in `doc`, whatever their names. Cells are counted in a distributed way; up to MAX_CELLS
rows of counts are raked on the driver, more by the same steps over DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, text_or_empty, whole
from .toxicity import below

#: Cells raked on the driver and broadcast; beyond it nothing is collected.
MAX_CELLS = 200_000
MARGINS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Words: runs of characters other than 0x20 and 0x09-0x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def surface_topic(text: Column) -> Column:
    """A coarse topic by surface: legal lines, contacts, shouting or symbols, lists, prose."""
    return (F.when(text.rlike(r"(?i)\blicen[sc]e|copyright|all rights reserved"), "legal")
            .when(text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"), "contact")
            .when(text.rlike(r"[!?#$%&*]{3,}"), "noise")
            .when(text.rlike(r"\n.*\n.*\n.*\n"), "lined")
            .otherwise("prose"))


@dataclass(frozen=True)
class Mix:
    """keep: expected share of tokens kept; power: flattens margins without explicit targets."""

    keep: float = 0.8
    power: float = 0.7
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 100
    tolerance: float = 1e-9


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> np.ndarray:
    """Cell weights whose margins meet the targets: each margin in turn is scaled to its target."""
    weight = mass / mass.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, weight, len(target))
            worst = max(worst, np.abs(now - target).max())
            weight = weight * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[code]
        if worst < tolerance:
            break
    return weight


def margin_target(mass: np.ndarray, names: list[str], own: dict[str, float] | None, power: float) -> np.ndarray:
    """Shares of a margin's values; values that no document has can't be met and are left out."""
    share = np.array([own.get(n, 0.0) for n in names]) if own else (mass / mass.sum()) ** power * (mass > 0)
    if share.sum() <= 0:
        raise ValueError("the targets name no value that has tokens")
    return share / share.sum()


def within(target: np.ndarray, most: np.ndarray) -> np.ndarray:
    """target where no value can have more than most: what is over goes to the others in proportion."""
    out, full = np.minimum(target, most), target > most
    while full.any() and not full.all():
        rest = 1 - most[full].sum()
        out[full], out[~full] = most[full], target[~full] * max(0.0, rest) / max(target[~full].sum(), 1e-300)
        over = ~full & (out > most)
        if not over.any():
            break
        full |= over
    return out


def scale_to(weight: np.ndarray, cap: np.ndarray, goal: float) -> float:
    """The s at which min(cap, s * weight) sums to goal, or at which all are at their caps."""
    if goal <= 0 or not (weight > 0).any():
        return 0.0
    own = weight > 0
    weight, cap = weight[own], cap[own]
    turn = cap / weight
    order = np.argsort(turn)
    capped = np.concatenate([[0.0], np.cumsum(cap[order])])
    free = np.concatenate([np.cumsum(weight[order][::-1])[::-1], [0.0]])
    reach = capped[:-1] + turn[order] * free[:-1]  # the sum at each turn
    k = int(np.searchsorted(reach, goal))
    return float(turn[order[-1]]) if k == len(order) else (goal - capped[k]) / free[k]


def rates(weight: np.ndarray, mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], how: Mix) -> np.ndarray:
    """Sampling probabilities, at most 1, that keep how.keep of the mass in expectation with the
    margins at their targets: raked again under that bound, cells at 1 being fixed and the others
    refitted. A value whose whole mass is below its target at this keep is kept whole."""
    share = mass / mass.sum()
    keep = min(how.keep, share[weight > 0].sum())
    cap, own = np.where(weight > 0, share / keep, 0.0), weight.copy()
    goals = [within(t, np.bincount(c, cap, len(t))) for c, t in zip(codes, targets)]
    groups = [[np.flatnonzero(c == v) for v in range(len(t))] for c, t in zip(codes, targets)]
    for _ in range(how.rounds):
        worst = 0.0
        for goal, group in zip(goals, groups):
            for v, cells in enumerate(group):
                worst = max(worst, abs(np.minimum(cap[cells], own[cells]).sum() - goal[v]))
                own[cells] *= scale_to(own[cells], cap[cells], goal[v])
        if worst < how.tolerance:
            break
    # keep holds exactly, also where the margins' goals contradict each other under the bound
    out = np.minimum(cap, own * scale_to(own, cap, 1.0))
    return np.minimum(1, np.divide(out, cap, out=np.ones(len(mass)) * (mass <= 0), where=cap > 0))


def flattened(cells: DataFrame, margin: str, how: Mix) -> DataFrame:
    """(margin, target): as margin_target, over a DataFrame."""
    shares = cells.groupBy(margin).agg(F.sum("mass").cast("double").alias("mass"))
    if own := how.targets.get(margin):
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in own.items()], f"{margin} string, target double")
        shares = shares.join(named, margin, "left").select(margin, F.coalesce("target", F.lit(0.0)).alias("target"))
    else:
        total = shares.agg(F.sum("mass")).first()[0]
        shares = shares.select(margin, F.when(F.col("mass") > 0, F.pow(F.col("mass") / total, how.power)).otherwise(0.0).alias("target"))
    whole = shares.agg(F.sum("target")).first()[0]
    if whole <= 0:
        raise ValueError("the targets name no value that has tokens")
    return shares.withColumn("target", F.col("target") / whole)


def within_frame(shares: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(value, goal) of shares (value, target, most): as `within`, over a DataFrame."""
    now, k = scratch.save(shares.withColumns({"goal": F.least("target", "most"), "full": F.col("target") > F.col("most")}), f"{name}_0"), 0
    while True:
        full, free, n_full, n = now.agg(
            F.sum(F.when(F.col("full"), F.col("most"))), F.sum(F.when(~F.col("full"), F.col("target"))), F.count_if("full"), F.count(F.lit(1))).first()
        if not n_full or n_full == n:
            return now
        goal = F.when(F.col("full"), F.col("most")).otherwise(F.col("target") * max(0.0, 1 - full) / max(free, 1e-300))
        k, now = k + 1, scratch.save(now.withColumn("goal", goal).withColumn("full", F.col("full") | (F.col("goal") > F.col("most"))), f"{name}_{k + 1}")
        if now.filter("full").count() == n_full:
            return now


def rake_frame(cells: DataFrame, how: Mix, scratch: Scratch) -> DataFrame:
    """cells (margins, mass) with factor and probability: the driver's steps over DataFrames. A value's
    scale under the bound takes a step in each round; rounds are written."""
    total = float(cells.agg(F.sum("mass")).first()[0] or 0)
    if total <= 0:
        return cells.withColumns({"factor": F.lit(1.0), "probability": F.lit(1.0)})
    targets = {m: scratch.save(flattened(cells, m, how), f"target_{m}") for m in MARGINS}

    def rounds(now: DataFrame, goals: dict[str, DataFrame], goal: str, free: Column, name: str) -> DataFrame:
        """free: whether a cell isn't at its cap. The scale is exact where it changes no cell from the one to the other."""
        now, k = scratch.save(now, f"{name}_0"), 0
        part = [F.sum(F.when(free, F.col("own")).otherwise(0.0)).alias("free"), F.sum(F.when(free, 0.0).otherwise(F.col("cap"))).alias("full")]
        left = F.col("aim") - F.col("full")
        scale = F.when((F.col("free") > 0) & (left > 0), left / F.col("free")).when(F.col("free") + F.col("full") > 0, F.least(F.lit(1.0), F.col("aim") / (F.col("free") + F.col("full")))).otherwise(0.0)
        while k < how.rounds:
            misses = []
            for m in MARGINS:
                sums = now.groupBy(m).agg(*part).join(goals[m].select(m, F.col(goal).alias("aim")), m)
                sums = scratch.save(sums.select(m, scale.alias("scale"), F.abs(left - F.col("free")).alias("miss")), f"{name}_{k}_{m}")
                misses.append(sums.agg(F.max("miss")).first()[0])
                now = now.join(sums.drop("miss"), m).withColumn("own", F.col("own") * F.col("scale")).drop("scale")
            k, now = k + 1, scratch.save(now, f"{name}_{k + 1}")
            scratch.drop(f"{name}_{k - 1}")
            if max(misses) < how.tolerance:
                break
        return now

    share = F.col("mass") / total
    raked = rounds(cells.withColumns({"own": share, "cap": F.lit(0.0)}), targets, "target", F.lit(True), "raked")
    raked = raked.withColumn("factor", F.when(F.col("mass") > 0, F.col("own") / share).otherwise(1.0))
    keep = min(how.keep, raked.agg(F.sum(F.when(F.col("own") > 0, share))).first()[0])
    bounded = scratch.save(raked.withColumn("cap", F.when(F.col("own") > 0, share / keep).otherwise(0.0)), "bounded")
    goals = {m: within_frame(bounded.groupBy(m).agg(F.sum("cap").alias("most")).join(targets[m], m), scratch, f"goal_{m}") for m in MARGINS}
    now = rounds(bounded, goals, "goal", F.col("own") < F.col("cap"), "rates")
    scale = 1.0
    for _ in range(how.rounds):  # keep holds exactly
        got = now.agg(F.sum(F.least(F.col("cap"), F.col("own") * scale))).first()[0]
        if abs(got - 1) < how.tolerance or got <= 0:
            break
        scale /= got
    rate = F.when(F.col("cap") > 0, F.least(F.lit(1.0), F.least(F.col("cap"), F.col("own") * scale) / F.col("cap")))
    return now.select(*MARGINS, "mass", "factor", rate.otherwise(F.when(F.col("mass") > 0, 0.0).otherwise(1.0)).alias("probability"))


def cells_of(docs: DataFrame, topic: Column | str | None = None) -> DataFrame:
    """doc (all columns of docs), doc_id, source, lang, topic and tokens."""
    text = text_or_empty()
    named = F.col(topic) if isinstance(topic, str) else surface_topic(text) if topic is None else topic
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(whole(docs), F.col("doc_id").cast("bigint").alias("doc_id"), value(F.col("source")).alias("source"),
                       value(F.col("lang")).alias("lang"), value(named).alias("topic"), tokens(text).alias("tokens"))


def mix(spark: SparkSession, docs: DataFrame, how: Mix = Mix(), topic: Column | str | None = None) -> DataFrame:
    """doc, a struct of all columns of docs, with source, lang, topic, tokens, factor, probability and
    sampled. topic: a column of docs or an expression over them."""
    return assign(spark, Scratch(spark, "mixing").save(cells_of(docs, topic), "cells"), how)


def assign(spark: SparkSession, rows: DataFrame, how: Mix = Mix()) -> DataFrame:
    """Adds factor, probability and sampled to rows of cells_of; reads them twice."""
    counted = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("mass"))
    cells = counted.limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        scratch = Scratch(spark, "raking")
        table = rake_frame(scratch.save(counted, "cells"), how, scratch).drop("mass")
    else:
        table = F.broadcast(raked_cells(spark, cells, how))  # at most MAX_CELLS rows
    drawn = below(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(4)), F.col("probability"))
    return rows.join(table, list(MARGINS)).withColumn("sampled", drawn)


def raked_cells(spark: SparkSession, cells: list, how: Mix) -> DataFrame:
    """Margins, factor and probability of each cell, fitted on the driver."""
    cells.sort(key=lambda r: tuple(r[k] for k in MARGINS))
    mass = np.array([r["mass"] for r in cells], float)
    factor = rate = np.ones(len(cells))
    if mass.sum() > 0:
        codes, targets = [], []
        for margin in MARGINS:
            names, code = np.unique([r[margin] for r in cells], return_inverse=True)
            codes.append(code)
            targets.append(margin_target(np.bincount(code, mass, len(names)), list(names), how.targets.get(margin), how.power))
        weight = rake(mass, codes, targets, how.rounds, how.tolerance)
        factor = np.divide(weight * mass.sum(), mass, out=np.ones(len(cells)), where=mass > 0)
        rate = rates(weight, mass, codes, targets, how)
    return spark.createDataFrame(
        [(*[r[k] for k in MARGINS], float(f), float(p)) for r, f, p in zip(cells, factor, rate)] or [("", "", "", 1.0, 1.0)],
        ", ".join(f"{k} string" for k in MARGINS) + ", factor double, probability double")


def margins(mixed: DataFrame, how: Mix = Mix()) -> DataFrame:
    """For rows of mix or assign: margin, value, and its share of tokens present, targeted and expected
    in the sample."""
    cells = mixed.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("mass"), F.sum(F.col("tokens") * F.col("probability")).alias("kept"))
    total, kept = cells.agg(F.sum("mass"), F.sum("kept")).first()
    out = None
    for m in MARGINS if total else ():
        own = cells.groupBy(m).agg((F.sum("mass") / total).alias("present"), (F.sum("kept") / max(kept, 1e-300)).alias("expected")).join(flattened(cells, m, how), m)
        own = own.select(F.lit(m).alias("margin"), F.col(m).alias("value"), "present", "target", "expected")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else mixed.sparkSession.createDataFrame([], "margin string, value string, present double, target double, expected double")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # the texts are read once; what is kept of them are counts and cells
    rows = Scratch(spark, "mixing").save(cells_of(docs).drop("doc"), "cells")
    return assign(spark, rows).select("doc_id", "topic", "tokens", "factor", "probability", "sampled")
