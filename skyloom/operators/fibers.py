"""Fibre assignment, its bookkeeping, and completeness weights.

The assignment itself is a substitute: where the external assigner weighs petals, stuck fibres and sky, this one is
greedy by priority. Targets ask for the fibres that reach them; each fibre takes its best target, each target its first
fibre, and the rest try again with what is left, for a few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.rng import u01
from skyloom.operators.footprint import near, points_in_tiles, tile_of_pass, unit
from skyloom.operators.scratch import once, settled

#: Bits of ZWARN for a fibre without data or of bad quality; science target bit.
ZWARN_BAD = (1 << 9) | (1 << 10) | (1 << 11)
SCIENCE = 1 << 0


def prepared_targets(df: DataFrame, row_id: str, seed: int = 44, numobs: int = 1, obsconditions: int = 1) -> DataFrame:
    """Add TARGETID, DESI_TARGET, SUBPRIORITY, OBSCONDITIONS, NUMOBS_MORE and NUMOBS."""
    i = F.col(row_id)
    return df.withColumns({
        "TARGETID": i.cast("long"), "DESI_TARGET": F.lit(SCIENCE).cast("long"), "SUBPRIORITY": u01(i, seed, "sub"),
        "OBSCONDITIONS": F.lit(obsconditions).cast("long"), "NUMOBS_MORE": F.lit(numobs).cast("long"), "NUMOBS": F.lit(0).cast("long"),
    })


def reachable(targets: DataFrame, fibers: DataFrame, radius: float, keep=()) -> DataFrame:
    """(TARGETID, TILEID, FIBER, *keep): fibres within their patrol radius. fibers: TILEID, FIBER, RA, DEC; keep: columns of
    targets. Targets with a TILEID look at the fibres of that tile only."""
    if "TILEID" not in targets.columns:
        f = fibers.select(F.struct("TILEID", "FIBER").alias("TILEID"), "RA", "DEC")
        hits = points_in_tiles(targets, f, radius, row_id="TARGETID").select("TARGETID", F.col("TILEID.TILEID").alias("TILEID"), F.col("TILEID.FIBER").alias("FIBER"))
        return hits.join(targets.select("TARGETID", *keep), "TARGETID") if keep else hits
    f = fibers.select("TILEID", "FIBER", F.col("RA").alias("tra"), F.col("DEC").alias("tdec"))
    f = settled(once(f.join(targets.select("TILEID").distinct(), "TILEID", "left_semi"), unit("tra", "tdec", "t")), "fibers")  # its size tells how to join it
    f = f.groupBy("TILEID").agg(F.collect_list(F.struct("FIBER", "tra", "tdec", "tx", "ty", "tz")).alias("__fibers"))
    rows = once(targets.select("TARGETID", "TILEID", "RA", "DEC", *keep).join(f, "TILEID"), unit("RA", "DEC", "__p"))
    pairs = rows.select("TARGETID", "TILEID", "RA", "DEC", *keep, "__px", "__py", "__pz", F.inline("__fibers"))
    return pairs.where(near(("RA", "DEC"), {c: F.col(c) for c in ("tra", "tdec", "tx", "ty", "tz")}, radius)).select("TARGETID", "TILEID", "FIBER", *keep)


def _ranked(targets: DataFrame) -> list:
    """Columns of targets that rank them: p (their priority, or 0) and SUBPRIORITY."""
    return [F.col("PRIORITY").alias("p") if "PRIORITY" in targets.columns else F.lit(0).alias("p"), F.col("SUBPRIORITY")]


def greedy(reach: DataFrame, targets: DataFrame, rounds: int = 3) -> DataFrame:
    """(TARGETID, TILEID, FIBER) of the assigned; all tiles at once. reach: TARGETID (integers), TILEID, FIBER, and p and
    SUBPRIORITY of the target where they are known already."""
    open_ = reach if {"p", "SUBPRIORITY"} <= set(reach.columns) else reach.join(targets.select("TARGETID", *_ranked(targets)), "TARGETID")
    order = F.struct("p", "SUBPRIORITY", F.bitwise_not("TARGETID").alias("id"))  # the greatest is the best, of equals the smallest TARGETID
    taken = None
    for k in range(rounds):
        best = open_.groupBy("TILEID", "FIBER").agg(F.max(order).alias("best"))
        got = best.groupBy(F.bitwise_not(F.col("best.id")).alias("TARGETID"), "TILEID").agg(F.min("FIBER").alias("FIBER"))
        taken = got if taken is None else taken.union(got)
        if k + 1 < rounds:
            taken = settled(taken, "assigned")
            open_ = open_.join(taken.select("TILEID", "FIBER"), ["TILEID", "FIBER"], "left_anti").join(taken.select("TILEID", "TARGETID"), ["TILEID", "TARGETID"], "left_anti")
    return taken


def available(reach: DataFrame, assigned: DataFrame) -> DataFrame:
    """(TARGETID, TILEID, FIBER): targets within reach of a fibre that got a science target; the first such fibre."""
    used = assigned.select("TILEID", "FIBER").distinct()
    return reach.join(used, ["TILEID", "FIBER"], "left_semi").groupBy("TARGETID", "TILEID").agg(F.min("FIBER").alias("FIBER"))


def good_fibers(rows: DataFrame, zwarn: DataFrame | None) -> DataFrame:
    """Rows whose fibre has a warning entry without a bad bit; a tile or fibre that is missing there is bad."""
    if zwarn is None:
        return rows
    ok = zwarn.where(F.col("ZWARN").bitwiseAND(F.lit(ZWARN_BAD)) == 0).select("TILEID", "FIBER")
    return rows.join(ok, ["TILEID", "FIBER"], "left_semi")


def mtl_update(targets: DataFrame, assigned: DataFrame, reach_available: DataFrame, zwarn: DataFrame | None = None) -> DataFrame:
    """targets with AVAILABLE, FIBER, OBSERVED and the counts of observations moved by one for the observed."""
    a = good_fibers(assigned, zwarn).select("TARGETID", F.col("FIBER").alias("__a"))
    b = good_fibers(reach_available, zwarn).select("TARGETID", F.col("FIBER").alias("__b"))
    seen = F.col("__a").isNotNull()
    return (
        targets.join(a, "TARGETID", "left").join(b, "TARGETID", "left")
        .withColumns({
            "AVAILABLE": seen | F.col("__b").isNotNull(), "FIBER": F.coalesce("__a", "__b", F.lit(-1)), "OBSERVED": seen,
            "NUMOBS": F.col("NUMOBS") + seen.cast("long"), "NUMOBS_MORE": F.col("NUMOBS_MORE") - seen.cast("long"),
        })
        .drop("__a", "__b")
    )


def assign_passes(targets: DataFrame, tiles: DataFrame, fibers: DataFrame, npasses: int, tile_radius: float, patrol: float, zwarn: DataFrame | None = None, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(targets after all passes, history). history: TARGETID, PASS, TILEID, FIBER, OBSERVED of targets within a tile.

    A pass depends on the one before it through NUMOBS_MORE, so each is written before the next.
    """
    state, history = targets, None
    for k in range(npasses):
        here = state.where("NUMOBS_MORE >= 1").select("TARGETID", "RA", "DEC", *_ranked(state), "NUMOBS", "NUMOBS_MORE")
        asked = settled(tile_of_pass(here, tiles, k, row_id="TARGETID", radius=tile_radius).where("TILEID >= 0"), "asked")
        reach = settled(reachable(asked, fibers, patrol, ("p", "SUBPRIORITY")), "reach")
        got = settled(greedy(reach, asked, rounds), "got")
        done = settled(mtl_update(asked, got, available(reach, got), zwarn).select("TARGETID", F.lit(k).alias("PASS"), "TILEID", "FIBER", "OBSERVED"), "pass")
        history = done if history is None else history.union(done)
        n = done.where("OBSERVED").select("TARGETID", F.lit(1).cast("long").alias("__o"))
        state = settled(state.join(n, "TARGETID", "left").withColumns({"NUMOBS": F.col("NUMOBS") + F.coalesce("__o", F.lit(0)), "NUMOBS_MORE": F.col("NUMOBS_MORE") - F.coalesce("__o", F.lit(0))}).drop("__o"), "targets")
    return state, history


def pass_arrays(targets: DataFrame, history: DataFrame, npasses: int) -> DataFrame:
    """targets with AVAILABLE, FIBER[pass] (-1 without) and OBS_PASS[pass]."""
    fiber = [F.max(F.when((F.col("PASS") == k), F.col("FIBER"))).alias(f"f{k}") for k in range(npasses)]
    seen = [F.max(F.when((F.col("PASS") == k), F.col("OBSERVED"))).alias(f"o{k}") for k in range(npasses)]
    w = history.where("FIBER <> -1 OR OBSERVED").groupBy("TARGETID").agg(*fiber, *seen)  # the others have the defaults
    out = targets.join(w, "TARGETID", "left")
    arrays = {"FIBER": F.array(*[F.coalesce(f"f{k}", F.lit(-1)) for k in range(npasses)]), "OBS_PASS": F.array(*[F.coalesce(f"o{k}", F.lit(False)) for k in range(npasses)])}
    out = out.withColumns(arrays).withColumn("AVAILABLE", F.exists("FIBER", lambda x: x >= 0))
    return out.drop(*[f"{a}{k}" for a in "fo" for k in range(npasses)])


def completeness_one_pass(history: DataFrame, pass_id: int, unused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass: (TARGETID, extra) of its observed targets, and what is left of `unused`.

    unused: TARGETID of targets that no pass observed and that stand for nobody yet; those with a fibre in this pass count
    for the target observed on it, and are used up.
    """
    h = history.where(F.col("PASS") == pass_id)
    waiting = h.where(F.col("FIBER") != -1).join(unused, "TARGETID", "left_semi")
    extra = waiting.groupBy("TILEID", "FIBER").agg(F.count("*").alias("extra"))
    return h.where("OBSERVED").join(extra, ["TILEID", "FIBER"]).select("TARGETID", "extra"), unused.join(waiting, "TARGETID", "left_anti")


def never_observed(history: DataFrame) -> DataFrame:
    """TARGETID of targets that had a fibre in some pass and were observed in none."""
    return history.groupBy("TARGETID").agg(F.bool_or("OBSERVED").alias("seen"), F.max("FIBER").alias("f")).where("NOT seen AND f <> -1").select("TARGETID")


def completeness_by_pass(targets: DataFrame, history: DataFrame, npasses: int) -> tuple[DataFrame, DataFrame]:
    """(targets with COMP_WEIGHT, remaining): pass after pass, with the count of unused targets left after each.

    completeness_weights gives the same weights in closed form; this is for following the passes one by one.
    """
    unused, out, left = settled(never_observed(history), "unused"), None, []
    for k in range(npasses):
        extra, rest = completeness_one_pass(history, k, unused)
        extra = settled(extra, "extra")
        out = extra if out is None else out.union(extra)
        unused = settled(rest, "unused")
        left.append(unused.select(F.lit(k).alias("PASS"), F.lit(1).alias("one")).groupBy("PASS").agg(F.count("*").alias("remaining")))
    seen = history.where("OBSERVED").select("TARGETID").distinct()
    weight = seen.join(out.groupBy("TARGETID").agg(F.sum("extra").alias("e")), "TARGETID", "left").select("TARGETID", (F.lit(1.0) + F.coalesce("e", F.lit(0))).alias("COMP_WEIGHT"))
    remaining = left[0]
    for r in left[1:]:
        remaining = remaining.union(r)
    return targets.join(weight, "TARGETID", "left").withColumn("COMP_WEIGHT", F.coalesce("COMP_WEIGHT", F.lit(float("nan")))), remaining


def completeness_weights(targets: DataFrame, history: DataFrame) -> DataFrame:
    """targets with COMP_WEIGHT: 1 + the unobserved targets an observed one stands for, NaN where never observed.

    In closed form: a target that no pass observed counts once, at its first pass with a fibre, for the target observed
    on that fibre and tile then. One aggregation and two joins, whatever the number of passes.
    """
    history = history.where("FIBER <> -1 OR OBSERVED")  # a row without either says nothing
    seen = history.groupBy("TARGETID").agg(F.bool_or("OBSERVED").alias("seen"), F.min(F.when(F.col("FIBER") != -1, F.struct("PASS", "TILEID", "FIBER"))).alias("first"))
    extra = seen.where("NOT seen AND first IS NOT NULL").groupBy("first.PASS", "first.TILEID", "first.FIBER").agg(F.count("*").alias("extra"))
    stands = history.where("OBSERVED").join(extra, ["PASS", "TILEID", "FIBER"], "left").groupBy("TARGETID").agg((F.lit(1.0) + F.coalesce(F.sum("extra"), F.lit(0))).alias("COMP_WEIGHT"))
    return targets.join(stands, "TARGETID", "left").withColumn("COMP_WEIGHT", F.coalesce("COMP_WEIGHT", F.lit(float("nan"))))
