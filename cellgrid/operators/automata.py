"""Cellular automata on the topology. The state is a table (dggid, state); a rule gives the next state from a cell's state and its neighbours' counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_and_seen

#: A rule: (state, function from a state's name to the number of neighbours in it) to the next state.
Rule = Callable[[Column, Callable[[str], Column]], Column]


def fire(state: Column, n: Callable[[str], Column]) -> Column:
    """Burning cells burn out; cells that are neither burning nor burned ignite beside a burning one."""
    return F.when(state == "burning", "burned").when((state != "burned") & (n("burning") > 0), "burning").otherwise(state)


def game_of_life(state: Column, n: Callable[[str], Column]) -> Column:
    """Alive with two or three living neighbours if alive, with three if dead."""
    return F.when((state == "alive") & n("alive").isin(2, 3), "alive").when((state != "alive") & (n("alive") == 3), "alive").otherwise("dead")


def epidemic(state: Column, n: Callable[[str], Column]) -> Column:
    """Susceptible cells are infected beside two infected ones; infected ones recover."""
    return F.when((state == "susceptible") & (n("infected") >= 2), "infected").when(state == "infected", "recovered").otherwise(state)


def opinion(state: Column, n: Callable[[str], Column]) -> Column:
    """The majority of the neighbours."""
    return F.when(n("yes") > n("no"), "yes").when(n("no") > n("yes"), "no").otherwise(state)


RULES: dict[str, tuple[Rule, tuple[str, ...]]] = {"fire": (fire, ("burning",)), "game_of_life": (game_of_life, ("alive",)), "epidemic": (epidemic, ("infected",)), "opinion": (opinion, ("yes", "no"))}


def ignite(state: DataFrame, topo: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The cells that the next step sets on fire: neighbours of burning cells that are neither burning nor burned."""
    lit = state.where("state = 'burning'").join(topo.select("dggid", "neighbor_dggid").distinct(), "dggid").select(F.col("neighbor_dggid").alias("dggid")).distinct()
    out = lit.join(state.where("state in ('burning', 'burned')").select("dggid"), "dggid", "left_anti")
    return out if mask is None else out.join(mask.select("dggid"), "dggid", "left_semi")


def step(state: DataFrame, topo: DataFrame, rule: str = "fire", mask: DataFrame | None = None) -> DataFrame:
    """The next state of every cell of `state`; with a mask, cells outside it keep theirs."""
    f, counted = RULES[rule]
    seen = state.select(F.col("dggid").alias("neighbor_dggid"), F.col("state").alias("s")).where(F.col("s").isin(*counted))
    n = topo.select("dggid", "neighbor_dggid").distinct().join(seen, "neighbor_dggid").groupBy("dggid").agg(*[F.count(F.when(F.col("s") == k, 1)).alias(f"n_{k}") for k in counted])
    x = state.join(n, "dggid", "left")
    after = f(F.col("state"), lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)))
    if mask is not None:
        x = x.join(mask.select("dggid").distinct().withColumn("inside", F.lit(True)), "dggid", "left")
        after = F.when(F.col("inside"), after).otherwise(F.col("state"))
    return x.select("dggid", after.alias("state"))


def share_to_stop(stop: str | None) -> float | None:
    """The share of cells that must keep their state in a step for a run to end: all by `no_changes`, x by `threshold:x`."""
    if stop is None:
        return None
    name, _, share = stop.partition(":")
    try:
        value = 1.0 if stop == "no_changes" else float(share) if name == "threshold" else -1.0
    except ValueError:
        value = -1.0
    if not 0 <= value <= 1:
        raise ValueError(f"unknown stop condition {stop}")
    return value


def run(state: DataFrame, topo: DataFrame, steps: int = 1, rule: str = "fire", mask: DataFrame | None = None, until_stable: bool = False, stop: str | None = None) -> DataFrame:
    """The state after 1 to 100 steps, or after the first one that meets `stop` (`until_stable` is `no_changes`); the plan is cut every few steps."""
    steps, share = min(max(steps, 1), 100), share_to_stop("no_changes" if until_stable and stop is None else stop)
    for k in range(1, steps + 1):
        after = step(state, topo, rule, mask)
        if share is not None:
            kept = F.col("state").eqNullSafe(F.col("before"))
            both = after.join(state.withColumnRenamed("state", "before"), "dggid")
            after, seen = cut_and_seen(both, F.count("*").alias("n"), F.count(F.when(kept, 1)).alias("kept"))
            after = after.drop("before")
            if seen["kept"] >= share * seen["n"]:
                return after
        elif k % 5 == 0 and k < steps:
            after = cut(after)
        state = after
    return state


def history(state: DataFrame, topo: DataFrame, steps: int = 1, every: int = 1, rule: str = "fire", mask: DataFrame | None = None) -> DataFrame:
    """The state at the start and after every so many of 1 to 100 steps, and at the end: (step, dggid, state)."""
    steps, every = min(max(steps, 1), 100), max(every, 1)
    state = cut(state.select("dggid", "state"))
    saved = [state.select(F.lit(0).alias("step"), "dggid", "state")]
    for k in range(0, steps, every):
        n = min(every, steps - k)
        state = cut(run(state, topo, n, rule, mask))
        saved.append(state.select(F.lit(k + n).alias("step"), "dggid", "state"))
    return reduce(DataFrame.unionByName, saved)


#: The rules of a fire model that none are given for.
DEFAULT_RULES = {
    "burn_once": True, "full_burn_timesteps": 1, "min_burn_per_step": 1,
    "spread_factors": {"wind_speed": 1.0, "wind_direction": 0.0, "slope": 0.0, "land_cover": 1.0, "temperature": 1.0},
}


def initialise(cells: DataFrame, attribute: str = "state", rules: dict | None = None, default: str = "unburned") -> tuple[DataFrame, dict]:
    """(state, rules) of a model: each cell's last text of the attribute, or the default where it has none; given rules replace the default ones by name."""
    last = F.max_by(F.when(F.col("attr_key") == attribute, F.col("value_text")), F.when((F.col("attr_key") == attribute) & F.col("value_text").isNotNull(), F.col("tid")))
    return cells.groupBy("dggid").agg(F.coalesce(last, F.lit(default)).alias("state")), DEFAULT_RULES | (rules or {})
