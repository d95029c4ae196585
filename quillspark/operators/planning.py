"""Greedy plans under a budget: what further evidence to gather for each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.operators.grouped import map_groups

SCHEMA = "group_id long, action_id string, selected boolean, used_ms long, step int"


def greedy(actions: DataFrame, *, budget_ms: int = 12_000, most: int = 8, per_island: int = 2, minimum_utility: float = 4e-5) -> DataFrame:
    """(group_id, action_id, selected, used_ms, step): actions by utility, criticality, gain, cost, id, while they fit.

    An action is passed over if its island has ``per_island``, its utility is below the minimum, ``most`` are taken or
    the budget would be exceeded; later, cheaper ones may still fit. A fold over each group's ordered actions.
    """
    item = "struct<action_id:string,island:string,selected:boolean,used_ms:bigint>"
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("utility")).alias("u"), (-F.col("criticality")).alias("c"), (-F.col("gain")).alias("g"), F.col("cost_ms").cast("long").alias("cost_ms"), "action_id", F.col("island").cast("string").alias("island"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("taken"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        there = F.size(F.filter(s["out"], lambda o: o["selected"] & (o["island"] == x["island"])))
        fits = (there < per_island) & (-x["u"] >= minimum_utility) & (s["taken"] < most) & (s["used"] + x["cost_ms"] <= budget_ms)
        used = s["used"] + F.when(fits, x["cost_ms"]).otherwise(F.lit(0))
        return F.struct(used.alias("used"), (s["taken"] + fits.cast("int")).alias("taken"), F.concat(s["out"], F.array(F.struct(x["action_id"].alias("action_id"), x["island"].alias("island"), fits.alias("selected"), used.alias("used_ms")))).alias("out"))

    out = actions.groupBy("group_id").agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    return out.select("group_id", F.posexplode("out").alias("step", "x")).select("group_id", "x.action_id", "x.selected", "x.used_ms", "step")


# Weights of the router's bonuses and penalty, actions an island may get, least score.
ROUTER = {"load": 0.18, "reward": 0.12, "priority": 0.30, "duplicate": 0.45, "per_island": 2, "minimum": 0.0}


def update_router(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(kind, selections, reward_sum) after more (kind, reward) outcomes; rewards that are null or not finite don't count.

    Sums don't depend on the order of rows: scores that are equal but for their last bit would change places between runs.
    Rewards are integers of a unit for each 8 binary orders of magnitude, integers add up exactly, at most 264 units are left.
    """
    fine = F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") < float("inf"))
    new = outcomes.where(fine).select("kind", F.lit(1).cast("long").alias("selections"), F.col("reward").cast("double").alias("reward_sum"))
    rows, x = state.select("kind", F.col("selections").cast("long"), F.col("reward_sum").cast("double")).union(new), F.col("reward_sum")
    finite = F.abs(x) < float("inf")
    power = F.when(finite, F.greatest(F.floor(F.log2(F.abs(x)) / 8), F.lit(-136)) * 8 - 53).otherwise(F.lit(0))
    scaled = lambda v, n: v * F.pow(F.lit(2.0), F.floor(n / 2)) * F.pow(F.lit(2.0), n - F.floor(n / 2))  # noqa: E731  # in two steps, each within a double's range
    part = F.when(finite, scaled(x, -F.col("power")).cast("long").cast("decimal(20,0)"))
    units = rows.withColumn("power", power).groupBy("kind", "power").agg(F.sum("selections").alias("selections"), F.sum(part).alias("part"), F.sum(F.when(~finite, x)).alias("other"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("power", "part", "other"))), F.lit(0.0), lambda s, u: s + F.coalesce(scaled(u["part"].cast("double"), u["power"]), F.lit(0.0)) + F.coalesce(u["other"], F.lit(0.0)))
    return units.groupBy("kind").agg(F.sum("selections").alias("selections"), total.alias("reward_sum"))


def route_scores(actions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Adds load, reward and priority bonuses and ``base``, their sum with the utility: the score without duplicates.

    load: how far the kind's share of past selections lies below an equal share of the group's kinds, held to that
    share on both sides; reward: the kind's mean reward; priority: criticality. ``state`` has a row a kind.
    """
    kinds = F.size(F.collect_set("kind").over(S.whole("group_id")))
    rows = actions.withColumn("target", 1.0 / kinds)
    if state is None:
        rows = rows.withColumns({"selections": F.lit(0).cast("long"), "reward_sum": F.lit(0.0), "all": F.lit(0).cast("long")})
    else:
        total = state.agg(F.coalesce(F.sum("selections"), F.lit(0)).cast("long").alias("all"))  # one row
        rows = rows.join(state.select("kind", "selections", "reward_sum"), "kind", "left").fillna({"selections": 0, "reward_sum": 0.0}).crossJoin(F.broadcast(total))
    seen = F.when(F.col("all") > 0, F.col("selections") / F.col("all")).otherwise(F.col("target"))
    below = F.greatest(-F.col("target"), F.least(F.col("target"), F.col("target") - seen))
    reward = F.when(F.col("selections") > 0, F.col("reward_sum") / F.col("selections")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"load": ROUTER["load"] * below, "reward": ROUTER["reward"] * reward, "priority": ROUTER["priority"] * F.col("criticality")})
    return rows.withColumn("base", F.col("utility") + F.col("load") + F.col("reward") + F.col("priority")).drop("target", "selections", "reward_sum", "all")


def routed(actions: DataFrame, state: DataFrame | None = None, *, budget_ms: int = 12_000, most: int = 8) -> DataFrame:
    """(group_id, action_id, selected, used_ms, step, score): the best action by score, criticality, cost and id is tried, then
    the rest is scored anew, since each action that an island got takes ROUTER["duplicate"] from its others.

    Tried actions that score too low, crowd their island or break the budget are passed over. What is left when ``most``
    are selected follows by score. An id that repeats in a group is tried once, by its best row. ``actions``: (group_id, action_id, kind, island, utility, criticality, cost_ms).
    """

    def run(key, rows: list[dict]):
        left, used, taken, islands, step = rows, 0, 0, {}, 0
        score = lambda a: a["base"] - ROUTER["duplicate"] * islands.get(a["island"], 0)
        order = lambda a: (-score(a), -a["criticality"], a["cost_ms"], a["action_id"])
        while left and taken < most:
            a = min(left, key=order)
            left = [x for x in left if x["action_id"] != a["action_id"]]
            s = score(a)
            fits = s >= ROUTER["minimum"] and islands.get(a["island"], 0) < ROUTER["per_island"] and used + a["cost_ms"] <= budget_ms
            if fits:
                used, taken = used + a["cost_ms"], taken + 1
                islands[a["island"]] = islands.get(a["island"], 0) + 1
            yield key, a["action_id"], fits, used, step, s
            step += 1
        rest = {}
        for a in sorted(left, key=order):
            rest.setdefault(a["action_id"], a)
        for a in rest.values():
            yield key, a["action_id"], False, used, step, score(a)
            step += 1

    rows = route_scores(actions, state).withColumn("cost_ms", F.col("cost_ms").cast("long"))
    return map_groups(rows, "group_id", ["action_id", "island", "criticality", "cost_ms", "base"], run, f"{SCHEMA}, score double")


def with_dependencies(actions: DataFrame, *, budget_ms: int, most: int, minimum_gain: float = 0.0) -> DataFrame:
    """Greedy by gain per cost over actions with ``needs`` (ids that must be taken before) and ``exclusive`` (at most one
    of a name); passes repeat until nothing more can be taken."""

    def run(key, rows: list[dict]):
        rows = sorted(rows, key=lambda a: (-a["gain"] / max(1, a["cost_ms"]), a["cost_ms"], a["action_id"]))
        done, names, used, out, moved = set(), set(), 0, {}, True
        while moved:
            moved = False
            for a in rows:
                i, name = a["action_id"], a["exclusive"]
                if i not in done and len(done) < most and a["gain"] >= minimum_gain and set(a["needs"] or ()) <= done and (not name or name not in names) and used + a["cost_ms"] <= budget_ms:
                    done.add(i)
                    names.add(name)
                    used += a["cost_ms"]
                    out[i] = (used, len(done) - 1)
                    moved = True
        for a in rows:
            yield key, a["action_id"], a["action_id"] in done, *out.get(a["action_id"], (used, len(done)))

    return map_groups(actions, "group_id", ["action_id", "gain", "cost_ms", "needs", "exclusive"], run, SCHEMA)
