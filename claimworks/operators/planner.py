"""Choosing the cheapest set of verification checks that gathers enough evidence.

A claim's problem is its vector of eleven gains (hundredths, whole numbers); claims share
problems, so everything here runs over distinct problems and is joined back. A state is a bitmask
of done checks, 2,048 of them. Optimal cost, breadth-first and hill-climbing results have closed
forms. Searches whose expansions depend on the order of a queue aren't simulated.

The share of the total that is needed (tau) and the costs of checks can be overridden; costs may be
fractions then. Needs are whole numbers: SCALE to a hundredth of a gain, for tau in thousandths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimworks.functions import lexicon as L
from claimworks.sources import shared

N = len(L.CHECKS)
STATES = 1 << N
SCALE = 1000

Costs = dict[str, float] | None

_LOCAL = {"sensational": "s_sensational", "emotion": "s_emotion", "urgency": "s_urgency", "specificity": "s_specificity", "style": "s_style", "clickbait": "s_clickbait"}
_TRAITS = [*_LOCAL.values(), "checked", "specific", "risky", "english"]


def traits(scored: DataFrame) -> DataFrame:
    """scored with what a problem depends on: the six scores and four flags."""
    return scored.withColumns({
        "checked": F.arrays_overlap("topics", F.array(*map(F.lit, L.FACTCHECKED))), "specific": (F.size("dates") > 0) | (F.size("bodies") > 0),
        "risky": F.col("language_risk") == "high", "english": F.col("language") == "english",
    })


def gains() -> Column:
    """The eleven gains in hundredths, from the traits."""
    out = [F.abs(F.col(_LOCAL[c]) - 50) * 2 if c in _LOCAL else F.lit(0) for c in L.CHECKS[:8]]
    out.append(150 + F.when(F.col("checked"), 100).otherwise(0) + F.when(F.col("risky"), 50).otherwise(0))
    out.append((100 + F.when(F.col("specific"), 100).otherwise(0)) * F.when(F.col("english"), 100).otherwise(50) / 100)
    out.append(F.lit(60))
    return F.array(*[x.cast("int") for x in out])


def prices(costs: Costs = None) -> list[float]:
    """The checks' costs, with overrides."""
    return [(costs or {}).get(c, p) for c, p in zip(L.CHECKS, L.COSTS, strict=True)]


def _prices(costs: Costs) -> Column:
    """The same as a column: whole numbers if all are, else decimals of two places."""
    own = prices(costs)
    whole = all(float(p).is_integer() for p in own)
    return F.array(*[F.lit(int(p)) if whole else F.lit(str(p)).cast("decimal(12,2)") for p in own])


def needs(rows: DataFrame, tau: float = L.TAU) -> DataFrame:
    """rows(gains) with total and need (the threshold, SCALE to a hundredth of a gain)."""
    total = F.aggregate("gains", F.lit(0), lambda a, x: a + x)
    return rows.withColumn("total", total).withColumn("need", total * round(tau * SCALE))


def problems(scored: DataFrame, tau: float = L.TAU) -> DataFrame:
    """claim_id, gains, total and need (the threshold, SCALE to a hundredth of a gain)."""
    return needs(traits(scored).select("claim_id", gains().alias("gains")), tau)


def distinct_problems(scored: DataFrame, tau: float = L.TAU) -> DataFrame:
    """gains, total, need, claims: one row per distinct problem. Claims are counted by their traits,
    so the gains are derived from few rows."""
    counted = traits(scored).groupBy(*_TRAITS).agg(F.count("*").alias("claims"))
    return needs(counted.select(gains().alias("gains"), "claims").groupBy("gains").agg(F.sum("claims").alias("claims")), tau)


def over_bits(mask: Column, values: Column, kind: str = "int") -> Column:
    """Sum of the values at the mask's set bits, as that type."""
    return F.aggregate(F.transform(values, lambda v, i: v * F.getbit(mask, i)), F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def _cost_of(mask: Column, costs: Costs) -> Column:
    whole = all(float(p).is_integer() for p in prices(costs))
    return over_bits(mask, _prices(costs), "int" if whole else "decimal(12,2)")


def states(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """Every problem with each of its 2,048 states: mask, size, cost, evidence, goal. costs replaces
    the costs of some checks."""
    rows = distinct.select("gains", "total", "need", F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("mask"))
    rows = rows.withColumns({"size": F.bit_count("mask"), "cost": _cost_of(F.col("mask"), costs), "evidence": over_bits(F.col("mask"), F.col("gains"))})
    return rows.withColumn("goal", F.col("evidence") * SCALE >= F.col("need"))


def first_rank(mask: Column) -> Column:
    """The larger, the earlier a mask comes among those of its size in the order of its indices."""
    return over_bits(mask, F.array(*[F.lit(1 << (N - 1 - i)) for i in range(N)]))


def optimal(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, cost: the least cost of any goal state."""
    return states(distinct, costs).groupBy("gains").agg(F.min(F.when(F.col("goal"), F.col("cost"))).alias("cost"))


def cheapest(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, plan (mask): the cheapest goal; of equal ones the first by size and order."""
    rows = states(distinct, costs).withColumn("rank", first_rank(F.col("mask")))
    return rows.groupBy("gains").agg(F.min(F.when(F.col("goal"), F.struct("cost", "size", (-F.col("rank")).alias("r"), "mask"))).alias("b")).select("gains", F.col("b.mask").alias("plan"))


def breadth_first(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, plan (mask), cost, expanded: the first goal in the order of breadth-first search.
    Smaller sets come first, sets of one size in the order of their indices."""
    rows = states(distinct, costs).withColumn("rank", first_rank(F.col("mask")))
    best = rows.groupBy("gains").agg(F.min(F.when(F.col("goal"), F.struct("size", (-F.col("rank")).alias("r"), "mask", "cost"))).alias("b"))
    joined = rows.join(best, "gains")
    before = (F.col("size") < F.col("b.size")) | ((F.col("size") == F.col("b.size")) & (F.col("rank") >= -F.col("b.r")))
    return joined.filter(before).groupBy("gains").agg(F.first("b.mask").alias("plan"), F.first("b.cost").alias("cost"), F.count("*").alias("expanded"))


def largest(mask: Column) -> Column:
    """The largest index of a mask's checks, -1 without any."""
    return F.length(F.bin(mask)) - F.when(mask == 0, 2).otherwise(1)


def tree(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, id, parent, mask, check, g, h, evidence, depth, status, goal: every node that
    breadth-first search generates, numbered in the order of generation.

    States are expanded in the order of their size and indices until the first goal is. An expanded
    state generates a node for each check it lacks. A state's first node comes from the state without
    its largest check, which is the earliest of its parents; its other nodes are pruned. A problem has
    2,048 states and 11,265 nodes at most. Where no state is a goal, all are expanded."""
    order = Window.partitionBy("gains").orderBy("size", F.desc("rank"))
    rows = heuristic(states(distinct, costs), costs).withColumn("rank", first_rank(F.col("mask")))
    rows = rows.withColumn("place", F.row_number().over(order))
    end = F.min(F.when(F.col("goal"), F.col("place"))).over(Window.partitionBy("gains"))
    rows = shared.table(rows.withColumn("end", F.coalesce(end, F.lit(STATES))), "states")
    opened = rows.filter((F.col("place") < F.col("end")) | ((F.col("place") == F.col("end")) & ~F.col("goal")))
    begin = F.sum(N - F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lacks = F.filter(F.sequence(F.lit(0), F.lit(N - 1)), lambda c: F.getbit("mask", c) == 0)
    made = opened.withColumn("begin", F.coalesce(begin, F.lit(0))).select("gains", F.col("mask").alias("from"), "begin", F.posexplode(lacks).alias("at", "check"))
    made = made.select("gains", "from", "check", (F.col("begin") + F.col("at") + 1).cast("int").alias("id"), (F.expr("`from` | shiftleft(1, check)")).alias("mask"), (F.col("check") > largest(F.col("from"))).alias("first"))
    about = rows.select("gains", "mask", F.col("cost").alias("g"), "h", "evidence", F.col("size").cast("int").alias("depth"), "goal", "place", "end")
    nodes = shared.table(made.join(about, ["gains", "mask"]), "nodes")
    opener = nodes.filter("first").select("gains", F.col("mask").alias("from"), F.col("id").alias("parent"))
    nodes = nodes.join(opener, ["gains", "from"], "left").withColumn("parent", F.coalesce("parent", F.lit(0)))
    status = F.when(~F.col("first"), "pruned").when(F.col("place") <= F.col("end"), "expanded").otherwise("frontier")
    columns = ["gains", "id", "parent", "mask", "check", "g", "h", "evidence", "depth", "status", "goal"]
    nodes = nodes.withColumn("status", status).withColumn("goal", F.col("goal") & (F.col("status") == "expanded")).select(*columns)
    root = about.filter("mask = 0").select("gains", F.lit(0).alias("id"), F.lit(None).cast("int").alias("parent"), "mask", F.lit(None).cast("int").alias("check"), "g", "h", "evidence", "depth", F.lit("expanded").alias("status"), "goal")
    return root.unionByName(nodes)


def path_to(nodes: DataFrame, which: DataFrame) -> DataFrame:
    """gains, id, path: the checks from the root to each node of which(gains, id), by a recursive query
    over the tree's parents. A path has eleven checks at most."""
    spark = nodes.sparkSession
    names = {"claimworks_nodes": nodes.select("gains", "id", "parent", "check"), "claimworks_ends": which.select("gains", "id")}
    for name, rows in names.items():
        rows.createOrReplaceTempView(name)
    steps = spark.sql("""
        WITH RECURSIVE up(gains, id, at, path, level) AS (
          SELECT gains, id, id, CAST(array() AS array<int>), 0 FROM claimworks_ends
          UNION ALL
          SELECT up.gains, up.id, n.parent, array_prepend(up.path, n.check), up.level + 1
          FROM up JOIN claimworks_nodes n ON n.gains = up.gains AND n.id = up.at WHERE n.parent IS NOT NULL)
        SELECT gains, id, path FROM up WHERE at = 0""")
    for name in names:
        spark.catalog.dropTempView(name)
    return steps


def shown(nodes: DataFrame, cap: int = 240) -> DataFrame:
    """The nodes of a tree that a picture shows: the path to the goal, expanded nodes in their order
    while there are fewer than cap, then the children of those in their order, up to cap. The parent of
    an expanded node is expanded before it, so whatever is shown has its ancestors shown."""
    ends = nodes.filter("goal").select("gains", F.col("mask").alias("end"))
    # on the path to the goal: first nodes whose checks are the goal's smallest ones
    nodes = nodes.join(ends, "gains", "left")
    below = F.expr("end & (shiftleft(1, check + 1) - 1)")
    on_path = F.coalesce((F.col("status") != "pruned") & ((F.col("mask") == 0) | ((F.col("mask") == below) & (F.getbit("end", F.col("check")) == 1))), F.lit(False))
    group = F.when(on_path, 0).when(F.col("status") == "expanded", 1).otherwise(2)
    order = Window.partitionBy("gains").orderBy("group", "id")
    nodes = nodes.withColumn("group", group).withColumn("n", F.row_number().over(order)).filter((F.col("n") <= cap) | (F.col("group") == 0))
    return nodes.drop("end", "group", "n")


def checks(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, total, need, idx, gain, cost: a row per check."""
    return distinct.select("gains", "total", "need", F.posexplode_outer("gains").alias("idx", "gain")).withColumn("cost", F.get(_prices(costs), F.col("idx")))


def hill_climb(distinct: DataFrame, costs: Costs = None) -> DataFrame:
    """gains, cost, expanded, evidence: checks by gain per cost until the threshold is reached."""
    order = Window.partitionBy("gains").orderBy(F.desc(F.col("gain") / F.col("cost")), "idx")
    rows = checks(distinct, costs).filter("gain > 0").withColumn("before", F.sum("gain").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("gain"))
    taken = rows.filter(F.col("before") * SCALE < F.col("need"))
    return taken.groupBy("gains").agg(F.sum("cost").alias("cost"), (F.count("*") + 1).alias("expanded"), F.sum("gain").alias("evidence"))


def heuristic(all_states: DataFrame, costs: Costs = None) -> DataFrame:
    """states with h: the cheapest fractional cover of what is still needed, by unused checks in
    the order of cost per gain; infinite if they don't suffice."""
    own = F.transform(_prices(costs), lambda p: p.cast("double"))
    entry = F.transform("gains", lambda g, i: F.struct((F.get(own, i) / F.greatest(g, F.lit(1))).alias("ratio"), i.alias("i"), g.alias("g"), F.get(own, i).alias("c")))
    rest = F.array_sort(F.filter(entry, lambda x: (x["g"] > 0) & (F.getbit("mask", x["i"]) == 0)))
    start = F.struct((F.col("need") - F.col("evidence") * SCALE).cast("double").alias("need"), F.lit(0.0).alias("h"))

    def step(a, x):
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a["need"] / (x["g"] * SCALE)))
        return F.struct((a["need"] - x["g"] * SCALE * share).alias("need"), (a["h"] + x["c"] * share).alias("h"))

    done = F.aggregate(rest, start, step)
    return all_states.withColumn("f", done).withColumn("h", F.when(F.col("f.need") > 1e-4, F.lit(float("inf"))).otherwise(F.col("f.h"))).drop("f")


def order_plan(plans: DataFrame, costs: Costs = None) -> DataFrame:
    """plans(gains, plan) -> gains, pos, idx, cost, gain, cost_so_far, gain_so_far: the run order,
    cheapest gain first, checks without gain last."""
    rows = plans.select("gains", F.posexplode_outer("gains").alias("idx", "gain"), "plan").filter(F.getbit("plan", F.col("idx")) == 1)
    rows = rows.withColumn("cost", F.get(_prices(costs), F.col("idx")))
    order = Window.partitionBy("gains").orderBy(F.when(F.col("gain") > 0, F.col("cost").cast("double") / F.col("gain")).otherwise(F.lit(float("inf"))), "idx")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("gains", F.row_number().over(order).alias("pos"), "idx", "cost", "gain", F.sum("cost").over(running).alias("cost_so_far"), F.sum("gain").over(running).alias("gain_so_far"))


def runs(ordered: DataFrame, needs: DataFrame) -> DataFrame:
    """order_plan's rows with status: a check runs unless those before it have gathered enough.
    needs(gains, total, need)."""
    before = F.col("gain_so_far") - F.col("gain")
    return ordered.join(needs.select("gains", "total", "need"), "gains").withColumn("status", F.when(before * SCALE >= F.col("need"), "stopped-early").otherwise("run"))


def set_label(mask: Column) -> Column:
    names = F.array(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(x)) for i, x in enumerate(L.LABELS)])
    return F.when(mask == 0, "{ }").otherwise(F.concat(F.lit("{"), F.array_join(F.filter(names, lambda x: x.isNotNull()), ", "), F.lit("}")))
