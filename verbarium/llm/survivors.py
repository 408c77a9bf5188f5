"""One surviving record per group of duplicates: whole bundles of dependent fields, chosen by branch and bound.

A *bundle* is a set of fields that only make sense together; it is taken whole from one row. A row's bid for a bundle is
the vector (trust, recency, completeness, -row key), compared in that order; an assignment of one bid per bundle is worth
the sum of its vectors. Functional dependencies ``X -> Y`` across bundles bind the assignment: the chosen ``x`` and ``y``
must occur together in some row of the group.

Branch and bound over all groups at once, every step a join or a partial aggregation, so no group ever meets in one task:

1. *Dominance*: of bids for one bundle with equal constrained values only the best can be chosen; the others go.
2. *Bounds*: the root bound of a group is the sum of its bundles' best bids; the incumbent is the best single row that bids
   for every bundle of the group (it satisfies all dependencies). A bid whose root bound, with it in place of its bundle's
   best, stays under the incumbent is pruned.
3. *Search*: one level per bundle, in an order that follows the dependencies. A node is a partial assignment; its children are
   found by equi-joins through the pairs of values that occur together, never by trying all bids. Children whose value plus the best
   of the bundles to come stays under the incumbent are cut; of nodes that agree in all values that a later dependency
   looks at only the best stays open.

Where dependencies form a forest, a level holds at most one node for each value of one field; without dependencies one node a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbarium.plans.runtime import stored

#: What is written where there is no value (compared in lower case, without spaces at the ends).
STAND_INS = ("n/a", "null", "none", "unknown", "todo", "tbd", "missing", "[missing]", "undefined", "[none]", "(none)", "[null]", "[unknown]", "nan")
NO_TRUST = -1_000_000_000
#: Lowest time, before any timestamp; sums over 32 bundles stay in 64 bits.
NO_TIME = -(2**58)


def usable(c: Column) -> Column:
    """Not null, blank or a stand-in for "no value"; a text without any letter or digit is a stand-in too."""
    t = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.coalesce(t.rlike(r"[\p{L}\p{N}]") & ~t.isin(*STAND_INS), F.lit(False))


@dataclass(frozen=True)
class Bundle:
    """``usable``: whether a row bids; ``completeness``: a number; ``value``: what it contributes (any type)."""

    name: str
    usable: Column
    completeness: Column
    value: Column


@dataclass(frozen=True)
class Dependency:
    """``left`` determines ``right``: (bundle, text expression) each."""

    left: tuple[str, Column]
    right: tuple[str, Column]


VECTOR = ("trust", "recency", "full", "row")
ZERO = "named_struct('trust', 0L, 'recency', 0L, 'full', 0L, 'row', 0L)"


def _plus(*vectors: Column) -> Column:
    """The sum of bid vectors."""
    total = lambda c: sum((v[c] for v in vectors[1:]), vectors[0][c])
    return F.struct(*(total(c).alias(c) for c in VECTOR))


def _bid(row: str, b: Bundle, trust: Column, recency: Column) -> Column:
    return F.struct(
        F.coalesce(F.round(trust * F.lit(1e6)).cast("long"), F.lit(NO_TRUST)).alias("trust"), F.coalesce(F.unix_micros(recency), F.lit(NO_TIME)).alias("recency"),
        F.coalesce(b.completeness, F.lit(0)).cast("long").alias("full"), (-F.col(row)).cast("long").alias("row"),
    )


def _end(c: Column) -> Column:
    """A constrained value; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def plan_order(n: int, ends: list[tuple[int, int]]) -> list[int]:
    """Bundles in the order of the levels: each part of the dependency graph is finished, breadth first, before the next begins."""
    near = {i: [] for i in range(n)}
    for a, b in ends:
        near[a].append(b)
        near[b].append(a)
    order: list[int] = []
    for start in sorted(range(n), key=lambda i: -len(near[i])):
        queue = [start]
        while queue:
            i = queue.pop(0)
            if i not in order:
                order.append(i)
                queue += near[i]
    return order


def choose(df: DataFrame, group: str, row: str, bundles: list[Bundle], trust: Column, recency: Column, fds: list[Dependency] | None = None, least: int = 2) -> DataFrame:
    """(``group``, ``bundle``, ``row``, ``value``, ``consistent``): for every group of at least ``least`` rows the row that supplies
    each bundle, and what it supplies. A bundle without a usable value in the group gives no row.

    Null groups are left out; a null trust or time is lowest; full ties go to the smallest row key; equal rows are one; a null
    end of a dependency is a value of its own. ``value`` of all bundles must be of one type. A group that no assignment
    satisfies keeps its root bound, every bundle's best bid, with ``consistent`` false.
    """
    fds = fds or []
    index = {b.name: i for i, b in enumerate(bundles)}
    ends = [(index[d.left[0]], index[d.right[0]]) for d in fds]
    order = plan_order(len(bundles), ends)
    rows = df.where(F.col(group).isNotNull())

    # every row's offer for each bundle it bids for, worked out once
    offers = []
    for i, b in enumerate(bundles):
        x = [_end(d.left[1]) if ends[k][0] == i else _end(d.right[1]) if ends[k][1] == i else F.lit(None).cast("string") for k, d in enumerate(fds)]
        x = F.array(*x) if x else F.array().cast("array<string>")
        offers.append(F.when(b.usable, F.struct(F.lit(i).alias("b"), x.alias("x"), F.struct(_bid(row, b, F.col("__trust"), F.col("__recency")).alias("bid"), b.value.alias("value")).alias("top"))).alias(f"o{i}"))
    rows = stored(rows.withColumns({"__trust": trust, "__recency": recency}).select(F.col(group).alias("g"), *offers), "p1-offers")
    each = [F.col(f"o{i}") for i in range(len(bundles))]

    # dominance: the best bid for each bundle and its constrained values
    bids = rows.select("g", F.inline(F.array_compact(F.array(*each))))
    bids = stored(bids.groupBy("g", "b", "x").agg(F.max("top").alias("top")), "p1-bids")

    # bounds: the best of each bundle, and the best row among those that bid for most bundles
    worth = _plus(*(F.coalesce(o["top"]["bid"], F.expr(ZERO)) for o in each))
    held = sum((o.isNotNull().cast("int") for o in each), F.lit(0))
    per = rows.groupBy("g").agg(F.count("*").alias("n"), F.max(F.struct(held.alias("held"), worth.alias("worth"))).alias("row"))
    best = bids.groupBy("g").agg(*(F.max(F.when(F.col("b") == i, F.col("top"))).alias(f"t{i}") for i in range(len(bundles))))
    mask = sum((F.when(F.col(f"t{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(bundles))), F.lit(0))
    tops = F.array(*(F.coalesce(F.col(f"t{i}.bid"), F.expr(ZERO)) for i in range(len(bundles))))
    root = per.where(F.col("n") >= least).join(best, "g").select("g", mask.alias("mask"), tops.alias("tops"), "row", *(f"t{i}" for i in range(len(bundles))))
    low = F.when(F.col("row.held") == F.bit_count("mask"), F.col("row.worth"))
    bound = _plus(*(F.coalesce(F.col(f"t{i}.bid"), F.expr(ZERO)) for i in range(len(bundles))))
    root = stored(root.select("g", "mask", "tops", low.alias("low"), bound.alias("bound"), *(f"t{i}" for i in range(len(bundles)))), "p1-root")
    lost = lambda t: F.struct(*((F.col("bound")[c] - t[c] + F.col("top.bid")[c]).alias(c) for c in VECTOR))
    alive = bids.join(root.select("g", "tops", "low", "bound"), "g").where(F.col("low").isNull() | (lost(F.get("tops", F.col("b"))) >= F.col("low")))
    alive = stored(alive.select("g", "b", "x", "top"), "p1-alive")

    pairs = None
    if fds:
        seen = [F.when(each[a].isNotNull() & each[b].isNotNull(), F.struct(F.lit(k).alias("d"), each[a]["x"][k].alias("l"), each[b]["x"][k].alias("r"))) for k, (a, b) in enumerate(ends)]
        pairs = stored(rows.select("g", F.inline(F.array_compact(F.array(*seen)))).distinct(), "p1-pairs")

    # search: one level per bundle; ``x<k>`` is what the open dependency k asks for
    pick = "struct<b:int,row:bigint,value:" + bids.schema["top"].dataType["value"].dataType.simpleString() + ">"
    state = root.select("g", "mask", "tops", "low", F.expr(ZERO).alias("worth"), F.array().cast(f"array<{pick}>").alias("picks"))
    asked: list[int] = []
    for level, i in enumerate(order):
        to_come = order[level + 1 :]
        back = [k for k in asked if i in ends[k]]
        own = [k for k, e in enumerate(ends) if i in e and k not in back]
        offer = alive.where(F.col("b") == i).select("g", F.col("top.bid").alias("bid"), F.struct(F.lit(i).alias("b"), (-F.col("top.bid.row")).alias("row"), F.col("top.value").alias("value")).alias("pick"), *(F.col("x")[k].alias(f"y{k}") for k in back + own))
        has = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        if back:
            go = state.where(has)
            k = back[0]
            other = ends[k][0] if ends[k][1] == i else ends[k][1]
            mine, theirs = ("l", "r") if ends[k][0] == i else ("r", "l")
            link = pairs.where(F.col("d") == k).select("g", F.col(theirs).alias(f"x{k}"), F.col(mine).alias(f"y{k}"))
            bound_by = F.col("mask").bitwiseAND(F.lit(1 << other)) != 0
            met = go.where(bound_by).join(link, ["g", f"x{k}"]).join(offer, ["g", f"y{k}"])
            free = go.where(~bound_by).join(offer, "g")
            met = met.unionByName(free.select(*met.columns)).unionByName(state.where(~has), allowMissingColumns=True)
        else:
            met = state.join(offer, "g", "left")
        for k in back[1:]:  # a cycle of dependencies: the pair must occur too
            other = ends[k][0] if ends[k][1] == i else ends[k][1]
            mine, theirs = ("l", "r") if ends[k][0] == i else ("r", "l")
            seen = pairs.where(F.col("d") == k).select("g", F.col(theirs).alias(f"x{k}"), F.col(mine).alias(f"y{k}"), F.lit(True).alias("seen"))
            met = met.join(seen, ["g", f"x{k}", f"y{k}"], "left").where(F.col("seen") | ~has | (F.col("mask").bitwiseAND(F.lit(1 << other)) == 0)).drop("seen")
        asked = [k for k in asked if k not in back] + own
        keep = ["g", "mask", "tops", "low"]
        worth, picks = F.when(has, _plus(F.col("worth"), F.col("bid"))).otherwise(F.col("worth")), F.when(has, F.concat("picks", F.array("pick"))).otherwise(F.col("picks"))
        met = met.select(*keep, worth.alias("worth"), picks.alias("picks"), *(F.col(f"y{k}" if k in own else f"x{k}").alias(f"x{k}") for k in asked))
        rest = [F.get("tops", F.lit(j)) for j in to_come]
        met = met.where(F.col("low").isNull() | (_plus(F.col("worth"), *rest) >= F.col("low")))
        best = met.groupBy("g", *(f"x{k}" for k in asked)).agg(*(F.first(c).alias(c) for c in keep[1:]), F.max(F.struct("worth", "picks")).alias("n"))
        state = best.select(*keep, F.col("n.worth").alias("worth"), F.col("n.picks").alias("picks"), *(f"x{k}" for k in asked))
        if asked:  # read several times by the next level
            state = stored(state, f"p1-level{level}")

    names = F.array(*(F.lit(b.name) for b in bundles))
    solved = state.select("g", F.inline("picks"), F.lit(True).alias("consistent"))
    if fds:  # groups without any consistent assignment
        each = F.array_compact(F.array(*(F.when(F.col(f"t{i}").isNotNull(), F.struct(F.lit(i).alias("b"), (-F.col(f"t{i}.bid.row")).alias("row"), F.col(f"t{i}.value").alias("value"))) for i in range(len(bundles)))))
        broken = root.join(state.select("g"), "g", "left_anti").select("g", F.inline(each), F.lit(False).alias("consistent"))
        solved = solved.unionByName(broken)
    return solved.select(F.col("g").alias(group), F.element_at(names, F.col("b") + 1).alias("bundle"), "row", "value", "consistent")
