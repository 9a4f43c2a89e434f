"""Communities that raise modularity, by merging and moving in rounds over edge tables.

With weights w, degrees k, total weight m and resolution r, merging communities c
and d raises modularity by ``(w_cd - r k_c k_d / 2m) / m``. A round:

1. every community takes the neighbour of greatest gain; a coin by hash and round
   makes half of them senders and half receivers, and a sender whose choice is a
   receiver wants to join it, so nobody receives and leaves at once; a receiver
   with a choice of its own of more than twice the gain does not take it;
2. many senders of one receiver would overfill it. The gain of a set that joins
   is at least what its members gain less what they cost each other, which sums
   tell; each receiver takes the share of its senders (all, half, a quarter ...,
   or the best one alone) for which that is greatest;
3. the graph is contracted.

So modularity never falls, a hub gathers its neighbours in a logarithm of rounds,
and nothing needs the members of a community in one place: rounds are joins and
sums that Spark combines before it shuffles. When no merge gains, vertices move
between communities by the same rule; then the next, coarser resolution goes on
from there, so its communities are unions of the finer ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.shared import Written, small_broadcasts

#: Shares of a receiver's senders that are tried.
SHARES = [2.0**-i for i in range(11)]
#: Bytes of a table that the joins of a round broadcast: what is broadcast passes the driver, in each of hundreds of joins.
SMALL = 64 << 10


def _coin(c: str, turn: int, salt: str) -> Column:
    """A number in [0, 1) by id and round."""
    return F.pmod(F.xxhash64(F.col(c), F.lit(turn), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _both(edges: DataFrame) -> DataFrame:
    """``i, j, w``, with all columns of either end, in both directions."""
    swapped = edges.select(F.col("v").alias("i"), F.col("u").alias("j"), "w", F.col("kv").alias("ki"), F.col("ku").alias("kj"))
    return edges.select(F.col("u").alias("i"), F.col("v").alias("j"), "w", F.col("ku").alias("ki"), F.col("kv").alias("kj")).union(swapped)


def _weighted(edges: DataFrame) -> DataFrame:
    """``u, v, w``: one row for each pair of ends, weights added up; null ends and weights that are not positive are left out."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    d = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), w.alias("w")).where("src is not null and dst is not null and w > 0")
    return d.groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """Of ``src, dst`` (``weight``, 1 without) and ``id, community_id``."""
    e = _weighted(edges).where("w is not null")
    c = members.select("id", "community_id")
    ends = e.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v")
    inside, m = ends.agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    degrees = ends.select(F.inline(F.array(F.struct(F.col("cu").alias("c"), "w"), F.struct(F.col("cv").alias("c"), "w")))).groupBy("c").agg(F.sum("w").alias("k"))
    return inside / m - resolution * degrees.agg(F.sum((F.col("k") / (2 * m)) ** 2)).first()[0] if m else 0.0


class _Graph:
    """Contracted edges ``u, v, w, ku, kv`` between communities and ``id, k`` of every community, written each round."""

    def __init__(self, work: Written, nodes: DataFrame, edges: DataFrame, m: float):
        self.work, self.nodes, self.edges, self.m = work, nodes, edges, m

    def value(self, resolution: float) -> float:
        """Modularity of the communities as they are: what lies between them is what is left of the edges."""
        between = self.edges.agg(F.sum("w")).first()[0] or 0.0
        squares = self.nodes.agg(F.sum((F.col("k") / (2 * self.m)) ** 2)).first()[0] or 0.0
        return 1 - between / self.m - resolution * squares

    def moves(self, resolution: float, turn: int) -> DataFrame:
        """``i, to`` of one round of merges."""
        gain = F.col("w") - resolution * F.col("ki") * F.col("kj") / (2 * self.m)
        choice = _both(self.edges).withColumn("gain", gain).where("gain > 1e-12")
        best = choice.groupBy("i").agg(F.max(F.struct("gain", _coin("j", turn, "tie").alias("t"), "j", "w", "ki", "kj")).alias("b")).select("i", F.col("b.j").alias("to"), "b.gain", "b.w", "b.ki", "b.kj")
        best = self.work.table(best, "best")
        wish = best.where((_coin("i", turn, "side") < 0.5) & (_coin("to", turn, "side") >= 0.5)).withColumn("x", _coin("i", turn, "share"))
        wish = wish.join(best.select(F.col("i").alias("to"), F.col("gain").alias("other")), "to").where("2 * gain >= other").drop("other")
        return _granted(self.work.table(wish, "wish"), 0.5 * resolution / self.m)

    def contract(self, moves: DataFrame) -> None:
        """Movers become part of where they go."""
        to = self.nodes.join(moves.select(F.col("i").alias("id"), "to"), "id", "left").select("id", F.coalesce("to", "id").alias("to"), "k")
        nodes = self.work.table(to.groupBy(F.col("to").alias("id")).agg(F.sum("k").alias("k")), "nodes")
        named = to.drop("k").join(nodes.withColumnRenamed("id", "to"), "to")
        e = self.edges.select("u", "v", "w").join(named.toDF("tu", "u", "ku"), "u").join(named.toDF("tv", "v", "kv"), "v").where("tu != tv")
        e = e.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"), "w", F.when(F.col("tu") < F.col("tv"), F.col("ku")).otherwise(F.col("kv")).alias("ku"), F.when(F.col("tu") < F.col("tv"), F.col("kv")).otherwise(F.col("ku")).alias("kv"))
        old, self.edges = self.edges, self.work.table(e.groupBy("u", "v").agg(F.sum("w").alias("w"), F.first("ku").alias("ku"), F.first("kv").alias("kv")), "edges")
        self.work.drop(old)
        self.nodes = nodes


def _granted(wish: DataFrame, cost: float) -> DataFrame:
    """``i, to`` of the wishes ``i, to, gain, w, ki, kj, x`` that a receiver takes: the share whose joint gain is greatest for certain."""
    sums = [f(F.when(F.col("x") < s, c).otherwise(0.0)).alias(f"{n}{i}") for i, s in enumerate(SHARES) for n, c, f in (("w", F.col("w"), F.sum), ("s", F.col("ki"), F.sum), ("p", F.col("ki") * F.col("ki"), F.sum))]
    g = wish.groupBy("to").agg(F.max("kj").alias("k"), F.max(F.struct("gain", "x", "i")).alias("one"), *sums)
    joint = lambda i: F.col(f"w{i}") - cost * (F.col("k") * F.col(f"s{i}") + (F.col(f"s{i}") * F.col(f"s{i}") - F.col(f"p{i}")) / 2)
    best = F.greatest(*(F.struct(joint(i).alias("gain"), F.lit(s).alias("share")) for i, s in enumerate(SHARES)), F.struct(F.col("one.gain").alias("gain"), F.lit(0.0).alias("share")))
    chosen = g.select("to", best["share"].alias("share"), F.col("one.i").alias("one"))
    return wish.join(chosen, "to").where((F.col("x") < F.col("share")) | (F.col("i") == F.col("one"))).select("i", "to")


def _refined(work: Written, members: DataFrame, edges: DataFrame, m: float, resolution: float, turns: int) -> DataFrame:
    """``id, community_id, k`` after vertices have moved to neighbouring communities that gain by it; edges ``u, v, w, ku, kv`` are between vertices."""
    per = resolution / (2 * m)
    near = _both(edges).select("i", "j", "w")
    for turn in range(turns):
        whole = members.groupBy("community_id").agg(F.sum("k").alias("all"))
        own = members.join(whole, "community_id")
        tied = near.join(members.select(F.col("id").alias("j"), F.col("community_id").alias("c")), "j").groupBy("i", "c").agg(F.sum("w").alias("w"))
        here = tied.join(own.select(F.col("id").alias("i"), F.col("community_id").alias("at"), "k", F.col("all").alias("all_at")), "i")
        inside = F.coalesce(F.max(F.when(F.col("c") == F.col("at"), F.col("w"))), F.lit(0.0))
        others = F.collect_list(F.when(F.col("c") != F.col("at"), F.struct("c", "w")))  # communities that one vertex touches
        wish = here.groupBy("i", "at", "k", "all_at").agg(inside.alias("in"), others.alias("o")).select("i", "at", "k", "all_at", "in", F.inline("o"))
        wish = wish.join(whole.withColumnRenamed("community_id", "c"), "c")
        wish = wish.withColumn("gain", F.col("w") - F.col("in") - per * F.col("k") * (F.col("all") - F.col("all_at") + F.col("k"))).where("gain > 1e-12")
        wish = work.table(wish, "wishes")
        if wish.isEmpty():
            break
        wish = wish.where((_coin("at", turn, "side") < 0.5) & (_coin("c", turn, "side") >= 0.5))
        best = wish.groupBy("i").agg(F.max(F.struct("gain", "c", "at", "k", "all", "all_at", "w", "in")).alias("b")).select("i", "b.*").where(_coin("i", turn, "share") < SHARES[2 * (turn % 3)])
        best = work.table(best, "wish")
        # as if all others that want to go were gone, and all that want to come were there
        coming, going = (best.groupBy(c).agg(F.sum("k").alias(f"s_{c}")) for c in ("c", "at"))
        sure = F.col("w") - F.col("in") - per * F.col("k") * (F.col("all") + F.col("s_c") - F.col("k") - F.col("all_at") + F.col("s_at"))
        moved = work.table(best.join(coming, "c").join(going, "at").where(sure > 1e-12).select(F.col("i").alias("id"), F.col("c").alias("to")), "moved")
        if moved.isEmpty():
            continue
        members = work.table(members.join(moved, "id", "left").select("id", F.coalesce("to", "community_id").alias("community_id"), "k"), "members")
    return members


def communities(edges: DataFrame, resolutions: tuple[float, ...] = (1.2, 0.8), rounds: int = 200, refine: int = 12) -> tuple[DataFrame, list[dict]]:
    """``level, id, community_id, parent_id`` of every vertex of ``src, dst`` (``weight``, 1 without), and what each step reached.

    Resolutions fall: level 0 has the finest communities, and each lies inside
    its parent on the next level; the last have none. A community is named by its
    least vertex. Edges count in both directions, repeated ones add up, loops
    count as weight inside; null ends and weights that are not positive are left
    out. The report lists ``level, step, modularity, communities``; within a
    level modularity never falls. An error is raised if ``rounds`` are not enough.
    """
    if list(resolutions) != sorted(resolutions, reverse=True):
        raise ValueError("resolutions must fall")
    with small_broadcasts(edges.sparkSession, SMALL):
        return _communities(Written(edges.sparkSession, "modularity"), edges, resolutions, rounds, refine)


def _communities(work: Written, edges: DataFrame, resolutions: tuple[float, ...], rounds: int, refine: int) -> tuple[DataFrame, list[dict]]:
    given = work.table(_weighted(edges), "given")
    m = given.agg(F.sum("w")).first()[0] or 0.0
    ends = given.select(F.inline(F.array(F.struct(F.col("u").alias("id"), "w"), F.struct(F.col("v").alias("id"), "w"))))
    vertices = work.table(ends.groupBy("id").agg(F.sum("w").alias("k")), "vertices")
    where, levels, report = vertices.select("id", F.col("id").alias("community_id")), [], []
    for level, r in enumerate(resolutions):
        # the vertices of this level are the communities of the one below
        nodes = vertices.join(where, "id").groupBy(F.col("community_id").alias("id")).agg(F.sum("k").alias("k"))
        nodes = work.table(nodes, "nodes")
        ends = where.join(nodes.withColumnRenamed("id", "community_id"), "community_id")
        e = given.join(ends.toDF("cu", "u", "ku"), "u").join(ends.toDF("cv", "v", "kv"), "v").where("cu != cv")
        flip = lambda a, b: F.when(F.col("cu") < F.col("cv"), F.col(a)).otherwise(F.col(b))
        e = e.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w"), F.first(flip("ku", "kv")).alias("ku"), F.first(flip("kv", "ku")).alias("kv"))
        base = work.table(e, "base")
        graph, at = _Graph(work, nodes, work.table(base, "edges"), m), nodes.select("id", F.col("id").alias("community_id"))
        for turn in range(rounds):
            gains = graph.edges.where(F.col("w") - r * F.col("ku") * F.col("kv") / (2 * m) > 1e-12) if m else graph.edges
            if gains.isEmpty():
                break
            moves = work.table(graph.moves(r, turn), "moves")
            if moves.isEmpty():
                continue
            graph.contract(moves)
            at = work.table(at.join(moves.select(F.col("i").alias("community_id"), "to"), "community_id", "left").select("id", F.coalesce("to", "community_id").alias("community_id")), "at")
            report.append({"level": level, "step": "merge", "modularity": graph.value(r), "communities": graph.nodes.count()})
        else:
            raise RuntimeError("communities did not settle")
        if m and refine:
            at = _refined(work, at.join(nodes, "id"), base, m, r, refine).select("id", "community_id")
        least = at.groupBy("community_id").agg(F.min("id").alias("name"))
        at = work.table(at.join(least, "community_id").select("id", F.col("name").alias("community_id")), "level")
        where = work.table(where.select("id", F.col("community_id").alias("c")).join(at.select(F.col("id").alias("c"), "community_id"), "c").select("id", "community_id"), "where")
        report.append({"level": level, "step": "refine", "modularity": modularity(given.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("w").alias("weight")), where, r), "communities": at.select("community_id").distinct().count()})
        levels.append((where, at))
    out = []
    for level, (whole, _) in enumerate(levels):
        kind = whole.schema["id"].dataType
        up = levels[level + 1][1].select(F.col("id").alias("community_id"), F.col("community_id").alias("parent_id")) if level + 1 < len(levels) else None
        d = whole.join(up, "community_id") if up is not None else whole.withColumn("parent_id", F.lit(None).cast(kind))
        out.append(d.select(F.lit(level).alias("level"), "id", "community_id", "parent_id"))
    return reduce(lambda a, b: a.union(b), out), report
