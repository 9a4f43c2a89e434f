"""The entity graph: neighbourhoods, traversal, mentions, communities as components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import phrases
from brindle.shared import Written


def relationships(edges: DataFrame, entity: str, direction: str = "both", relation_types: list[str] | None = None, limit: int = 100) -> DataFrame:
    """``direction, other, relation_type, confidence`` of one entity; the total is cut to ``limit`` by a total order."""
    e = edges.where(F.col("relation_type").isin(*relation_types)) if relation_types else edges
    out = e.where(F.col("src") == entity).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation_type", "confidence")
    into = e.where(F.col("dst") == entity).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation_type", "confidence")
    found = {"out": out, "in": into, "both": out.union(into)}[direction]
    return found.orderBy("direction", "other", "relation_type").limit(limit)


def either_way(edges: DataFrame) -> DataFrame:
    """``a, b``: each edge in both directions, by one reading of the edges."""
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))


def bfs(edges: DataFrame, start: DataFrame, max_depth: int = 2, relation_types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``id, depth``: what can be reached in ``max_depth`` undirected steps, at its least depth, by one join a level.

    Nodes are listed by (depth, id); ``limit`` counts nodes. Each level joins the
    frontier alone, drops what was visited before and is written, so that no
    level computes the ones before again.
    """
    work = Written(edges.sparkSession, "bfs")
    e = edges.where(F.col("relation_type").isin(*relation_types)) if relation_types else edges
    both = either_way(e)
    seen = frontier = start.select("id").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = work.table(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "id").limit(limit) if limit else seen


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation_type").distinct()


def build_mentions(chunks: DataFrame, names: DataFrame, most: int = 5_000) -> DataFrame:
    """``chunk_id, entity_id``: chunks that hold an entity's name, of any number of words, as written but for case.

    A name inside the occurrence of a longer name is not a mention. Entities of
    one name are all mentioned by it. Names meet texts by equality (see ``phrases``).
    """
    found = phrases.longest(phrases.occurrences(chunks, names, most, "chunk_id", "text", "name")).select(F.col("id").alias("chunk_id"), "phrase").distinct()
    return found.join(names.select(F.lower("name").alias("phrase"), F.col("id").alias("entity_id")), "phrase").select("chunk_id", "entity_id").distinct()


def top_per(d: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def fallback_type(relation_type: Column, known: list[str], other: str = "RELATED_TO") -> Column:
    return F.when(relation_type.isin(*known), relation_type).otherwise(F.lit(other))


def path_to_root(nodes: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """``step, community_id`` from a community up its parents; ends at a root, where a cycle closes or, if given, at ``most`` steps.

    A step looks up one community; with several parents under one id the least is taken.
    """
    path, seen, now = [], set(), start
    while now is not None and now not in seen and (most is None or len(path) < most):
        found = nodes.where(F.col("community_id") == now).agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("parent")).first()
        if not found["n"]:
            break
        path.append((len(path), now))
        seen.add(now)
        now = found["parent"]
    return nodes.sparkSession.createDataFrame(path, "step int, community_id string")


def roots(nodes: DataFrame) -> DataFrame:
    """``community_id, root, depth`` of every community of ``community_id, parent_id``, by pointer doubling.

    In every round each pointer takes its target's pointer, so a chain of n
    settles in a logarithm of n rounds, each one join; what has reached its root
    leaves the join. A parent that is null or no community ends a path. With
    several parents the least counts. A community in or below a cycle has no
    root: both are null. Null ids are left out.
    """
    work = Written(nodes.sparkSession, "roots")
    d = nodes.where("community_id is not null").groupBy("community_id").agg(F.min("parent_id").alias("parent"))
    known = d.select(F.col("community_id").alias("parent"), F.lit(True).alias("there"))
    d = d.join(known, "parent", "left").select("community_id", F.when(F.col("there"), F.col("parent")).alias("at"))
    d = d.select("community_id", F.coalesce("at", "community_id").alias("at"), F.col("at").isNotNull().cast("bigint").alias("depth"), F.col("at").isNull().alias("done"))
    now = work.table(d, "pointers")
    for _ in range(max(1, now.count()).bit_length() + 1):
        open_ = now.where("not done")
        if open_.isEmpty():
            break
        ahead = now.select(F.col("community_id").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("done").alias("end"))
        after = work.table(open_.join(ahead, "at").select("community_id", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done")).union(now.where("done")), "pointers")
        work.drop(now)
        now = after
    return now.select("community_id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour on one side of ``u`` is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    side = both if large else both.where("v < u")
    tied = side.join(side.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    moved = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", "m"))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``id, component``: least reachable id, by alternating large-star and small-star steps until no edge changes.

    The number of rounds grows with the logarithm of the longest chain; an error
    is raised if ``rounds`` are not enough. Edges are written once and each round
    is written.
    """
    work = Written(edges.sparkSession, "components")
    edges = work.table(edges.select("src", "dst"), "given")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id is not null").distinct()
    now, state = work.table(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges"), None
    for _ in range(rounds):
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        now = work.table(_stars(_stars(now, True), False), "edges")
    raise RuntimeError("components did not settle")


def similar_within(vectors: DataFrame, block_col: str, least: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """``src, dst``: edges that connect what is connected by pairs of one block with a cosine (to six digits) of at least ``least``.

    Every pair of a block is compared, by pairs of parts of at most ``block``
    rows, so no task holds more than two parts of a block of any size. A task
    sends no pairs: of each set that its pairs connect it sends a star, at most
    one edge for each row. Null and zero vectors are near nothing.
    """
    d = vectors.select(F.col(block_col).alias("block"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("block is not null and id is not null and v is not null")
    sizes = d.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("parts"))
    d = d.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select("block", "id", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    kind = d.schema["id"].dataType.simpleString()

    def stars(t: pa.Table) -> pa.Table:
        ids, root = t.column("id").to_pylist(), list(range(t.num_rows))
        x = np.array(t.column("v").to_pylist(), np.float64).reshape(t.num_rows, -1)
        norm = np.sqrt((x * x).sum(1))
        x = x / np.where(norm > 0, norm, 1)[:, None]

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for k in range(len(ids) - 1):
            if norm[k] > 0:
                for q in (np.flatnonzero((np.round(x[k + 1 :] @ x[k], 6) >= least) & (norm[k + 1 :] > 0)) + k + 1).tolist():
                    a, b = find(k), find(q)
                    root[max(a, b)] = min(a, b)
        groups: dict[int, list] = {}
        for k, i in enumerate(ids):
            groups.setdefault(find(k), []).append(i)
        pairs = [(min(g), i) for g in groups.values() if len(g) > 1 for i in g if i != min(g)]
        to = t.schema.field("id").type
        return pa.table({"src": pa.array([a for a, _ in pairs], to), "dst": pa.array([b for _, b in pairs], to)})

    return d.groupBy("block", "i", "j").applyInArrow(stars, f"src {kind}, dst {kind}")


def hierarchy(vectors: DataFrame, block_col: str, thresholds: list[float]) -> DataFrame:
    """``level, id, community_id, parent_id``: communities of vectors at falling thresholds, so that each lies inside one of the next level.

    A community is what is connected by pairs that are near enough (see
    ``similar_within``) and is named by its least id; vectors that are near none
    at a level are in no community there. The last level's have no parent.
    """
    if list(thresholds) != sorted(thresholds, reverse=True):
        raise ValueError("thresholds must fall")
    levels = [components(similar_within(vectors, block_col, t)) for t in thresholds]
    out = []
    for k, at in enumerate(levels):
        d = at.select(F.lit(k).alias("level"), "id", F.col("component").alias("community_id"))
        above = levels[k + 1].select(F.col("id").alias("community_id"), F.col("component").alias("parent_id")) if k + 1 < len(levels) else None
        out.append(d.join(above, "community_id", "left").select("level", "id", "community_id", "parent_id") if above is not None else d.withColumn("parent_id", F.lit(None).cast(at.schema["component"].dataType)))
    return reduce(lambda a, b: a.unionByName(b), out)


def edge_scan(edges: DataFrame, limit: int = 500) -> DataFrame:
    """``src, dst, relation_type``: the first edges of the whole graph by a total order."""
    return edges.select("src", "dst", "relation_type").orderBy("src", "dst", "relation_type").limit(limit)


def assign(members: DataFrame, new: DataFrame) -> DataFrame:
    """``id, community_id`` with the assignments of ``new`` in place of an id's earlier ones; repeated assignments are one."""
    return members.join(new.select("id").distinct(), "id", "left_anti").select("id", "community_id").union(new.select("id", "community_id")).distinct()


def at_level(communities: DataFrame, level: str) -> DataFrame:
    return communities.where(F.col("level") == level)


def children(nodes: DataFrame) -> DataFrame:
    """``community_id, parent_id, children``: each community with the sorted list of those below it, joined by commas."""
    below = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("community_id")).agg(F.array_join(F.array_sort(F.collect_list("community_id")), ",").alias("children"))
    return nodes.join(below, "community_id", "left").select("community_id", "parent_id", F.coalesce("children", F.lit("")).alias("children"))


def touching(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end among ``members``: two equi-joins in place of a join on either end."""
    side = lambda c: edges.join(members.select(F.col("id").alias(c)), c, "left_semi").select("src", "dst", "relation_type")
    return side("src").union(side("dst")).distinct()


def between_known(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose ends are both known: two semi-joins."""
    r = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return r.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "relation_type")


def search_entities(entities: DataFrame, part: str | None = None, entity_type: str | None = None, domain: str | None = None, limit: int = 100) -> DataFrame:
    """Entities whose name holds a part as written, of one type and one domain if these are given, the first by id."""
    tests = [F.col("name").contains(part)] if part else []
    tests += [F.col(c) == v for c, v in (("entity_type", entity_type), ("domain", domain)) if v]
    return entities.where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy("id").limit(limit)


def search_communities(communities: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """Communities whose name or summary holds one of the words, as written, by id."""
    hit = reduce(lambda a, b: a | b, [F.col(c).contains(w) for c in ("name", "summary") for w in words], F.lit(False))
    return communities.where(hit).select("id", "name").orderBy("id").limit(limit)


def merge_entities(entities: DataFrame, edges: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after resolution: ``same`` has ``id, component``. A component's entity with the least id stays; edges go to it, and those that become loops or repeats vanish."""
    gone = same.where("id != component")
    left = entities.join(gone.select("id"), "id", "left_anti")
    moved = edges
    for end in ("src", "dst"):
        names = gone.select(F.col("id").alias(end), F.col("component").alias("_to"))
        moved = moved.join(names, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return left, moved.where("src != dst").select("src", "dst", "relation_type").distinct()


def bucket(score: Column, merge: float = 0.9, review: float = 0.7) -> Column:
    """What is done with a pair of entities: merge, review or keep."""
    return F.when(score >= merge, "merge").when(score >= review, "review").otherwise("keep")
