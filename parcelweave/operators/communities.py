"""Components of a graph, split into communities where they are too large.

Communities raise the modularity by the Louvain method (Blondel and others, 2008), as rounds of
joins over an edge table, so that no task holds a component.  In a turn every node may move to the
neighbouring community of the greatest gain, in even turns to a heavier one than its own (of equally
heavy ones to that of the smaller name), in odd turns to a lighter one, so that no two nodes swap.  A
turn's moves stand in the components whose modularity they raise; where they don't, the next try is made with
half of the nodes.  When neither direction helps, communities become the nodes of a smaller graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.operators.components import connected_components, spanning as spanned
from parcelweave.operators.relational import with_dense_id
from parcelweave.storage import cut, discard, materialize

#: Buildings in a portfolio that is not split.
SIZE_LIMIT = 300
#: A component is settled after so many points: two for a turn in which no node would gain, one for moves that did not help together.
PATIENCE = 4
LEAST_GAIN = 1e-12


def _near(links: DataFrame, homes: DataFrame) -> DataFrame:
    """``(a, to, held, w)``: each node's weight towards each community, and the weight that this community holds."""
    return links.join(homes.select(F.col("a").alias("b"), F.col("home").alias("to"), "held"), "b").groupBy("a", "to").agg(F.first("held").alias("held"), F.sum("w").alias("w"))


def _alone(links: DataFrame, homes: DataFrame) -> DataFrame:
    """``_near`` while every node is its own community: links as they are."""
    return links.join(homes.select(F.col("a").alias("b"), "held"), "b").select("a", F.col("b").alias("to"), "held", "w")


def _modularity(homes: DataFrame, near: DataFrame | None, resolution: float) -> DataFrame:
    """``(piece, twice, q)``; ``twice`` is twice the weight of all edges; without ``near`` no link is inside a community."""
    # a community's weight times those of its nodes is its square
    held = homes.groupBy("piece").agg(F.sum("k").alias("twice"), F.sum(F.col("k") * F.col("held")).alias("squares"), F.sum("loop").alias("loops")).where("twice > 0")
    if near is None:
        held = held.withColumn("inner", F.lit(0.0))
    else:
        held = held.join(near.join(homes.select("piece", "a", "home"), "a").where("to = home").groupBy("piece").agg(F.sum("w").alias("inner")), "piece", "left")
    q = (F.coalesce("inner", F.lit(0.0)) + 2 * F.col("loops")) / F.col("twice") - resolution * F.col("squares") / (F.col("twice") * F.col("twice"))
    return held.select("piece", "twice", q.alias("q"))


def _moves(near: DataFrame, homes: DataFrame, status: DataFrame, turn: int, resolution: float, seed: int) -> DataFrame:
    """``(piece, a, next)``: nodes that gain by moving, and where to."""
    own = homes.withColumnRenamed("held", "mine").join(status.where(F.col("quiet") < PATIENCE).select("piece", "twice", "quiet"), "piece")
    own = own.where((F.col("quiet") % 2 == 0) | (F.xxhash64(F.lit(seed), F.lit(turn), "a") % 2 == 0)).select("piece", "a", "k", "home", "mine", "twice")
    gain = F.col("w") - resolution * F.col("held") * F.col("k") / F.col("twice")
    heavier = F.struct(F.col("held"), -F.col("to")) > F.struct(F.col("mine"), -F.col("home"))
    allowed = (F.col("to") != F.col("home")) & (heavier if turn % 2 == 0 else ~heavier)
    stays = F.coalesce(F.sum(F.when(F.col("to") == F.col("home"), F.col("w"))), F.lit(0.0)) - resolution * (F.first("mine") - F.first("k")) * F.first("k") / F.first("twice")
    best = F.max(F.when(allowed, F.struct(gain.alias("gain"), (-F.col("to")).alias("less"))))
    # joined and grouped by the same key, so that links are dealt once
    offers = near.join(own, "a").groupBy("a").agg(F.first("piece").alias("piece"), stays.alias("stays"), best.alias("best"))
    return offers.where(F.col("best.gain") > F.col("stays") + LEAST_GAIN).select("piece", "a", (-F.col("best.less")).alias("next"))


def _settled(links: DataFrame, homes: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``homes`` and ``_near`` when no more turns help, and the tables to discard after use."""
    near, written = _alone(links, homes), [homes]
    status = materialize(_modularity(homes, None, resolution).withColumn("quiet", F.lit(0)), "status")
    turn = 0
    while not status.where(F.col("quiet") < PATIENCE).isEmpty():
        moves = materialize(_moves(near, homes, status, turn, resolution, seed), "moves")
        turn += 1
        moving = moves.groupBy("piece").agg(F.lit(1).alias("cost"))
        if moves.isEmpty():
            after = materialize(status.withColumn("quiet", F.col("quiet") + 2), "status")
            discard(moves, status)
            status = after
            continue
        tried = homes.join(moves.select("a", "next"), "a", "left").select("piece", "a", "k", "loop", F.col("home").alias("before"), F.col("held").alias("once"), F.coalesce("next", "home").alias("home"))
        tried = materialize(tried.join(tried.groupBy("home").agg(F.sum("k").alias("held")), "home"), "tried")
        met = materialize(_near(links, tried), "near")
        told = _modularity(tried, met, resolution).select("piece", F.col("q").alias("now"))
        better = F.coalesce(F.col("now") > F.col("q") + LEAST_GAIN, F.lit(False))
        after = status.join(told, "piece", "left").join(moving, "piece", "left")
        after = after.select("piece", "twice", F.when(better, F.col("now")).otherwise(F.col("q")).alias("q"), F.when(better, 0).otherwise(F.col("quiet") + F.coalesce("cost", F.lit(2))).alias("quiet"))
        after = materialize(after, "status")
        discard(moves)
        n, helped = after.agg(F.count(F.lit(1)), F.count(F.when(F.col("quiet") == 0, 1))).first()
        if helped == n:
            discard(*written)
            homes, near, written = tried.drop("before", "once"), met, [tried, met]
        elif helped:
            good = after.where("quiet = 0").select("piece", F.lit(True).alias("good"))
            told = tried.join(good, "piece", "left")
            kept = told.select("piece", "a", "k", "loop", *[F.when(F.col("good"), F.col(now)).otherwise(F.col(was)).alias(now) for now, was in (("home", "before"), ("held", "once"))])
            kept = materialize(kept, "homes")
            movers = told.where("good").select("a")
            both = materialize(met.join(movers, "a", "left_semi").unionByName(near.join(movers, "a", "left_anti")), "near")
            discard(*written, tried, met)
            homes, near, written = kept, both, [kept, both]
        else:
            discard(tried, met)
        discard(status)
        status = after
    discard(status)
    return homes, near, written


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 0.1, seed: int = 0) -> DataFrame:
    """``(node, community)`` for ``nodes`` of ``(piece, node)`` and ``edges`` of ``(piece, src, dst, weight)``; a community has the name of its smallest node.

    Pieces are separate graphs.  An edge that joins a node to itself counts as a loop; several edges between
    two nodes add up.
    """
    return _communities(nodes, _undirected(edges), resolution, seed)


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").cast("double").alias("weight"))


def _communities(nodes: DataFrame, edges: DataFrame, resolution: float, seed: int) -> DataFrame:
    """``communities`` where no edge's ``src`` is above its ``dst``."""
    members = materialize(nodes.select("node", F.col("node").alias("at"), "piece").distinct(), "members")
    # each edge is stored once and read in both directions
    stored = materialize(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")), "links")
    ends = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    links = stored.where("src <> dst").select(ends.alias("e"), "w").select("e.a", "e.b", "w")
    loops = stored.where("src = dst").select(F.col("src").alias("a"), F.col("w").alias("loop"))
    homes = members.select("piece", F.col("node").alias("a")).join(loops, "a", "left").select("piece", "a", F.coalesce("loop", F.lit(0.0)).alias("loop"))
    while True:
        degrees = links.groupBy("a").agg(F.sum("w").alias("k"))
        k = F.coalesce("k", F.lit(0.0)) + 2 * F.col("loop")
        homes = homes.join(degrees, "a", "left").select("piece", "a", k.alias("k"), "loop", F.col("a").alias("home"), k.alias("held"))
        homes, near, written = _settled(links, materialize(homes, "homes"), resolution, seed)
        merged = not homes.where("a <> home").isEmpty()
        if merged:
            told = near.join(homes.select("a", "home"), "a").groupBy(F.col("home").alias("a"), F.col("to").alias("b")).agg(F.sum("w").alias("w"))
            told = materialize(told, "contracted")
            inner = told.where("a = b").select("a", (F.col("w") / 2).alias("more"))
            after = homes.groupBy("piece", "home").agg(F.sum("loop").alias("loop")).withColumnRenamed("home", "a").join(inner, "a", "left")
            after = materialize(after.select("piece", "a", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop")), "homes")
            placed = materialize(members.join(homes.select(F.col("a").alias("at"), "home"), "at").select("node", F.col("home").alias("at"), "piece"), "members")
            fewer = materialize(told.where("a <> b"), "links")
            discard(members, told, stored)
            members, links, stored = placed, fewer, fewer
        discard(*written)
        if not merged:
            break
        homes = after
    names = members.groupBy("at").agg(F.min("node").alias("community"))
    found = cut(members.join(names, "at").select("node", "community"))
    discard(members, stored)
    return found


def split_components(nodes: DataFrame, edges: DataFrame, limit: int = SIZE_LIMIT, resolution: float = 0.1, seed: int = 0, spanning: DataFrame | None = None) -> DataFrame:
    """``(nodeid, orig_id, portfolio)`` for ``nodes`` with ``nodeid`` and ``size``, and ``edges`` with ``src``, ``dst`` and ``weight``.

    ``spanning`` are fewer links with the same components.  Components are numbered from 1 by their smallest node.  One over the limit is split into its
    communities, and these again, as long as they are over the limit and still part.
    """
    lone = nodes.select(F.col("nodeid").alias("src"), F.col("nodeid").alias("dst"))
    found = connected_components((spanned(edges) if spanning is None else spanning.select("src", "dst")).unionByName(lone))
    sized = cut(nodes.join(found, nodes["nodeid"] == found["node"]).select("nodeid", "size", "component"))
    originals = with_dense_id(sized.select("component").distinct(), ["component"], "orig_id")
    placed = materialize(sized.select("nodeid", "size", "component", F.col("component").alias("piece"), F.lit(False).alias("whole")), "placed")
    whole = True
    while True:
        large = placed.where("NOT whole").groupBy("piece").agg(F.sum("size").alias("total")).where(F.col("total") > limit).select("piece")
        large = materialize(large, "large")
        if large.isEmpty():
            discard(large)
            break
        own = placed.join(large, "piece", "left_semi").select("piece", F.col("nodeid").alias("node"))
        if whole:  # an edge's other end is in the same component
            ends = _undirected(edges).join(own.select(F.col("node").alias("src")), "src", "left_semi")
        else:
            ends = _undirected(edges).join(own.toDF("piece", "src"), "src").join(own.toDF("other", "dst"), "dst").where("piece = other")
        whole = False
        parts = _communities(own, ends.select("src", "dst", "weight"), resolution, seed)
        parted = placed.join(parts.withColumnRenamed("node", "nodeid"), "nodeid", "left")
        single = parts.join(own, "node").groupBy("piece").agg(F.min("community").alias("low"), F.max("community").alias("high")).where("low = high").select("piece", F.lit(True).alias("single"))
        after = parted.join(single, "piece", "left").select("nodeid", "size", "component", F.coalesce("community", "piece").alias("piece"), (F.col("whole") | F.coalesce("single", F.lit(False))).alias("whole"))
        after = materialize(after, "placed")
        discard(placed, large)
        placed = after
    groups = with_dense_id(placed.select("piece").distinct(), ["piece"], "portfolio")
    rows = placed.join(groups, "piece").join(originals, "component")
    return rows.select("nodeid", F.col("orig_id").cast("int").alias("orig_id"), F.col("portfolio").cast("int").alias("portfolio"))
