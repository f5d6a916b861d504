"""Landlords as a graph: one contact for each building, links by name and by address, portfolios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelweave.functions.text import digits_only, join_words, normal_apartment, plain_upper, squish
from parcelweave.functions.values import object_id, split_evenly
from parcelweave.operators.communities import SIZE_LIMIT, split_components
from parcelweave.operators.relational import numbered, with_dense_id
from parcelweave.plans.links import TOGETHER, address_links, as_singles, block_links, blocks, name_links, spanning_links, street_pairs
from parcelweave.storage import cut, discard, materialize

#: Roles that own, the most telling first; fixed values.
ROLES = ("IndividualOwner", "HeadOfficer", "JointOwner", "CorporateOwner")
ADDRESS = {"housenumber": "businesshousenumber", "streetname": "businessstreetname", "apartment": "businessapartment", "city": "businesscity", "state": "businessstate", "zip": "businesszip"}
LANDLORD = ("name", "bizaddr", "bizhousestreet", "bizapt", "bizzip")


def contacts_to_standardize(contacts: DataFrame, registrations: DataFrame) -> DataFrame:
    """One owner's contact for each bbl: of the registration that ends last, the most telling role, then the first name."""
    parts = {k: F.coalesce(F.upper(F.col(c)), F.lit("")) for k, c in ADDRESS.items()}
    rows = contacts.join(registrations.select("registrationid", "bbl", "lastregistrationdate", "registrationenddate"), "registrationid")
    rows = rows.where(F.col("type").isin(*ROLES) & (F.col("firstname").isNotNull() | F.col("lastname").isNotNull()))
    rows = rows.where(F.length(join_words("businesshousenumber", "businessstreetname")) > 2)
    rows = rows.select("bbl", "registrationid", "lastregistrationdate", "registrationenddate", "type", F.upper(F.concat_ws(" ", "firstname", "lastname")).alias("name"), *[c.alias(k) for k, c in parts.items()]).distinct()
    order = [F.col("registrationenddate").desc_nulls_first(), F.col("lastregistrationdate").desc_nulls_last(), F.array_position(F.array(*map(F.lit, ROLES)), F.col("type")), F.col("name"), *[F.col(k) for k in ADDRESS], F.col("registrationid")]
    one = numbered(rows, ["bbl"], order, "_at").where("_at = 1")
    return one.select("bbl", "registrationid", "name", *[(normal_apartment(k) if k == "apartment" else plain_upper(k)).alias(k) for k in ADDRESS])


def standardize(rows: DataFrame, geocode: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """Business addresses in one form.

    ``geocode`` maps frames of contacts to frames with the same columns, corrected; without one
    the contact's own parts are used.
    """
    if geocode is not None:
        rows = rows.mapInPandas(geocode, rows.schema)
    street = F.concat_ws(" ", "housenumber", "streetname")
    whole = squish(F.concat_ws(" ", "housenumber", "streetname", "apartment"))
    return rows.select("bbl", "registrationid", "name", F.concat(whole, F.lit(", "), F.col("city"), F.lit(" "), F.col("state")).alias("bizaddr"), street.alias("bizhousestreet"), F.col("apartment").alias("bizapt"), F.col("zip").alias("bizzip"))


def landlord_nodes(landlords: DataFrame) -> DataFrame:
    """Identical landlords as one node, with the buildings of each; ids in the order of their values."""
    keys = [*LANDLORD]
    groups = landlords.where("bbl IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list("bbl")).alias("bbls"))
    return with_dense_id(groups, [F.col(k).asc_nulls_first() for k in keys], "nodeid").withColumn("bizaptnum", digits_only("bizapt"))


def _both_orders(rows: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return rows.select(ends.alias("e"), "weight").select("e.*", "weight")


def name_edges(nodes: DataFrame) -> DataFrame:
    """The same name and zip, and a similar street: over 0.9, or over 0.8 with the same apartment number; each pair in both orders."""
    return _both_orders(name_links(as_singles(nodes)))


def address_edges(nodes: DataFrame) -> DataFrame:
    """The same street and zip, and no apartment numbers that differ; each pair in both orders."""
    return _both_orders(address_links(as_singles(nodes)))


def landlord_connections(landlords: DataFrame) -> DataFrame:
    """``nodeid, name, bizaddr, bbls, name_match_info, bizaddr_match_info``; no matches are null."""
    nodes = landlord_nodes(landlords)

    def matches(edges: DataFrame, name: str) -> DataFrame:
        return edges.groupBy(F.col("src").alias("nodeid")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("nodeid"), "weight"))).alias(name))

    rows = nodes.select("nodeid", "name", "bizaddr", "bbls")
    return rows.join(matches(name_edges(nodes), "name_match_info"), "nodeid", "left").join(matches(address_edges(nodes), "bizaddr_match_info"), "nodeid", "left")


def build_graph(connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges; of two edges between a pair that by name stays."""
    nodes = connections.select("nodeid", "name", "bizaddr", "bbls")

    def exploded(info: str, kind: str, at: int) -> DataFrame:
        return connections.select("nodeid", F.explode(info).alias("m")).select(F.least("nodeid", "m.nodeid").alias("src"), F.greatest("nodeid", "m.nodeid").alias("dst"), F.struct(F.lit(at).alias("at"), F.lit(kind).alias("type"), F.col("m.weight").alias("weight")).alias("e"))

    every = exploded("name_match_info", "name", 0).unionByName(exploded("bizaddr_match_info", "bizaddr", 1))
    edges = every.groupBy("src", "dst").agg(F.min("e").alias("e")).select("src", "dst", "e.type", "e.weight")
    return nodes, edges


def parent_nodes(nodes: DataFrame, least: int = 5) -> DataFrame:
    """For each node of a portfolio, the address or else the name that ``least`` or more of its nodes share."""
    def shared(column: str) -> DataFrame:
        return nodes.groupBy("portfolio", column).agg(F.count(F.lit(1)).alias(f"_n_{column}")).where(F.col(f"_n_{column}") >= least)

    out = nodes
    for column in ("bizaddr", "name"):
        out = out.join(shared(column), ["portfolio", column], "left")
    return out.withColumn("parent", F.coalesce(F.when(F.col("_n_bizaddr").isNotNull(), F.col("bizaddr")), F.when(F.col("_n_name").isNotNull(), F.col("name"))))


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(portfolio, graph)``: nodes, with those they share as parents, and edges.

    Where ``nodes`` has blocks of several nodes, ``groups`` names their members, and an edge of a block's
    first node stands for those of all of them; a block's members are linked among each other.
    """
    marked = parent_nodes(nodes)
    owners = marked.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct(F.col("nodeid").cast("string").alias("id"), F.lit("owner").alias("type"), F.struct(F.col("name").alias("value"), "bizaddr", "bbls", "parent").alias("data")))).alias("owners"))

    def parents(column: str, kind: str) -> DataFrame:
        return marked.where(F.col(f"_n_{column}").isNotNull()).groupBy("portfolio", F.col(column).alias("value"), F.lit(kind).alias("type")).agg(F.first(f"_n_{column}").alias("n"))

    shared = parents("name", "name").unionByName(parents("bizaddr", "bizaddr")).groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "type", "value"))).alias("shared"))
    inside = edges.where("src <> dst").join(nodes.select(F.col("nodeid").alias("src"), "portfolio"), "src").join(nodes.select(F.col("nodeid").alias("dst"), F.col("portfolio").alias("_p")), "dst").where("portfolio = _p")
    links = inside.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "type", "weight"))).alias("links"))
    rows = owners.join(shared, "portfolio", "left").join(links, "portfolio", "left")
    document = [F.struct("owners", F.transform(F.coalesce("shared", F.array().cast("array<struct<less:bigint,type:string,value:string>>")), lambda s: F.struct(s["value"].alias("id"), s["type"].alias("type"))).alias("parents")).alias("nodes"), F.coalesce("links", F.array().cast("array<struct<source:string,target:string,type:string,weight:double>>")).alias("edges")]
    plain = F.to_json(F.struct(*document), {"ignoreNullFields": "false"})
    if "block" not in nodes.columns:
        return rows.select("portfolio", plain.alias("graph"))
    members = nodes.where("NOT single").groupBy("portfolio", "block").agg(F.array_sort(F.collect_list(F.col("nodeid").cast("string"))).alias("members"))
    groups = members.groupBy("portfolio").agg(F.array_sort(F.collect_list(F.struct(F.col("block").cast("string").alias("id"), "members"))).alias("groups"))
    rows = rows.join(groups, "portfolio", "left")
    return rows.select("portfolio", F.when(F.col("groups").isNull(), plain).otherwise(F.to_json(F.struct(*document, "groups"), {"ignoreNullFields": "false"})).alias("graph"))


def build_landlord_portfolios(landlords: DataFrame, limit: int = SIZE_LIMIT, resolution: float = 0.1, seed: int = 0, together: int = TOGETHER) -> DataFrame:
    """``(orig_id, bbls, landlord_names, graph, relatedportfoliosbbls)``: components, split where they hold too many buildings.

    Components need a few links for each landlord.  Links are listed by pair but in classes of more than ``together``
    landlords, who are all linked and one node of the graph (``blocks``), so that there are at most
    about ``together`` of them for each landlord and class.
    """
    nodes = materialize(blocks(landlord_nodes(landlords), together), "landlords")
    pairs = materialize(street_pairs(nodes), "streets")
    edges = materialize(block_links(nodes, pairs), "links")
    units = nodes.groupBy(F.col("block").alias("nodeid")).agg(F.sum(F.size("bbls")).alias("size"))
    spanning = spanning_links(nodes.drop("nodeid").withColumn("nodeid", F.col("block")), pairs)
    parts = split_components(units, edges, limit, resolution, seed, spanning)
    placed = cut(nodes.join(parts.withColumnRenamed("nodeid", "block"), "block"))
    listed = placed.groupBy("portfolio", "orig_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bbls")))).alias("bbls"), F.array_sort(F.collect_set("name")).alias("landlord_names"))
    made = cut(related_portfolios(listed.join(graph_documents(placed, edges), "portfolio")).select("orig_id", "bbls", "landlord_names", "graph", "relatedportfoliosbbls"))
    discard(nodes, pairs, edges)
    return made


def related_portfolios(portfolios: DataFrame) -> DataFrame:
    """The first building of each other portfolio of the same original component."""
    own = F.get("bbls", F.lit(0))
    return portfolios.withColumn("relatedportfoliosbbls", F.array_remove(F.array_sort(F.collect_list(own).over(Window.partitionBy("orig_id"))), own))


def landlord_index_records(portfolios: DataFrame, id_col: str = "bbls", name_col: str = "landlord_names", most: int = 2000) -> DataFrame:
    """Search records: a portfolio's sorted names, in parts if they are long, with a stable id."""
    names = F.array_sort(F.split(F.array_join(name_col, ", "), ", "))
    rows = portfolios.where(F.get(id_col, F.lit(0)).isNotNull()).select(F.array_min(id_col).alias("portfolio_bbl"), names.alias("names"))
    parts = F.greatest(F.lit(1), F.ceil(F.length(F.array_join("names", ", ")) / float(most)).cast("int"))
    rows = rows.select("portfolio_bbl", F.explode(split_evenly("names", parts)).alias("part")).select("portfolio_bbl", F.array_join("part", ", ").alias("landlord_names"))
    return rows.select(object_id({"portfolio_bbl": F.col("portfolio_bbl"), "landlord_names": F.col("landlord_names")}).alias("objectID"), "portfolio_bbl", "landlord_names")


def corpname_index_records(registrations: DataFrame) -> DataFrame:
    """Search records: each corporation's name with its smallest building."""
    rows = registrations.select("bbl", F.explode("corpnames").alias("landlord_names")).where("bbl IS NOT NULL").groupBy("landlord_names").agg(F.min("bbl").alias("portfolio_bbl"))
    return rows.select(object_id({"portfolio_bbl": F.col("portfolio_bbl"), "landlord_names": F.col("landlord_names")}).alias("objectID"), "portfolio_bbl", "landlord_names")
