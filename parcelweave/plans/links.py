"""Links between landlords by classes: those who share an address and apartment number, or a name and street.

Members of a class are all linked with each other, so that components follow from one link for each
member, and weights from counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.trigram import set_similarity, trigrams
from parcelweave.operators.components import connected_components
from parcelweave.operators.similar import similar_pairs
from parcelweave.storage import cut

#: A class of more landlords than this is one node where links are listed by pair.
TOGETHER = 300
PLACE, OWNER = ["bizhousestreet", "bizzip"], ["name", "bizzip", "street"]
ALIKE, SAME = 0.8, 0.9


def _real(x: float) -> Column:
    return F.lit(x).cast("float")


def _at(nodes: DataFrame) -> DataFrame:
    """Nodes with a whole address; ``unit`` is the apartment's number, ``?`` if it is unknown, which only those without one are linked to."""
    known = nodes.where(F.col("bizhousestreet").isNotNull() & F.col("bizzip").isNotNull())
    return known.withColumn("unit", F.coalesce("bizaptnum", F.lit("?")))


def _named(nodes: DataFrame) -> DataFrame:
    """Nodes with a name, a zip and a street that has letters or digits; a street without any is like no other."""
    rows = nodes.withColumn("street", F.col("bizhousestreet")).where(F.col("name").isNotNull() & F.col("bizzip").isNotNull())
    return rows.where(F.size(trigrams("street")) > 0)


def street_pairs(nodes: DataFrame) -> DataFrame:
    """``(name, bizzip, street, other, sim)``: different streets of one name and zip that are alike, ``street`` the smaller; only streets that share a rare trigram are compared."""
    known = _named(nodes).select(*OWNER).distinct().withColumn("g", trigrams("street"))
    found = similar_pairs(known, "street", "g", ALIKE, OWNER[:2])
    rows = found.select(*OWNER[:2], F.col("a").alias("street"), F.col("b").alias("other"), F.col("s").cast("float").alias("sim"))
    return rows.where(F.col("sim") > _real(ALIKE))


def spanning_links(nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` with the components of all links by name and address, a few for each node.

    Each node leads to the first of its address that has no apartment, who is linked with all there,
    or else to the first with its apartment number; and to the first of its name and street.
    """
    at = _at(nodes)
    heads = at.groupBy(*PLACE, "unit").agg(F.min("nodeid").alias("head"))
    none = heads.where(F.col("unit") == "").select(*PLACE, F.col("head").alias("none"))
    to = F.coalesce("none", F.when(F.col("unit") != "?", F.col("head")))
    by_address = at.join(heads.join(none, PLACE, "left").select(*PLACE, "unit", to.alias("dst")), [*PLACE, "unit"]).select(F.col("nodeid").alias("src"), "dst")
    named = _named(nodes)
    first = named.groupBy(*OWNER).agg(F.min("nodeid").alias("head"))
    by_name = named.join(first, OWNER).select(F.col("nodeid").alias("src"), F.col("head").alias("dst"))
    pairs = street_pairs(nodes) if pairs is None else pairs
    numbers = named.where(F.col("bizaptnum").isNotNull()).select(*OWNER, "bizaptnum").distinct()
    weak = pairs.where(F.col("sim") <= _real(SAME)).join(numbers, OWNER).join(numbers.withColumnRenamed("street", "other"), [*OWNER[:2], "other", "bizaptnum"])
    linked = pairs.where(F.col("sim") > _real(SAME)).select(*OWNER, "other").unionByName(weak.select(*OWNER, "other").distinct())
    across = linked.join(first.withColumnRenamed("head", "src"), OWNER).join(first.toDF(*OWNER[:2], "other", "dst"), [*OWNER[:2], "other"])
    return by_address.unionByName(by_name).unionByName(across.select("src", "dst")).where("dst IS NOT NULL AND src <> dst")


def as_singles(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.col("nodeid")).withColumn("single", F.lit(True))


def blocks(nodes: DataFrame, most: int = TOGETHER) -> DataFrame:
    """``nodes`` with ``block``: the smallest of the nodes that crowded classes join it with, or itself, and whether it is ``single``."""
    def crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
        crowds = rows.groupBy(*keys).agg(F.min("nodeid").alias("dst"), F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        return rows.join(crowds, keys).select(F.col("nodeid").alias("src"), "dst")

    links = cut(crowded(_at(nodes).where("unit <> '?'"), [*PLACE, "unit"]).unionByName(crowded(_named(nodes), OWNER)))
    if links.isEmpty():
        return as_singles(nodes)
    found = connected_components(links).select(F.col("node").alias("nodeid"), F.col("component").alias("block"))
    return nodes.join(found, "nodeid", "left").withColumn("single", F.col("block").isNull()).withColumn("block", F.coalesce("block", "nodeid"))


def _members(rows: DataFrame, keys: list[str], about: str) -> DataFrame:
    """The blocks of each class, how many nodes each has there, and what a single one has in ``about``."""
    return rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.first(F.when(F.col("single"), F.col(about))).alias("about"))


def _inside(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of blocks of one class, and each block with itself: ``x``, ``y``, their ``about`` and how many pairs of nodes these are."""
    x, y = members.select(*keys, F.col("block").alias("x"), F.col("n").alias("nx"), F.col("about").alias("ax")), members.select(*keys, F.col("block").alias("y"), F.col("n").alias("ny"), F.col("about").alias("ay"))
    other = x.join(y, keys).where("x < y").withColumn("pairs", F.col("nx") * F.col("ny"))
    own = members.where("n > 1").select(*keys, F.col("block").alias("x"), F.col("block").alias("y"), F.col("about").alias("ax"), F.col("about").alias("ay"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return other.select(*keys, "x", "y", "ax", "ay", "pairs").unionByName(own)


def _across(left: DataFrame, right: DataFrame, keys: list[str], *more: str) -> DataFrame:
    x, y = left.withColumnsRenamed({"block": "x", "n": "nx", "about": "ax"}), right.withColumnsRenamed({"block": "y", "n": "ny", "about": "ay"})
    return x.join(y, keys).select(*more, "x", "y", "ax", "ay", (F.col("nx") * F.col("ny")).alias("pairs"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum("pairs").alias("pairs"), F.sum("weight").alias("weight"))


def address_links(nodes: DataFrame) -> DataFrame:
    """``(src, dst, pairs, weight)`` between the blocks of ``nodes``, ``src <= dst``: the same street and zip, and no apartment numbers that differ.

    A pair of nodes weighs 2, and between two single nodes the similarity of their names besides.
    """
    at = _members(_at(nodes).withColumn("grams", trigrams("name")), [*PLACE, "unit"], "grams")
    none = at.where("unit = ''").drop("unit")
    rows = _inside(at.where("unit <> '?'"), [*PLACE, "unit"]).select("x", "y", "ax", "ay", "pairs").unionByName(_across(none, at.where("unit <> ''").drop("unit"), PLACE))
    return _summed(rows.withColumn("weight", 2 * F.col("pairs") + F.coalesce(set_similarity("ax", "ay").cast("double"), F.lit(0.0))))


def name_links(nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(src, dst, pairs, weight)`` between the blocks of ``nodes``, ``src <= dst``: the same name and zip, and a street that is similar by over 0.9, or by over 0.8 with the same apartment number.

    A pair of nodes weighs 1 more than that similarity, and two single nodes with the same apartment 0.5 besides.
    """
    named = _named(nodes)
    pairs = cut(street_pairs(nodes)) if pairs is None else pairs
    others, strong, weak = [*OWNER[:2], "other"], pairs.where(F.col("sim") > _real(SAME)), pairs.where(F.col("sim") <= _real(SAME))
    whole, numbered = _members(named, OWNER, "bizapt"), _members(named.where("bizaptnum IS NOT NULL"), [*OWNER, "bizaptnum"], "bizapt")
    rows = _inside(whole, OWNER).withColumn("sim", _real(1.0)).select("sim", "x", "y", "ax", "ay", "pairs")
    rows = rows.unionByName(_across(whole.join(strong, OWNER).drop("street"), whole.withColumnRenamed("street", "other"), others, "sim"))
    rows = rows.unionByName(_across(numbered.join(weak, OWNER).drop("street"), numbered.withColumnRenamed("street", "other"), [*others, "bizaptnum"], "sim"))
    same = F.when(F.coalesce(F.col("ax") == F.col("ay"), F.lit(False)), F.lit(0.5)).otherwise(0.0)
    return _summed(rows.withColumn("weight", F.col("pairs") * (F.col("sim").cast("double") + 1) + same))


def block_links(nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(src, dst, type, weight, pairs)`` between blocks, of the type that joins more of their nodes, by name if both join as many."""
    def kind(rows: DataFrame, name: str, at: int) -> DataFrame:
        return rows.select("src", "dst", F.struct((-F.col("pairs")).alias("less"), F.lit(at).alias("at"), F.lit(name).alias("type"), "weight").alias("e"))

    every = kind(name_links(nodes, pairs), "name", 0).unionByName(kind(address_links(nodes), "bizaddr", 1))
    return every.groupBy("src", "dst").agg(F.min("e").alias("e")).select("src", "dst", "e.type", "e.weight", (-F.col("e.less")).alias("pairs"))
