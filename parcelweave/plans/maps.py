"""Districts and maps: layers of areas, their features and labels, and roll-ups of eligibility."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.functions.geo import Conic, hex_bin, hex_centre, hex_corners, ring_geojson
from parcelweave.functions.text import digits_only
from parcelweave.operators.cover import MOST_SIDES, cell_of, cover, held
from parcelweave.operators.polygons import centre_of, geojson, label_of, simplified
from parcelweave.operators.relational import rolled_up, top_per_group, union_distinct, with_dense_id
from parcelweave.shipping import many_tasks, ship
from parcelweave.storage import cut, materialize

#: Edges of the hexagons in feet, by zoom; each half of the one before.
EDGES = {zoom: 4800 / 2 ** (zoom - 10) for zoom in range(10, 17)}
DISTRICTS = {"assem_dist": "assemdist", "coun_dist": "coundist", "stsen_dist": "stsendist", "cong_dist": "congdist"}
NO_ZIP = ("00083",)
#: Sides of shapes, counted in each cell of a shape, that may be broadcast (about 32 bytes each).
MOST_CORNERS = 2_000_000


def measures() -> list[Column]:
    eligible = F.coalesce(F.col("eligible"), F.lit(False))
    return [
        F.coalesce(F.sum("unitsres"), F.lit(0)).cast("int").alias("unitsres"), F.coalesce(F.sum("post_hstpa_rs_units"), F.lit(0)).cast("int").alias("post_hstpa_rs_units"), F.count(F.lit(1)).cast("int").alias("bbls_count"),
        F.max("co_issued").alias("max_co_issued"), F.min("co_issued").alias("min_co_issued"), F.sum(F.when(eligible, F.col("unitsres")).otherwise(0)).cast("int").alias("eligible_units_count"),
        F.sum(eligible.cast("int")).cast("int").alias("eligible_bbls_count"),
    ]


def to_degrees(geometry: Column, projection: Conic = Conic()) -> Column:
    """A geometry in the projection's unit as longitudes and latitudes."""
    def point(p: Column) -> Column:
        lon, lat = projection.inverse(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def district_rollup(rows: DataFrame, key: str, shapes: DataFrame | None = None) -> DataFrame:
    """Eligibility by district; lots without a district are one. ``shapes`` adds the geometry, its centre and GeoJSON."""
    name = DISTRICTS[key]
    out = rolled_up(rows.withColumn(name, F.col(key).cast("int")), name, measures())
    if shapes is None:
        return out
    ship(shapes.sparkSession)
    drawn = shapes.select(F.col(name).cast("int").alias(name), to_degrees(F.col("geom")).alias("geom"))
    drawn = drawn.withColumn("_c", centre_of(F.col("geom"))).select(name, "geom", F.col("_c.x").alias("longitude"), F.col("_c.y").alias("latitude"), geojson(F.col("geom")).alias("geom_json"))
    return out.join(drawn, name, "left")


def hexagons(rows: DataFrame, edges: Mapping[int, float] = EDGES, projection: Conic = Conic()) -> DataFrame:
    """Eligibility by hexagon at every zoom, from one pass: a lot's hexagons are arithmetic."""
    x, y = projection.forward("longitude", "latitude")
    placed = rows.where("longitude IS NOT NULL AND latitude IS NOT NULL").withColumn("_x", x).withColumn("_y", y)

    def bin_of(zoom: int, edge: float) -> Column:
        q, r = hex_bin("_x", "_y", edge)
        return F.struct(F.lit(zoom).alias("zoom_level"), F.lit(float(edge)).alias("edge"), q.alias("q"), r.alias("r"))

    binned = placed.withColumn("_h", F.explode(F.array(*[bin_of(z, e) for z, e in edges.items()])))
    out = binned.groupBy("_h.zoom_level", "_h.edge", "_h.q", "_h.r").agg(*measures())

    def drawn(edge: float) -> Column:
        cx, cy = hex_centre("q", "r", edge)
        return F.struct(cx.alias("x"), cy.alias("y"), hex_corners(cx, cy, edge).alias("ring"))

    shape = F.coalesce(*[F.when(F.col("zoom_level") == z, drawn(e)) for z, e in edges.items()])
    out = out.withColumn("_s", shape)

    def degrees(p: Column) -> Column:
        lon, lat = projection.inverse(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    lon, lat = projection.inverse("_s.x", "_s.y")
    names = [c for c in out.columns if c not in ("zoom_level", "edge", "q", "r", "_s")]
    return out.select("zoom_level", "q", "r", lon.alias("longitude"), lat.alias("latitude"), ring_geojson(F.transform("_s.ring", degrees)).alias("geom_json"), *names)


def located(points: DataFrame, shapes: DataFrame, key: str, most: int = MOST_SIDES) -> DataFrame:
    """Points with the shapes that hold them, as ``contains`` says, through the shapes' quadtree cells.

    ``points`` has ``x`` and ``y``, ``shapes`` has ``key`` and ``geom``, all in one plane.  A point meets the
    cells of a shape once, and is tested against at most ``most`` sides there, or those that meet in one place.
    Points without coordinates are in no shape.
    """
    cells = materialize(cover(shapes, key, most), "cells")
    size = F.pow(F.lit(2.0), -F.col("level"))
    sides = F.coalesce(F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["sides"])), F.lit(0))
    box = [f(F.col(c) * size + add).alias(n) for f, c, n, add in ((F.min, "cx", "x0", 0), (F.max, "cx", "x1", size), (F.min, "cy", "y0", 0), (F.max, "cy", "y1", size))]
    about = cells.agg(F.collect_set("level").alias("levels"), F.sum(sides + 1).alias("n"), *box).first()  # levels are few, as doublings of size
    if not about["levels"]:
        return points.crossJoin(shapes.select(key).limit(0))
    x, y = F.col("x"), F.col("y")
    near = points.where((x >= about["x0"]) & (x < about["x1"]) & (y >= about["y0"]) & (y < about["y1"]))
    near = near.withColumn("_at", F.explode(F.array(*[cell_of(x, y, n) for n in sorted(about["levels"])])))
    own = cells.select(F.struct("level", "cx", "cy").alias("_at"), F.col(key).alias("_key"), "parts")
    found = near.join(F.broadcast(own) if about["n"] <= MOST_CORNERS else own, "_at")
    return found.select("*", "_at.*").where(held(x, y)).select(*[F.col(f"`{c}`") for c in points.columns], F.col("_key").alias(key))


def _layer(rows: DataFrame, kind: str, label: str, value: Column, name: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("typevalue"), F.lit(label).alias("typelabel"), value.cast("string").alias("areavalue"), name.alias("arealabel"), "geom")


def layers(shapes: Mapping[str, DataFrame]) -> DataFrame:
    """Seven kinds of areas as one table."""
    def numbered(table: str, column: str, kind: str, label: str) -> DataFrame:
        return _layer(shapes[table], kind, label, F.col(column), F.concat(F.lit("District "), F.col(column).cast("string")))

    nta, tracts = shapes["nynta2020_25a"], shapes["nyct2020_25a"]
    names = top_per_group(nta, ["cdta2020"], [F.col("cdtaname").asc_nulls_last()])
    names = names.select(F.trim(F.regexp_replace("cdtaname", r"\(CD.*$|\(JIA.*$", "")).alias("cdtaname"), F.concat(F.col("borocode").cast("string"), digits_only("cdta2020")).alias("borocd"))
    boards = shapes["nycd_25a"].select(F.col("borocd").cast("string").alias("borocd"), "geom").join(names, "borocd", "full")
    zips = shapes["zipcodes"].where(~F.col("zipcode").isin(*NO_ZIP))
    return union_distinct(
        numbered("nycc_25a", "coundist", "coun_dist", "City Council District"),
        numbered("nyad_25a", "assemdist", "assem_dist", "State Assembly District"),
        numbered("nyss_25a", "stsendist", "stsen_dist", "State Senate District"),
        _layer(nta, "nta", "Neighborhood", F.col("nta2020"), F.col("ntaname")),
        _layer(boards, "community_dist", "Community District", F.when(F.col("geom").isNotNull(), F.col("borocd")), F.col("cdtaname")),
        _layer(zips, "zipcode", "Zip Code", F.col("zipcode"), F.col("zipcode").cast("string")),
        _layer(tracts, "census_tract", "Census Tract", F.col("boroct2020"), F.concat(F.substring("nta2020", 1, 2), F.lit(" "), F.col("ct2020").cast("string"))),
    )


def features(areas: DataFrame, tolerance: float = 100.0, projection: Conic = Conic()) -> DataFrame:
    """``(typeValue, typeLabel, districts_geojson, labels_geojson)``: simplified areas and points for their labels, ids shared."""
    ship(areas.sparkSession)
    rows = with_dense_id(areas, ["typevalue", F.col("areavalue").asc_nulls_last(), F.col("arealabel").asc_nulls_last()], "id").repartition(many_tasks(areas.sparkSession))
    rows = rows.withColumn("_s", simplified(F.col("geom"), tolerance)).withColumn("_p", label_of(F.col("geom"))).drop("geom")
    rows = cut(rows.withColumn("_d", to_degrees(F.col("_s"), projection)).drop("_s"))  # so that no worker's function is planned inside an aggregate
    rows = cut(rows.withColumn("_g", geojson(F.col("_d"))).drop("_d"))
    lon, lat = projection.inverse("_p.x", "_p.y")
    point = F.when(F.col("_p.x").isNotNull(), F.concat(F.lit('{"type":"Point","coordinates":['), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]}")))
    whole = F.struct(F.col("typevalue").alias("typeValue"), F.col("typelabel").alias("typeLabel"), F.col("areavalue").alias("areaValue"), F.col("arealabel").alias("areaLabel"))

    def feature(shape: Column, properties: Column) -> Column:
        keep = {"ignoreNullFields": "false"}
        return F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), F.to_json(properties, keep), F.lit("}"))

    rows = rows.select("typevalue", "typelabel", "arealabel", "id", feature(F.col("_g"), whole).alias("d"), feature(point, F.struct(F.col("arealabel").alias("areaLabel"))).alias("l"))

    def collection(c: str) -> Column:
        own = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("arealabel", F.lit("￿")).alias("o"), "id", F.col(c).alias("f")))), lambda x: x["f"])
        return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(own, ","), F.lit("]}"))

    return rows.groupBy(F.col("typevalue").alias("typeValue"), F.col("typelabel").alias("typeLabel")).agg(collection("d").alias("districts_geojson"), collection("l").alias("labels_geojson"))


def district_lookup(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("typeValue") == kind).select(F.col("typeValue").alias("value"), F.col("typeLabel").alias("label"), F.col("districts_geojson").alias("districtsData"), F.col("labels_geojson").alias("labelsData"))
