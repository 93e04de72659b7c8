"""Map elements: documents of nodes, ways and relations that refer to each other by ordered lists of ids.

A way names its nodes, a relation its members, or carries their geometry inline. References are resolved by joins that keep the
place in the list: into vertices of ways, and into the bags of edges that areas are made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINT = "struct<lat:double,lon:double>"
MEMBER = f"struct<type:string,ref:bigint,role:string,lat:double,lon:double,geometry:array<{POINT}>>"
ELEMENT = f"struct<type:string,id:bigint,lat:double,lon:double,center:{POINT},nodes:array<bigint>,geometry:array<{POINT}>,members:array<{MEMBER}>,tags:map<string,string>>"
#: Which of several elements at one place is meant, the first before the others.
PREFERENCE = ("way", "relation", "node")


def read_elements(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """The elements of all documents, each with an ``elements`` list: one document a line, or one a file (which can't be split)."""
    documents = spark.read.schema(f"elements array<{ELEMENT}>").option("multiLine", whole_files).json(path)
    return documents.select(F.explode("elements").alias("e")).select("e.*")


def position() -> tuple[Column, Column]:
    """Latitude and longitude of an element: its centre, else its own."""
    return F.coalesce("center.lat", "lat"), F.coalesce("center.lon", "lon")


def places(elements: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """type, id, ``lat``, ``lon``, ``rank`` and tags of the elements that have a place inside; ways rank before relations and these before nodes."""
    lat, lon = position()
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("type")) - 1
    rows = elements.select("type", "id", lat.alias("lat"), lon.alias("lon"), rank.alias("rank"), "tags")
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def nodes(elements: DataFrame) -> DataFrame:
    """node_id, lat, lon; of a node in several documents one row."""
    return elements.where("type = 'node' and lat is not null").groupBy(F.col("id").alias("node_id")).agg(F.min(F.struct("lat", "lon")).alias("p")).select("node_id", "p.lat", "p.lon")


def ways(elements: DataFrame) -> DataFrame:
    """way_id, nodes, geometry; of a way in several documents one row, with geometry if any has it."""
    one = elements.where("type = 'way'").groupBy(F.col("id").alias("way_id")).agg(F.max("geometry").alias("geometry"), F.max("nodes").alias("nodes"))
    return one.select("way_id", "nodes", "geometry")


def way_vertices(elements: DataFrame) -> DataFrame:
    """way_id, i, lat, lon: the vertices of each way in order. i is the place in the way's list; places whose node is not there are left out."""
    every = ways(elements)
    inline = every.where("geometry is not null").select("way_id", F.posexplode("geometry").alias("i", "p")).where("p.lat is not null").select("way_id", "i", "p.lat", "p.lon")
    by_id = every.where("geometry is null").select("way_id", F.posexplode("nodes").alias("i", "node_id")).join(nodes(elements), "node_id").select("way_id", "i", "lat", "lon")
    return inline.unionByName(by_id)


def way_edges(vertices: DataFrame) -> DataFrame:
    """way_id, i, a_lat, a_lon, b_lat, b_lon of neighbours in a way; none over a place that is left out."""
    along = Window.partitionBy("way_id").orderBy("i")
    rows = vertices.withColumns({"_i": F.lag("i").over(along), "a_lat": F.lag("lat").over(along), "a_lon": F.lag("lon").over(along)})
    return rows.where("_i = i - 1").select("way_id", "i", "a_lat", "a_lon", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))


def members(elements: DataFrame) -> DataFrame:
    """area_id, member (its place in the relation), type, ref, role, lat, lon, geometry."""
    return elements.where("type = 'relation'").select(F.col("id").alias("area_id"), F.posexplode("members").alias("member", "m")).select("area_id", "member", "m.*")


def area_edges(elements: DataFrame) -> DataFrame:
    """area_id, member, i, a_lat, a_lon, b_lat, b_lon: the edges of each relation's outer and inner ways, inline or by their ids, for ``areas``."""
    borders = members(elements).where("type = 'way' and role in ('outer', 'inner')")
    drawn = borders.where("geometry is not null").select("area_id", "member", F.posexplode("geometry").alias("i", "p"))
    along = Window.partitionBy("area_id", "member").orderBy("i")
    drawn = drawn.select("area_id", "member", "i", F.lag("p.lat").over(along).alias("a_lat"), F.lag("p.lon").over(along).alias("a_lon"), F.col("p.lat").alias("b_lat"), F.col("p.lon").alias("b_lon"))
    by_id = borders.where("geometry is null").select("area_id", "member", F.col("ref").alias("way_id")).join(way_edges(way_vertices(elements)), "way_id").drop("way_id")
    return drawn.where("a_lat is not null and b_lat is not null").unionByName(by_id)


def area_labels(elements: DataFrame) -> DataFrame:
    """area_id, role, l_lat, l_lon: the last label node of each relation, else its first admin_centre; placed inline or by its id."""
    named = members(elements).where("type = 'node' and role in ('label', 'admin_centre')").select("area_id", "member", "ref", "role", F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))
    known = nodes(elements).withColumnRenamed("node_id", "ref")
    placed = named.join(known, "ref", "left").withColumns({"l_lat": F.coalesce("own_lat", "lat"), "l_lon": F.coalesce("own_lon", "lon")}).where("l_lat is not null")
    first = F.struct((F.col("role") != "label").alias("later"), F.when(F.col("role") == "label", -F.col("member")).otherwise(F.col("member")).alias("place"), "role", "l_lat", "l_lon")
    return placed.groupBy("area_id").agg(F.min(first).alias("b")).select("area_id", "b.role", "b.l_lat", "b.l_lon")
