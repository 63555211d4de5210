"""Connected components of a table of links, by alternating star contractions.

A large-star step links every larger neighbour of a node to the smallest node
it knows; a small-star step does so for the smaller ones. Repeated, they turn
each component into a star around its smallest node, in a number of rounds that
grows with the logarithm of the component, whatever its shape. Each round is a
pair of map-side combined aggregates and joins on a staged table; nothing is
collected but one number and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _sum(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on distinct links u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        # neighbours v > u go to the smallest node around u
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # smaller neighbours of u, and u itself, go to the smallest of them
        joined = both.join(low, "u")
        moved = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(
            F.col("e.v").alias("u"), F.col("e.m").alias("v")
        )
    return moved.where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node in a link (u, v)."""
    edges = C.stage(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    before = _sum(edges)
    while True:
        edges = C.stage(_star(_star(edges, True), False), "links")
        now = _sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
