"""Road download: an area's roads from public map servers, cut at junctions into edges."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.client import HTTPException

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfabric.config import area_bounds

# Servers in the order tried, seconds allowed, areas that are asked for by name first.
SERVERS = ("https://overpass-api.de/api", "https://overpass.kumi.systems/api", "https://maps.mail.ru/osm/tools/overpass/api")
TIMEOUT = 90
PLACES = {"hazaribagh_full": "Hazaribagh, Jharkhand, India"}

#: Classes of roads for cars.
DRIVABLE = "motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|road"

#: Takes a server's address, a question and seconds, returns the answer; OSError, HTTPException or ValueError if there is none.
Fetch = Callable[[str, str, int], str]

ANSWER = "elements array<struct<type:string,id:long,nodes:array<long>,geometry:array<struct<lon:double,lat:double>>>>"


def post(server: str, question: str, seconds: int) -> str:
    """Ask a server over HTTP."""
    from urllib.parse import urlencode
    from urllib.request import urlopen

    with urlopen(f"{server}/interpreter", urlencode({"data": question}).encode(), timeout=seconds) as answer:
        return answer.read().decode()


def questions(area: str) -> list[str]:
    """What a server is asked for an area, in order: by the place's name where it has one, then by its bounds."""
    north, south, east, west = area_bounds(area)
    head, kind = f"[out:json][timeout:{TIMEOUT}];", f'["highway"~"^({DRIVABLE})(_link)?$"]'
    named = [f'{head}area["name"="{PLACES[area].split(",")[0]}"]->.a;way(area.a){kind};out body geom;'] if area in PLACES else []
    return [*named, f"{head}way({south},{west},{north},{east}){kind};out body geom;"]


def download(area: str, fetch: Fetch = post) -> str:
    """The first answer that holds anything; RuntimeError if no server gives one, ValueError for an unknown area."""
    asked, problem = questions(area), "no roads"
    for server in SERVERS:
        for question in asked:
            try:
                answer = fetch(server, question, TIMEOUT)
                if json.loads(answer)["elements"]:
                    return answer
            except (OSError, HTTPException, ValueError, KeyError, TypeError) as error:
                problem = str(error) or type(error).__name__
    raise RuntimeError(f"no server gave the roads of {area}: {problem}")


def cut_ways(ways: DataFrame) -> DataFrame:
    """Edges (img_id, u, v, geometry) of ways (id, nodes, geometry), cut at their ends and where ways meet.

    A way listed twice counts once; ways without two places, or with other numbers of nodes and places, are left out.
    """
    sound = ways.where((F.size("nodes") > 1) & (F.size("nodes") == F.size("geometry"))).dropDuplicates(["id"])
    places = sound.select("id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("at", "node"))
    is_end = (F.col("at") == 0) | (F.col("at") == F.col("n") - 1)
    met = places.groupBy("node").agg(F.count(F.lit(1)).alias("uses"), F.max(is_end).alias("ends")).where("uses > 1 or ends").select("node")
    cuts = places.join(met, "node").groupBy("id").agg(F.array_sort(F.collect_list("at")).alias("cuts"))  # within one way
    spans = F.arrays_zip(F.expr("slice(cuts, 1, size(cuts) - 1)").alias("lo"), F.expr("slice(cuts, 2, size(cuts) - 1)").alias("hi"))
    parts = sound.join(cuts, "id").withColumn("span", F.explode(spans))
    return parts.select(
        F.lit(0).cast("long").alias("img_id"), F.expr("nodes[span.lo]").alias("u"), F.expr("nodes[span.hi]").alias("v"),
        F.expr("slice(geometry, span.lo + 1, span.hi - span.lo + 1)").alias("geometry"),
    )


def roads_of(spark: SparkSession, answer: str) -> DataFrame:
    """Edges (img_id, u, v, geometry) of a server's answer."""
    parsed = spark.createDataFrame([(answer,)], "answer string").select(F.from_json("answer", ANSWER).alias("a"))
    found = parsed.select(F.explode("a.elements").alias("e")).where("e.type = 'way'")
    return cut_ways(found.select("e.id", "e.nodes", "e.geometry"))


def download_roads(spark: SparkSession, area: str, fetch: Fetch = post) -> DataFrame:
    """Road edges (img_id, u, v, geometry) of a named area. The answer, one area's roads, passes through the driver."""
    return roads_of(spark, download(area, fetch))
