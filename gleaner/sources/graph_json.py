"""Knowledge graphs in node-link JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "nodes array<struct<id:string,label:string,source_file:string,source_location:string,community:string,file_type:string>>, "
    "links array<struct<source:string,target:string,relation:string,confidence:string,weight:double>>"
)

NODES = "nodes array<struct<id:string,label:string,source_file:string,community:string,ord:bigint>>"


def read_graph(spark: SparkSession, path: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of one graph; malformed files give empty tables."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    nodes = raw.select(F.lit(repo).alias("repo"), F.posexplode("nodes").alias("ord", "n")).select("repo", "ord", "n.*").filter("id is not null")
    edges = raw.select(F.lit(repo).alias("repo"), F.posexplode("links").alias("ord", "e")).select("repo", "ord", "e.*").filter("source is not null and target is not null")
    defaults = {"relation": "related_to", "confidence": "EXTRACTED"}
    return nodes.fillna("", ["source_file", "label"]), edges.fillna(defaults).fillna({"weight": 1.0})


def parsed_nodes(documents: DataFrame) -> DataFrame:
    """The nodes of graph documents that are texts (``repo, document``); malformed ones have none."""
    found = documents.select("repo", F.from_json("document", NODES).alias("g")).select("repo", F.explode("g.nodes").alias("n")).select("repo", "n.*")
    return found.filter("id is not null").fillna("", ["source_file", "label"])


def write_summaries(summaries: DataFrame, folder: str) -> None:
    """Community summaries (``repo, community, summary``) as JSON; the write is committed as a whole or not at all."""
    summaries.select("repo", "community", "summary").write.mode("overwrite").json(folder)


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("repo string, community string, summary string").json(folder)
