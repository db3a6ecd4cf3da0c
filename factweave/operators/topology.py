"""Services and how they are connected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions import scalars as S


def services(files: DataFrame) -> DataFrame:
    """file, service: folders decide; a service of a monolith and an app of the same name are told apart."""
    named = files.select("file").distinct().select("file", S.service_from_path(F.col("file")).alias("service"), S.is_monolith_path(F.col("file")).alias("inside"))
    both = named.where("inside").select("service").intersect(named.where("not inside").select("service")).withColumn("collides", F.lit(True))
    rename = F.when(F.col("collides") & ~F.col("inside"), F.concat("service", F.lit("-app"))).otherwise(F.col("service"))
    return named.join(both, "service", "left").select("file", rename.alias("service"))


def colliding(files: DataFrame) -> DataFrame:
    """Service names that occur inside and outside of monoliths."""
    named = files.select("file").distinct().select(S.service_from_path(F.col("file")).alias("service"), S.is_monolith_path(F.col("file")).alias("inside"))
    return named.where("inside").select("service").intersect(named.where("not inside").select("service"))


def service_entries(points: DataFrame, io: DataFrame, homes: DataFrame) -> DataFrame:
    """Entry points with a path or with events, and their service."""
    has = io.select(F.col("start_fn").alias("fn_name"), F.col("start_file").alias("file")).distinct().withColumn("has_io", F.lit(True))
    rows = points.join(has, ["fn_name", "file"], "left").where("has_io or path is not null")
    return rows.join(homes, "file").drop("has_io")


def route_index(entries: DataFrame) -> DataFrame:
    """path, service of paths that exactly one entry point has."""
    return entries.where("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("service").alias("service")).where("n = 1").select("path", "service")


def longest_prefix(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """path, service of the longest route that the path begins with (routes of more than one character).

    A path gives a row for each length that routes have, so this is an equi-join on text, not a
    comparison of all pairs. The lengths are few: no more than characters in the longest route.
    """
    routes = routes.where(F.length("path") > 1)
    lengths = F.array(*[F.lit(r["n"]) for r in routes.select(F.length("path").alias("n")).distinct().collect()]).cast("array<int>")
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    prefixes = paths.select("path").distinct().select("path", F.explode(F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))).alias("prefix"))
    found = prefixes.join(routes.select(F.col("path").alias("prefix"), "service"), "prefix")
    return found.groupBy("path").agg(F.max_by("service", F.length("prefix")).alias("service"))


def resolve_paths(paths: DataFrame, routes: DataFrame, real: DataFrame) -> DataFrame:
    """path, service: by exact route, else by first segment, else by longest prefix; unresolved paths are left out."""
    asked = paths.select("path").where("path is not null").distinct()
    exact = routes.select("path", F.col("service").alias("by_route"))
    segment = real.select(F.col("service").alias("segment"), F.col("service").alias("by_segment")).distinct()
    rows = (
        asked.join(exact, "path", "left")
        .withColumn("segment", F.split_part("path", F.lit("/"), F.lit(2)))
        .join(segment, "segment", "left")
        .join(longest_prefix(asked, routes).withColumnRenamed("service", "by_prefix"), "path", "left")
    )
    return rows.select("path", F.coalesce("by_route", "by_segment", "by_prefix").alias("service")).where("service is not null")


def topology_http(events: DataFrame, homes: DataFrame, resolved: DataFrame) -> DataFrame:
    """src, dst, medium, key for outgoing requests to another service."""
    out = events.where("medium = 'http_out'").join(homes, "file").select(F.col("service").alias("src"), F.col("key_raw").alias("path"))
    rows = out.join(resolved.withColumnRenamed("service", "dst"), "path").where("src <> dst")
    return rows.select("src", "dst", F.lit("http").alias("medium"), F.col("path").alias("key")).distinct()


def topology_keys(events: DataFrame, symbols: DataFrame, homes: DataFrame, real: DataFrame, has_transport: bool = True) -> DataFrame:
    """src, dst, medium, key: for each kafka or grpc event the first other file with its key, in either direction.

    grpc needs the transport and a key that begins with a capital; a class of that
    name counts as a use of the key. Files come in their order by path.
    """
    known = homes.join(real.select("service").distinct(), "service", "left_semi")
    media = ["kafka", "grpc"] if has_transport else ["kafka"]
    asking = events.where(F.col("medium").isin(*media) & ((F.col("medium") == "kafka") | F.col("key_raw").rlike("^[A-Z]")))
    asking = asking.join(known, "file").select(F.col("service").alias("src"), "medium", F.col("key_raw").alias("key")).distinct()
    uses = events.select("file", F.col("key_raw").alias("key")).unionByName(symbols.where("kind = 'class'").select("file", F.col("name").alias("key"))).distinct()
    # for a key the first file of each service is all that can be chosen
    firsts = uses.join(known, "file").groupBy("key", F.col("service").alias("dst")).agg(F.min("file").alias("file"))
    rows = asking.join(firsts, "key").where("src <> dst")
    return rows.groupBy("src", "medium", "key").agg(F.min_by("dst", "file").alias("dst")).select("src", "dst", "medium", "key")
