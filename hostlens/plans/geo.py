"""P7 point decoding, M1 map frame, M2 traceability gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostlens.functions.wkb import has_coordinates, st_point, with_point_coords
from hostlens.operators import geo, places
from hostlens.plans.common import guarded, oracle, session
from hostlens.plans.registry import query
from hostlens.sources.tables import fingerprint, landed, read_table


@query("point_coordinates", """
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat
FROM embeddings
""")
def point_coordinates(spark, sf_dir):
    # encode the first two entries as WKB (both byte orders, with and without
    # an SRID), then decode with the column expressions
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    little = F.col("vec_id") % 2 == 0
    g = e.select("vec_id", F.when(F.col("vec_id") % 3 == 0, st_point(x, y, little, srid=4326))
                 .otherwise(st_point(x, y, little)).alias("g"))
    return with_point_coords(g, "g").select("vec_id", "lon", "lat")


@query("map_points", oracle("""
SELECT lon_src AS lon, lat_src AS lat, COALESCE(primary_id, secondary_id) AS sample_id,
       VIRUS_SPECIES AS species, HOST_TAX_NAME AS host, COUNTRY AS country
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#1%'
  AND lon_src IS NOT NULL AND lat_src IS NOT NULL AND COALESCE(primary_id, secondary_id) IS NOT NULL
""", "host"))
def map_points(spark, sf_dir):
    s = session(spark, sf_dir)
    return geo.map_frame(s.host.filter(F.col("VIRUS_FAMILY").ilike("%brand#1%")))


@query("map_points_sql", oracle("""
SELECT lon_src AS lon, lat_src AS lat, COALESCE(primary_id, secondary_id) AS sample_id, VIRUS_SPECIES AS species
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#1%' AND lon_src IS NOT NULL AND lat_src IS NOT NULL
""", "host"))
def map_points_sql(spark, sf_dir):
    return guarded(spark, sf_dir, """
SELECT ST_X(geometry) AS lon, ST_Y(geometry) AS lat, COALESCE(primary_id, secondary_id) AS sample_id, VIRUS_SPECIES AS species
FROM host
WHERE VIRUS_FAMILY ILIKE '%brand#1%' AND ST_X(geometry) IS NOT NULL AND ST_Y(geometry) IS NOT NULL""")


@query("traceability_gate", oracle("""
SELECT VIRUS_FAMILY, COUNT(*) AS n_points,
       COUNT(*) FILTER (WHERE COALESCE(primary_id, secondary_id) IS NULL) AS n_missing,
       CASE WHEN COUNT(*) FILTER (WHERE COALESCE(primary_id, secondary_id) IS NULL) > 0
            THEN 'missing_sample_id' ELSE 'ok' END AS verdict
FROM host
WHERE lon_src IS NOT NULL AND lat_src IS NOT NULL
GROUP BY VIRUS_FAMILY
""", "host"))
def traceability_gate(spark, sf_dir):
    s = session(spark, sf_dir)
    frame = s.host.filter(has_coordinates(F.col("geometry"))).select("VIRUS_FAMILY", geo.sample_id().alias("sample_id"))
    return geo.traceability(frame, ["VIRUS_FAMILY"])


def landed_points(spark, sf_dir) -> str:
    """Path of the observations by place."""
    s = session(spark, sf_dir)
    name = f"points-{fingerprint(spark, sf_dir, ('lineitem', 'part', 'supplier', 'nation'), 'cells-v1')}"
    return landed(spark, name, lambda at: places.land_points(
        s.host.select("obs_order", "obs_line", "geometry", "primary_id", "secondary_id", "VIRUS_SPECIES"), at))


@query("map_box", oracle("""
SELECT obs_order, obs_line, lon_src AS lon, lat_src AS lat, COALESCE(primary_id, secondary_id) AS sample_id, VIRUS_SPECIES AS species
FROM host
WHERE lon_src BETWEEN 10 AND 45 AND lat_src BETWEEN 30 AND 55
""", "host"))
def map_box(spark, sf_dir):
    path = landed_points(spark, sf_dir)
    return places.in_box(spark.read.parquet(path), 10, 30, 45, 55).select(
        "obs_order", "obs_line", "lon", "lat", geo.sample_id().alias("sample_id"), F.col("VIRUS_SPECIES").alias("species"))
