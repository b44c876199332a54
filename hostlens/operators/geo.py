"""Traceable sample ids, coordinates and the map gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.wkb import with_point_coords

MISSING_COLUMN_MSG = "Error: a map frame needs the column sample_id, or its points lead nowhere."
MISSING_VALUE_MSG = "Error: sample_id is missing for some points. geo.sample_id() takes the second identifier where the first is null."


def sample_id(primary: str = "primary_id", secondary: str = "secondary_id") -> Column:
    """BioSample id, else the GenBank accession."""
    return F.coalesce(F.col(primary), F.col(secondary))


def map_frame(host: DataFrame, species: str = "VIRUS_SPECIES", host_col: str = "HOST_TAX_NAME",
              country: str = "COUNTRY") -> DataFrame:
    """M1: lon, lat, sample_id, species, host, country; rows missing any of the
    first three are dropped (P8).  Coordinates come from the WKB column (P7)."""
    pts = with_point_coords(host, "geometry").select(
        "lon", "lat",
        sample_id().alias("sample_id"),
        F.col(species).alias("species"),
        F.col(host_col).alias("host"),
        F.col(country).alias("country"),
    )
    return pts.dropna(how="any", subset=["lon", "lat", "sample_id"])


def traceability(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M2 as a table job: per map (``by``), the point count, the number of
    points without a sample id, and the verdict.  One partial+final aggregate."""
    if "sample_id" not in frame.columns:
        raise ValueError(MISSING_COLUMN_MSG)
    sid = F.col("sample_id")
    bad = sid.isNull()
    if dict(frame.dtypes)["sample_id"] in ("double", "float"):
        bad = bad | F.isnan(sid)
    g = frame.groupBy(*(by or []))
    out = g.agg(F.count(F.lit(1)).alias("n_points"), F.count_if(bad).alias("n_missing"))
    return out.withColumn(
        "verdict", F.when(F.col("n_missing") > 0, F.lit("missing_sample_id")).otherwise(F.lit("ok")))


def check_traceability(frame: DataFrame) -> str | None:
    """M2 for one frame: the two distinct errors, else None."""
    if "sample_id" not in frame.columns:
        return MISSING_COLUMN_MSG
    row = traceability(frame).first()
    if row is not None and row["n_missing"] > 0:
        return MISSING_VALUE_MSG
    return None
