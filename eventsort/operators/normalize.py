"""Raw metadata (a map of text) to registry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that hold a capture time, best first; the last is not embedded.
TIME_TAGS = ("DateTimeOriginal", "CreateDate", "MediaCreateDate", "TrackCreateDate", "FileModifyDate")


def tag(metadata: Column, name: str) -> Column:
    return F.try_element_at(metadata, F.lit(name))


def first_nonempty(metadata: Column, tags: tuple[str, ...] = TIME_TAGS) -> Column:
    """struct(value, source) of the first tag that is there and not empty."""
    found = [F.when((tag(metadata, t) != "") & (tag(metadata, t) != "[]"), F.struct(tag(metadata, t).alias("value"), F.lit(t).alias("source"))) for t in tags]
    return F.coalesce(*found)


def camera(metadata: Column) -> Column:
    make, model = tag(metadata, "Make"), tag(metadata, "Model")
    truthy = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(truthy(make) & truthy(model), F.trim(F.concat_ws(" ", make, model))).when(truthy(make), make).otherwise(model)


def gps(metadata: Column) -> Column:
    latitude, longitude = (tag(metadata, t).try_cast("double") for t in ("GPSLatitude", "GPSLongitude"))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(latitude.alias("latitude"), longitude.alias("longitude")))


def normalize(files: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Adds exif, metadata_quality and raw_exif_keys, and takes the map away."""
    m = F.col(metadata)
    time = first_nonempty(m)
    embedded = F.coalesce(time["source"] != "FileModifyDate", F.lit(False))
    exif = F.struct(time["value"].alias("created_at"), time["source"].alias("created_at_source"), embedded.alias("created_at_is_embedded"), camera(m).alias("camera"), gps(m).alias("gps"))
    quality = F.struct(embedded.alias("has_embedded_capture_time"), camera(m).isNotNull().alias("has_camera_metadata"), gps(m).isNotNull().alias("has_gps"))
    return files.withColumns({"exif": exif, "metadata_quality": quality, "raw_exif_keys": F.array_sort(F.map_keys(m))}).drop(metadata)
