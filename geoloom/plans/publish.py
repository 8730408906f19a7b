"""Layer documents and capability lists for map servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORKSPACE = "catalog"
STORE = "sfdem"  # store name that raster layer documents carry (fixed value)


def publisher_for(native_format: Column) -> Column:
    """Which publisher handles a format; null where none does."""
    return F.when(native_format == "geotiff", "raster").when(
        native_format == "zipped-shapefile", "feature")


def symbolizer_for(is_coverage: Column, dimension: Column) -> Column:
    """First style rule that applies."""
    return (F.when(is_coverage, "raster").when(dimension == 2, "polygon")
            .when(dimension == 1, "line").otherwise("point"))


def _box(bounds: str) -> Column:
    return F.struct(*[F.col(bounds)[f].alias(f.lower()) for f in ("minX", "maxX", "minY", "maxY")])


def _xml(root: str, body: Column) -> Column:
    """Compact XML: the writer's line breaks and indentation are taken out."""
    return F.regexp_replace(F.to_xml(body, {"rowTag": root}), r">\s*\n\s*<", "><")


def _name(value) -> Column:
    return F.struct((value if isinstance(value, Column) else F.lit(value)).alias("name"))


def layer_config(datasets: DataFrame, kind: str, workspace: str = WORKSPACE,
                 store: str = STORE) -> DataFrame:
    """Configuration document per described dataset, `kind` being raster or feature."""
    if kind == "raster":
        srs = F.struct(F.col("native_srid").alias("string"))
        body = F.struct(
            F.col("locator").alias("name"), F.col("locator").alias("nativeName"),
            _name(workspace).alias("namespace"), F.col("name").alias("title"),
            F.lit("Generated from GeoTIFF").alias("description"),
            F.struct(F.array(F.lit("WCS"), F.lit("GeoTIFF"), F.col("name")).alias("string")).alias("keywords"),
            F.col("native_srid").alias("srs"), _box("native_bounds").alias("nativeBoundingBox"),
            _box("latlon_bounds").alias("latLonBoundingBox"),
            F.lit("REPROJECT_TO_DECLARED").alias("projectionPolicy"), F.lit(True).alias("enabled"),
            F.struct(F.struct(F.lit(f"{store}_{store}").alias("_VALUE"), F.lit("dirName").alias("_key"))
                     .alias("entry")).alias("metadata"),
            F.struct(F.lit("coverageStore").alias("_class"), F.lit(store).alias("name")).alias("store"),
            F.lit("GeoTIFF").alias("nativeFormat"),
            F.lit("nearest neighbor").alias("defaultInterpolationMethod"),
            srs.alias("requestSRS"), srs.alias("responseSRS"),
            F.col("locator").alias("nativeCoverageName"))
        root = "coverage"
    elif kind == "feature":
        body = F.struct(
            F.col("locator").alias("name"), F.col("locator").alias("nativeName"),
            F.col("name").alias("title"),
            F.struct(F.array(F.lit("features"), F.col("name")).alias("string")).alias("keywords"),
            F.col("native_srid").alias("nativeCRS"), F.col("native_srid").alias("srs"),
            _box("native_bounds").alias("nativeBoundingBox"),
            _box("latlon_bounds").alias("latLonBoundingBox"),
            F.lit("FORCE_DECLARED").alias("projectionPolicy"), F.lit(True).alias("enabled"),
            F.lit(0).alias("maxFeatures"), F.lit(0).alias("numDecimals"),
            F.lit(False).alias("overridingServiceSRS"), F.lit(False).alias("skipNumberMatched"),
            F.lit(False).alias("circularArcPresent"))
        root = "featureType"
    else:
        raise ValueError(f"unknown layer kind {kind!r}")
    return datasets.filter(publisher_for(F.col("native_format")) == kind).select(
        "locator", _xml(root, body).alias("document"))


def store_config(datasets: DataFrame, workspace: str = WORKSPACE) -> DataFrame:
    """Store document of each raster dataset."""
    body = F.struct(
        F.col("locator").alias("name"), F.col("locator").alias("description"),
        F.lit("GeoTIFF").alias("type"), F.lit(True).alias("enabled"),
        _name(workspace).alias("workspace"),
        F.concat(F.lit("file:data/"), "locator").alias("url"))
    return datasets.filter(publisher_for(F.col("native_format")) == "raster").select(
        "locator", _xml("coverageStore", body).alias("document"))


def wms_layers(live: DataFrame) -> DataFrame:
    """WMS layer entry per live dataset. The native box is written y before x."""
    nat, geo = F.col("native_bounds"), F.col("latlon_bounds")
    return live.select(
        F.col("locator").alias("name"), F.col("name").alias("title"),
        F.array("native_srid", F.lit("CRS:84")).alias("crs"),
        geo["minX"].alias("west"), geo["maxX"].alias("east"),
        geo["minY"].alias("south"), geo["maxY"].alias("north"),
        F.col("native_srid").alias("native_crs"),
        nat["minY"].alias("native_minx"), nat["minX"].alias("native_miny"),
        nat["maxY"].alias("native_maxx"), nat["maxX"].alias("native_maxy"))


def wfs_feature_types(live: DataFrame, workspace: str = WORKSPACE) -> DataFrame:
    geo = F.col("latlon_bounds")
    return live.select(
        F.concat(F.lit(workspace + ":"), "locator").alias("name"), F.col("name").alias("title"),
        F.lit("features, states.zip").alias("keywords"), F.col("native_srid").alias("srs"),
        geo["minX"].alias("minx"), geo["minY"].alias("miny"),
        geo["maxX"].alias("maxx"), geo["maxY"].alias("maxy"))


def capabilities_documents(live: DataFrame, service: str, workspace: str = WORKSPACE) -> DataFrame:
    """The layer list of a capabilities answer, one per dataset: it names that dataset alone."""
    if service == "WMS":
        row = wms_layers(live)
        def box(crs, names):
            return F.struct(crs.alias("_CRS"), *[F.col(c).alias("_" + a) for c, a in zip(
                names, ("minx", "miny", "maxx", "maxy"))])
        body = F.struct(F.struct(
            F.lit(1).alias("_queryable"), F.col("name").alias("Name"), F.col("title").alias("Title"),
            F.col("crs").alias("CRS"),
            F.struct(F.col("west").alias("westBoundLongitude"), F.col("east").alias("eastBoundLongitude"),
                     F.col("south").alias("southBoundLatitude"),
                     F.col("north").alias("northBoundLatitude")).alias("EX_GeographicBoundingBox"),
            F.array(box(F.lit("CRS:84"), ("west", "south", "east", "north")),
                    box(F.col("native_crs"), ("native_minx", "native_miny", "native_maxx", "native_maxy")),
                    ).alias("BoundingBox")).alias("Layer"))
        return row.select(F.col("name").alias("locator"), _xml("Layer", body).alias("document"))
    if service == "WFS":
        row = wfs_feature_types(live, workspace)
        body = F.struct(F.struct(
            F.col("name").alias("Name"), F.col("title").alias("Title"),
            F.col("keywords").alias("Keywords"), F.col("srs").alias("SRS"),
            F.struct(*[F.col(c).alias("_" + c) for c in ("minx", "miny", "maxx", "maxy")])
            .alias("LatLongBoundingBox")).alias("FeatureType"))
        return row.select(F.expr(f"substring(name, {len(workspace) + 2})").alias("locator"),
                          _xml("FeatureTypeList", body).alias("document"))
    raise ValueError(f"unknown service {service!r}")


def answer_kind(service: Column, version: Column, request: Column) -> Column:
    """Which answer a deployments query gets."""
    caps = request == "GetCapabilities"
    kind = (F.when((service == "WMS") & (version == "1.3.0") & caps, "wms_capabilities")
            .when((service == "WFS") & (version == "1.0.0") & caps, "wfs_capabilities"))
    return F.coalesce(kind, F.lit("servers"))
