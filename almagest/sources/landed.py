"""Readers for landed source files.

Payloads that the reference fetches over HTTP are read here as files that
have already landed in a folder; every reader is a DataFrame job over the
whole folder (one task per file split), producing rows of the canonical
``time_series`` / ``microdata`` shapes. Polymorphic JSON (list-or-dict
payloads) is resolved with ``get_json_object`` / ``from_json`` on the file
text, never with driver-side parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.functions import period as P
from almagest.functions import scalars as X

DEFAULT_GEO = "ES709"
DEFAULT_MEASURE = "ABSOLUTE"

# Indicator name corrections applied to indicator CSV files.
NAME_FIXES = {
    "alojatur_habitaciones_ocupacion": "alojatur_ocupacion",
    "alojatur_plazas_ocupacion": "alojatur_ocupacion_plazas",
    "alojatur_tarifa_adr": "alojatur_adr",
    "alojatur_estancias_medias": "alojatur_estancia_media",
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _fixed(name: Column) -> Column:
    return F.coalesce(F.element_at(_map(NAME_FIXES), name), name) if NAME_FIXES else name


def _file_stem(path: Column, suffix_re: str = r"\.[^./]+$") -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), suffix_re, "")


def _named(path: Column, name_re: str | None) -> Column:
    """What a file is about: its stem, or the first group of ``name_re`` in
    its path (say, a folder)."""
    return F.lower(F.regexp_extract(path, name_re, 1) if name_re else _file_stem(path))


def _text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files as (path, text) rows, one row per file."""
    return (spark.read.option("wholetext", True).text(pattern)
                 .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


#: A header table up to this size is broadcast.
SMALL_HEADERS = 8 << 20


def _csv_lines(spark: SparkSession, pattern: str | list[str], encoding: str) -> DataFrame:
    """_path, line of all CSV files, with their place in the scan."""
    line = F.decode(F.col("value").cast("binary"), encoding) if encoding.upper() != "UTF-8" else F.col("value")
    return spark.read.text(pattern).select(F.col("_metadata.file_path").alias("_path"), line.alias("line"),
                                           F.col("_metadata.file_block_start").alias("_block"),
                                           F.monotonically_increasing_id().alias("_at")).filter(F.trim("line") != "")


def csv_headers(spark: SparkSession, pattern: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """_path, header, names: the first line of every file, folded map-side, and
    its column names. A repeated or empty name gets its position."""
    first = (_csv_lines(spark, pattern, encoding).filter("_block = 0").groupBy("_path")
             .agg(F.min_by("line", "_at").alias("header")))
    width = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    raw = F.transform(_csv_fields(F.regexp_replace("header", "^\ufeff", ""), width), lambda n, i: F.struct(F.trim(n).alias("n"), i.alias("i")))
    raw = F.slice(raw, 1, F.size(F.split("header", ",")))
    named = F.transform(raw, lambda x: F.when(F.coalesce(x["n"], F.lit("")) == "", F.concat(F.lit("_c"), x["i"]))
                        .when(F.exists(raw, lambda y: (y["n"] == x["n"]) & (y["i"] < x["i"])), F.concat(x["n"], F.lit("_"), x["i"]))
                        .otherwise(x["n"]))
    return first.select("_path", "header", named.alias("names"))


def _csv_fields(line: Column, width: int) -> Column:
    """The fields of a CSV line as an array; null beyond its end."""
    cols = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(line, ", ".join(f"{c} string" for c in cols))
    return F.array(*[parsed[c] for c in cols])


def read_csv_by_header(spark: SparkSession, pattern: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """_path, fields: the rows of CSV files whose headers differ, each row as a
    map by its own file's header.

    Spark's reader applies one header to all files, so the files are read as
    lines: one scan makes the header table (a row for each file), a second
    joins it to the lines by file. The number of jobs does not depend on the
    number of files, and no path list comes to the driver. The header table is
    broadcast if it is small, by its measured size."""
    headers = csv_headers(spark, pattern, encoding).checkpoint(eager=True)
    size = headers.agg(F.sum(F.length("_path") + 2 * F.length("header")), F.max(F.size("names"))).first()
    if size[0] is not None and size[0] <= SMALL_HEADERS:
        headers = F.broadcast(headers)
    lines = _csv_lines(spark, pattern, encoding).select("_path", "line")
    rows = lines.join(headers, "_path").filter(F.col("line") != F.col("header"))
    values = F.slice(_csv_fields(F.col("line"), size[1] or 1), 1, F.size("names"))
    return rows.select("_path", F.map_from_arrays("names", values).alias("fields"))


def _field(*names: str) -> Column:
    """The first of some fields that a row's file has a value for."""
    return F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names], F.lit(None).cast("string"))


# --------------------------------------------------------------------------
# S01 indicator CSV folder
# --------------------------------------------------------------------------

def read_indicator_csv(spark: SparkSession, pattern: str, stem_suffix: str = "",
                       source: str = "istac") -> DataFrame:
    """Indicator from the ``indicator`` column, else the file stem;
    name fixes; defaults for geo and measure; unparsable values skipped."""
    stem = F.lower(F.regexp_replace(_file_stem(F.col("_path")), stem_suffix + "$", ""))
    indicator = _fixed(F.coalesce(F.lower(_field("indicator")), _fixed(stem)))
    out = read_csv_by_header(spark, pattern).select(
        F.lit(source).alias("source"), indicator.alias("indicator"),
        F.coalesce(_field("geo_code"), F.lit(DEFAULT_GEO)).alias("geo_code"),
        F.coalesce(_field("time"), F.lit("")).alias("period"),
        F.coalesce(_field("measure"), F.lit(DEFAULT_MEASURE)).alias("measure"), X.safe_float(_field("value")).alias("value"))
    return out.filter(F.col("value").isNotNull())


# --------------------------------------------------------------------------
# S02, S10-S12 series payloads
# --------------------------------------------------------------------------

RECORD = T.StructType([T.StructField("Anyo", T.IntegerType()), T.StructField("FK_Periodo", T.IntegerType()),
                       T.StructField("Valor", T.DoubleType())])
BUNDLE = T.MapType(T.StringType(), T.StructType([
    T.StructField("description", T.StringType()), T.StructField("records", T.ArrayType(RECORD))]))


def records_to_rows(df: DataFrame, records: str = "records") -> DataFrame:
    """Explode records; period from (year, period code) (X04); NULL
    values and unknown codes skipped."""
    r = df.select("*", F.explode_outer(records).alias("_r")).drop(records)
    period = P.quarter_from_source_code(F.col("_r.Anyo"), F.col("_r.FK_Periodo"))
    return (r.withColumn("period", period).withColumn("value", X.nan_to_null(F.col("_r.Valor")))
             .drop("_r").filter(F.col("period").isNotNull() & F.col("value").isNotNull()))


def read_series_bundles(spark: SparkSession, pattern: str, registry: DataFrame | None = None,
                        source: str = "ine", geo: str = DEFAULT_GEO) -> DataFrame:
    """Files mapping series id -> {description, records}; files whose
    name contains 'summary' are skipped; indicator = registry name, else a
    slug of the description (X21). Registry geo and measure win (T06)."""
    f = _text_files(spark, pattern).filter(~F.lower(F.col("path")).contains("summary"))
    m = f.select(F.explode(F.from_json("text", BUNDLE)).alias("series_id", "info"))
    m = m.select("series_id", F.col("info.description").alias("description"), F.col("info.records").alias("records"))
    rows = records_to_rows(m)
    if registry is not None:
        reg = registry.select("series_id", F.col("name").alias("_name"), F.col("geo_code").alias("_geo"))
        rows = rows.join(reg, "series_id", "left")
    else:
        rows = rows.withColumn("_name", F.lit(None).cast("string")).withColumn("_geo", F.lit(None).cast("string"))
    indicator = F.coalesce(F.col("_name"), X.slug(F.coalesce(F.col("description"), F.col("series_id"))))
    return rows.select(F.lit(source).alias("source"), indicator.alias("indicator"),
                       F.coalesce(F.col("_geo"), F.lit(geo)).alias("geo_code"), "period",
                       X.measure_of(indicator).alias("measure"), "value")


def normalise_series_payload(text: Column) -> Column:
    """Flat list of records or a ``{Data: [...]}`` wrapper; anything
    else -> empty array."""
    as_list = F.from_json(text, T.ArrayType(RECORD))
    as_wrap = F.from_json(text, T.StructType([T.StructField("Data", T.ArrayType(RECORD))]))["Data"]
    is_list = F.ltrim(text).startswith("[")
    return F.coalesce(F.when(is_list, as_list).otherwise(as_wrap), F.array().cast(T.ArrayType(RECORD)))


def read_series_payloads(spark: SparkSession, pattern: str, registry: DataFrame,
                         source: str = "ine") -> DataFrame:
    """S11 + S12: one payload file per series id (file stem); merged with the
    (id, name, geo) registry; unregistered or empty payloads yield no rows."""
    f = _text_files(spark, pattern).withColumn("series_id", _file_stem(F.col("path")))
    f = f.withColumn("records", normalise_series_payload(F.col("text"))).drop("text", "path")
    reg = registry.select("series_id", F.col("name").alias("indicator"), "geo_code")
    rows = records_to_rows(f.join(reg, "series_id"))
    return rows.select(F.lit(source).alias("source"), "indicator", "geo_code", "period",
                       X.measure_of(F.col("indicator")).alias("measure"), "value")


def latest_observation(rows: DataFrame, key: list[str]) -> DataFrame:
    """Newest record per series (by period ordinal)."""
    r = rows.withColumn("_t", P.ordinal("period"))
    return (r.groupBy(*key).agg(F.max_by(F.struct("period", "value"), "_t").alias("r"))
             .select(*key, "r.period", "r.value"))


def last_update(metadata_text: Column) -> Column:
    """Last-update timestamp under either key spelling."""
    return F.coalesce(F.get_json_object(metadata_text, "$.lastUpdate"),
                      F.get_json_object(metadata_text, "$.lastUpdated"))


# --------------------------------------------------------------------------
# S05-S09 dimension-indexed cube JSON
# --------------------------------------------------------------------------

DIM_ENTRY = T.ArrayType(T.StructType([T.StructField("id", T.StringType()),
                                      T.StructField("order", T.IntegerType())]))


def _dimension_map(text: Column, name: str, default_id: str) -> Column:
    """Index -> code, from the list form (index = position) or the
    ``{value: [{id, order}]}`` form (index = order, else position; on a
    duplicate order the last entry wins)."""
    raw = F.coalesce(F.get_json_object(text, f"$.dimension.{name.upper()}.dimensionValues"),
                     F.get_json_object(text, f"$.dimension.{name.lower()}.dimensionValues"))
    as_list = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, DIM_ENTRY))
    as_dict = F.when(F.ltrim(raw).startswith("{"),
                     F.from_json(raw, T.StructType([T.StructField("value", DIM_ENTRY)]))["value"])
    lst = F.transform(F.coalesce(as_list, F.array().cast(DIM_ENTRY)),
                      lambda e, i: F.struct(i.alias("k"), F.coalesce(e["id"], F.lit(default_id)).alias("v")))
    dct = F.transform(F.coalesce(as_dict, F.array().cast(DIM_ENTRY)),
                      lambda e, i: F.struct(F.coalesce(e["order"], i).alias("k"),
                                            F.coalesce(e["id"], F.lit(default_id)).alias("v")))
    entries = F.when(as_list.isNotNull(), lst).otherwise(dct)
    # by index, then position: the last of each run of an index stays
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"), e["v"].alias("v"))))
    last = F.filter(placed, lambda e, i: ~F.coalesce(F.get(placed, i + 1)["k"] == e["k"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


OBS_LIST = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
OBS_DICT = T.MapType(T.StringType(), T.StringType())


def read_cube_json(spark: SparkSession, pattern: str, source: str = "istac", name_re: str | None = None) -> DataFrame:
    """One payload per indicator (file stem = indicator code, or see ``_named``); list
    observations (S05) and dict observations keyed 'time|geo|measure' (S06)
    both flattened; NULL values and empty periods dropped."""
    f = _text_files(spark, pattern).withColumn("indicator", _named(F.col("path"), name_re))
    text = F.col("text")
    f = f.select("indicator",
                 _dimension_map(text, "TIME", "").alias("tm"),
                 _dimension_map(text, "GEOGRAPHICAL", DEFAULT_GEO).alias("gm"),
                 _dimension_map(text, "MEASURE", DEFAULT_MEASURE).alias("mm"),
                 F.get_json_object(text, "$.observation").alias("obs"))
    is_list = F.ltrim("obs").startswith("[")
    lst = (f.filter(is_list).select("indicator", "tm", "gm", "mm", F.explode(F.from_json("obs", OBS_LIST)).alias("o"))
            .select("indicator", "tm", "gm", "mm",
                    F.coalesce(F.col("o")["timeIndex"], F.get_json_object(F.col("o")["dimensionCodes"], "$.TIME")).alias("ti"),
                    F.coalesce(F.col("o")["geographicalIndex"], F.lit("0")).alias("gi"),
                    F.coalesce(F.col("o")["measureIndex"], F.lit("0")).alias("mi"),
                    F.coalesce(F.col("o")["value"], F.col("o")["primaryMeasure"]).alias("vt")))
    dct = (f.filter(~is_list).select("indicator", "tm", "gm", "mm", F.explode(F.from_json("obs", OBS_DICT)).alias("k", "vt"))
            .withColumn("parts", F.split("k", r"\|"))
            .select("indicator", "tm", "gm", "mm",
                    *[F.when(F.element_at("parts", i + 1).rlike("^[0-9]+$"), F.element_at("parts", i + 1))
                       .otherwise(F.lit("0")).alias(c) for i, c in enumerate(("ti", "gi", "mi"))],
                    F.coalesce(F.get_json_object("vt", "$.value"), F.col("vt")).alias("vt")))
    both = lst.unionByName(dct)
    idx = lambda c: c.try_cast("int")
    out = both.select(
        F.lit(source).alias("source"), "indicator",
        F.coalesce(F.element_at("gm", idx(F.col("gi"))), F.lit(DEFAULT_GEO)).alias("geo_code"),
        F.coalesce(F.element_at("tm", idx(F.col("ti"))), F.lit("")).alias("period"),
        F.coalesce(F.element_at("mm", idx(F.col("mi"))), F.lit(DEFAULT_MEASURE)).alias("measure"),
        X.safe_float(F.col("vt")).alias("value"))
    return out.filter(F.col("value").isNotNull() & (F.col("period") != ""))


# --------------------------------------------------------------------------
# S03, S13, S14, S16 survey files
# --------------------------------------------------------------------------

SURVEY_STRINGS = {"isla": "ISLA", "aeropuerto": "AEROPUERTO_ORIGEN", "sexo": "SEXO",
                  "nacionalidad": "NACIONALIDAD", "pais_residencia": "PAIS_RESIDENCIA",
                  "proposito": "PROPOSITO", "aloj_categ": "ALOJ_CATEG", "satisfaccion": "SATISFACCION"}
SURVEY_INTS = {"edad": "EDAD", "noches": "NOCHES"}
SURVEY_FLOATS = {"gasto_euros": "GASTO_EUROS", "coste_vuelos_euros": "COSTE_VUELOS_EUROS",
                 "coste_aloj_euros": "COSTE_ALOJ_EUROS"}


def read_survey_csv(spark: SparkSession, pattern: str, island: str = DEFAULT_GEO,
                    encoding: str = "ISO-8859-1") -> DataFrame:
    """S03 + S14 + S16 + X20: survey rows of one island with typed fields,
    placeholders as NULL, quarter from the file name, and the whole record
    (minus placeholders) as JSON text. Rows without an id are dropped."""
    df = read_csv_by_header(spark, pattern, encoding).filter(_field("ISLA") == island)
    quarter = F.upper(F.element_at(F.split(_file_stem(F.col("_path")), "_"), -1))
    clean = lambda c: F.when(~_field(c).isin(*X.PLACEHOLDER_CODES), _field(c))
    cols = [quarter.alias("quarter"), X.safe_int(_field("NUMERO_CUESTIONARIO")).alias("cuestionario")]
    cols += [clean(src).alias(dst) for dst, src in SURVEY_STRINGS.items()]
    cols += [X.safe_int(_field(src)).alias(dst) for dst, src in SURVEY_INTS.items()]
    cols += [X.safe_float(_field(src)).alias(dst) for dst, src in SURVEY_FLOATS.items()]
    cols.append(F.to_json(X.map_without_placeholders("fields")).alias("raw_json"))
    return df.select(*cols).filter(F.col("cuestionario").isNotNull())


MANIFEST = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "description", "format", "url")]))


def manifest_resources(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV resources (by format or URL suffix) with their quarter taken
    from name/description, else from the URL; undetermined -> skipped."""
    f = _text_files(spark, pattern)
    r = f.select(F.explode(F.from_json(F.get_json_object("text", "$.resources"), MANIFEST)).alias("r")).select("r.*")
    is_csv = (F.upper(F.coalesce("format", F.lit(""))) == "CSV") | F.lower(F.coalesce("url", F.lit(""))).endswith(".csv")
    q = F.coalesce(P.quarter_from_text(F.concat_ws(" ", F.coalesce("name", F.lit("")),
                                                   F.coalesce("description", F.lit("")))),
                   P.quarter_from_text(F.coalesce("url", F.lit(""))))
    return r.filter(is_csv).withColumn("quarter", q).filter(F.col("quarter").isNotNull())


# --------------------------------------------------------------------------
# S04, S15 SDMX-style and heterogeneous open-data CSV
# --------------------------------------------------------------------------

def read_sdmx_csv(spark: SparkSession, pattern: str | list[str], source: str = "istac", name_re: str | None = None) -> DataFrame:
    """Files must carry OBS_VALUE and TIME_PERIOD_CODE (others are
    skipped); optional territory/measure columns; indicator = file stem (or
    see ``_named``); 'microdatos' files excluded."""
    has = lambda c: F.map_contains_key("fields", F.lit(c))
    df = read_csv_by_header(spark, pattern).filter(
        has("OBS_VALUE") & has("TIME_PERIOD_CODE") & ~F.lower(_file_stem(F.col("_path"))).contains("microdatos"))
    out = df.select(F.lit(source).alias("source"), _named(F.col("_path"), name_re).alias("indicator"),
                    F.coalesce(_field("TERRITORIO_CODE"), F.lit(DEFAULT_GEO)).alias("geo_code"),
                    _field("TIME_PERIOD_CODE").alias("period"),
                    F.coalesce(_field("MEDIDAS_CODE"), F.lit(DEFAULT_MEASURE)).alias("measure"),
                    X.safe_float(_field("OBS_VALUE")).alias("value"))
    return out.filter(F.col("value").isNotNull() & F.col("period").isNotNull())


def read_open_data_csv(spark: SparkSession, pattern: str, source: str = "cabildo", name_re: str | None = None) -> DataFrame:
    """Value from OBS_VALUE or value; period from TIME_PERIOD_CODE,
    period or time; keep rows with both. Indicator = file stem (or see
    ``_named``)."""
    out = read_csv_by_header(spark, pattern).select(
        F.lit(source).alias("source"), _named(F.col("_path"), name_re).alias("indicator"),
        F.coalesce(_field("TERRITORIO_CODE", "geo_code"), F.lit(DEFAULT_GEO)).alias("geo_code"),
        _field("TIME_PERIOD_CODE", "period", "time").alias("period"),
        F.coalesce(_field("MEDIDAS_CODE", "measure"), F.lit(DEFAULT_MEASURE)).alias("measure"),
        X.safe_float(_field("OBS_VALUE", "value")).alias("value"))
    return out.filter(F.col("value").isNotNull() & F.col("period").isNotNull())


# --------------------------------------------------------------------------
# S18 region polygons
# --------------------------------------------------------------------------

GEO_FEATURES = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([T.StructField("name", T.StringType()), T.StructField("code", T.StringType()),
                                              T.StructField("zone", T.StringType()),
                                              T.StructField("tourism_intensity", T.DoubleType())])),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()),
                                            T.StructField("coordinates", T.StringType())]))])))])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per polygon with its attributes; geometry kept as the
    coordinate JSON text."""
    return (spark.read.schema(GEO_FEATURES).option("multiLine", True).json(path)
                 .select(F.explode("features").alias("f"))
                 .select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"),
                         F.col("f.geometry.coordinates").alias("coordinates")))

