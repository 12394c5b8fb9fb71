"""Queries of product labels and payload adapters: labels are composed from the part table, sound ones and hostile or broken ones, in both formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import payloads
from veldspar.plans.registry import _t, query

#: v tells the variant, f the payload; labels of even parts are XML, the others keyword/value.
_PARTS = "SELECT p_partkey AS id, p_size AS z, p_partkey % 2 = 0 AS xml, CAST(floor(p_partkey / 2) AS INT) % 12 AS v, CASE p_partkey % 3 WHEN 0 THEN 'OHRC' WHEN 1 THEN 'TMC-2' ELSE 'IIRS' END AS f FROM part"

_XML = """CASE WHEN v = 0 THEN '<!DOCTYPE x>' ELSE '<?xml version="1.0"?>' END || '<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1" xmlns:area="u">'
    || CASE WHEN v <> 5 THEN '<Identification_Area><logical_identifier> urn:part:' || id || CASE WHEN z % 2 = 0 THEN ' &amp; &#233;' ELSE '' END || ' </logical_identifier></Identification_Area>' ELSE '' END
    || '<Observation_Area>' || CASE v WHEN 3 THEN '' WHEN 6 THEN '<Time_Coordinates><start_date_time>2021-06-01T12:00:00</start_date_time><stop_date_time>2021-06-01T12:30:00Z</stop_date_time></Time_Coordinates>'
        WHEN 7 THEN '<Time_Coordinates><start_date_time>2021-06-01T12:00:00Z</start_date_time><stop_date_time>2021-06-01T12:00:00+02:00</stop_date_time></Time_Coordinates>'
        ELSE '<Time_Coordinates><start_date_time>2021-06-01T12:00:00Z</start_date_time><stop_date_time>2021-06-01T14:' || lpad(CAST(z AS STRING), 2, '0') || ':00+02:00</stop_date_time></Time_Coordinates>' END
    || CASE v WHEN 8 THEN '<Mission_Area><name>Fallback</name></Mission_Area>' WHEN 9 THEN '<!-- <name>none</name> -->' ELSE '<Investigation_Area><name> Chandrayaan-2 </name><name>other</name></Investigation_Area>' END || '</Observation_Area>'
    || '<area:File_Area_Observational><Array_2D_Image><Axis_Array><axis_name>Line</axis_name><elements>' || CASE WHEN v = 10 THEN 'many' ELSE CAST(z * 100 AS STRING) END
    || '</elements></Axis_Array><Axis_Array><axis_name> Sample </axis_name><elements>' || id || '</elements></Axis_Array></Array_2D_Image></area:File_Area_Observational>'
    || CASE v WHEN 1 THEN '</Product>' WHEN 2 THEN repeat('<d>', 70) || repeat('</d>', 70) || '</Product_Observational>' ELSE '</Product_Observational>' END"""

_KEYWORD = """'/* made from parts */ Object = IsisCube Object = Core Group = Dimensions Samples = ' || id || ' Lines = ' || CASE WHEN v = 1 THEN '"ten"' ELSE CAST(z AS STRING) END || CASE WHEN v = 2 THEN '' ELSE ' Bands = ' || z % 4 END || ' End_Group End_Object '
    || CASE WHEN v = 3 THEN '' ELSE 'Group = Instrument SpacecraftName = "CH-2" InstrumentId = ' || CASE z % 4 WHEN 0 THEN 'ohrc' WHEN 1 THEN '"TMC 2"' WHEN 2 THEN 'IIRS' ELSE 'OTHER' END
        || ' StartTime = "2021-06-01T12:00:00Z" StopTime = "2021-06-01T12:00:' || lpad(CAST(z AS STRING), 2, '0') || 'Z" End_Group = Instrument ' END
    || CASE WHEN v = 4 THEN '' ELSE 'Group = BandBin Center = (0.8 <um>, 900 <nm>, 700) # micrometres or not\n Width = 10 <nm> BadBand = (yes, 0) SpectralRegime = (Thermal_Emitted, "odd") End_Group ' END
    || CASE v WHEN 5 THEN 'Group = Open' WHEN 6 THEN 'X = (1, (2)) End_Object' WHEN 7 THEN repeat('Group = g ', 17) WHEN 8 THEN 'Group = Instrument SpacecraftName = late End_Group End_Object End' ELSE 'End_Object End' END"""

_FACTS = f"""WITH p AS ({_PARTS.replace('CAST(floor(p_partkey / 2) AS INT)', '(p_partkey // 2)')}), c AS (SELECT *, CASE WHEN xml AND v = 0 THEN 'input.hostile_label' WHEN (xml AND v = 2) OR (NOT xml AND v = 7) THEN 'input.resource_limit_exceeded' WHEN (xml AND v = 1) OR (NOT xml AND v IN (5, 6)) THEN 'input.label_unparseable' END AS code FROM p),
    q AS (SELECT *, code IS NULL AND xml AS x, code IS NULL AND NOT xml AS k FROM c),
    m AS (SELECT id, f, z, v, code, CASE WHEN x THEN 'xml' WHEN k THEN 'keyword' END AS format, CASE WHEN x AND v <> 5 THEN 'urn:part:' || id || CASE WHEN z % 2 = 0 THEN ' & é' ELSE '' END END AS product_id,
        CASE WHEN x THEN CASE v WHEN 8 THEN 'Fallback' WHEN 9 THEN NULL ELSE 'Chandrayaan-2' END WHEN k THEN CASE v WHEN 3 THEN NULL WHEN 8 THEN 'late' ELSE 'CH-2' END END AS mission,
        CASE WHEN k AND v NOT IN (3, 8) THEN CASE z % 4 WHEN 0 THEN 'ohrc' WHEN 1 THEN 'TMC 2' WHEN 2 THEN 'IIRS' ELSE 'OTHER' END END AS instrument_id,
        CASE WHEN (x AND v NOT IN (3, 6, 7)) OR (k AND v NOT IN (3, 8)) THEN TIMESTAMP '2021-06-01 12:00:00' END AS start_utc,
        CASE WHEN x AND v NOT IN (3, 6, 7) THEN TIMESTAMP '2021-06-01 12:00:00' + to_minutes(z) WHEN k AND v NOT IN (3, 8) THEN TIMESTAMP '2021-06-01 12:00:00' + to_seconds(z) END AS stop_utc,
        CASE WHEN x AND v <> 10 THEN z * 100 WHEN k AND v <> 1 THEN z END::BIGINT AS lines, CASE WHEN x OR k THEN id END::BIGINT AS samples, CASE WHEN k AND v <> 2 THEN z % 4 END::BIGINT AS bands,
        CASE WHEN x THEN CASE v WHEN 5 THEN 'identification_missing,' WHEN 3 THEN 'times_missing,' WHEN 6 THEN 'times_without_offset,' WHEN 7 THEN 'times_reversed,' WHEN 9 THEN 'mission_missing,' WHEN 10 THEN 'axis_not_whole,' ELSE '' END || 'instrument_not_in_scope,calibration_not_in_scope'
            WHEN k THEN CASE v WHEN 3 THEN 'instrument_missing,' WHEN 8 THEN 'instrument_id_missing,times_missing,' WHEN 1 THEN 'dimensions_not_whole,' ELSE '' END || CASE WHEN v = 4 THEN 'band_bin_missing,' WHEN v <> 2 AND z % 4 = 0 THEN 'band_count_unknown,' ELSE '' END || 'product_id_not_in_scope,calibration_not_in_scope' ELSE '' END AS warnings FROM q),
    r AS (SELECT *, coalesce(code, CASE WHEN instrument_id IS NOT NULL AND NOT (CASE f WHEN 'OHRC' THEN upper(instrument_id) = 'OHRC' WHEN 'IIRS' THEN instrument_id = 'IIRS' ELSE instrument_id = 'TMC 2' END) THEN 'input.unsupported_payload' END) AS reason FROM m)"""


def _labels(spark, d, family=None):
    _t(spark, d, "part").createOrReplaceTempView("part_of_labels")
    rows = spark.sql(_PARTS.replace("FROM part", "FROM part_of_labels"))
    if family:
        rows = rows.where(F.col("f") == family)
    return rows.selectExpr("id AS label_id", "f", "z", f"encode(CASE WHEN xml THEN {_XML} ELSE {_KEYWORD} END, 'UTF-8') AS data")


@query(f"{_FACTS} SELECT id AS label_id, format, code, product_id, mission, instrument_id, start_utc, stop_utc, lines, samples, bands, warnings FROM m")
def label_metadata(spark, d):
    facts, _ = payloads.extract(_labels(spark, d))
    return facts.select("label_id", "format", "code", "product_id", "mission", "instrument_id", F.col("start_utc").cast("timestamp_ntz").alias("start_utc"), F.col("stop_utc").cast("timestamp_ntz").alias("stop_utc"), "lines", "samples", "bands", F.array_join("warnings", ",").alias("warnings"))


def _products_sql(family: str) -> str:
    return f"{_FACTS} SELECT id AS label_id, f AS payload_family, reason, CASE WHEN reason IS NOT NULL THEN reason IN ('input.label_unparseable', 'input.unsupported_payload') END AS revalidatable, instrument_id, lines, samples FROM r WHERE f = '{family}'"


def _products(spark, d, family):
    rows, _ = payloads.validate_products(_labels(spark, d, family), F.col("f"))
    return rows.select("label_id", "payload_family", "reason", "revalidatable", "instrument_id", "lines", "samples")


@query(_products_sql("OHRC"))
def ohrc_products(spark, d):
    return _products(spark, d, "OHRC")


@query(_products_sql("TMC-2"))
def tmc2_products(spark, d):
    return _products(spark, d, "TMC-2")


@query(_products_sql("IIRS"))
def iirs_products(spark, d):
    return _products(spark, d, "IIRS")


@query(f"""{_FACTS}, b AS (SELECT id, v, bands, unnest(range(coalesce(bands, 3))) AS i FROM r WHERE f = 'IIRS' AND reason IS NULL AND format = 'keyword' AND v <> 4)
    SELECT id AS label_id, i::INT + 1 AS band_number, CASE i WHEN 0 THEN 800.0e0 WHEN 1 THEN 900.0e0 END AS center_wavelength_nm, CASE i WHEN 0 THEN 10.0e0 END AS fwhm_nm, CASE i WHEN 0 THEN true WHEN 1 THEN false END AS is_bad_band,
    CASE i WHEN 0 THEN 'emitted' ELSE 'unknown' END AS spectral_regime, concat_ws(',', CASE i WHEN 2 THEN 'center_without_unit' WHEN 1 THEN 'regime_unsupported' END, CASE WHEN bands IS NULL THEN 'count_inferred' END) AS warnings FROM b""")
def iirs_bands(spark, d):
    _, bands = payloads.validate_products(_labels(spark, d, "IIRS"), F.col("f"))
    return bands.withColumns({"center_wavelength_nm": F.round("center_wavelength_nm", 6), "warnings": F.array_join("warnings", ",")})


@query(f"{_FACTS}, w AS (SELECT *, reason IN ('input.label_unparseable', 'input.unsupported_payload') AND id % 5 <> 0 AS again FROM r) SELECT id AS label_id, CASE WHEN again THEN NULL ELSE reason END AS reason, CASE WHEN NOT again AND reason IS NOT NULL THEN reason IN ('input.label_unparseable', 'input.unsupported_payload') END AS revalidatable, again IS TRUE AS mended FROM w")
def products_revalidated(spark, d):
    """Four fifths of the labels come again, sound and with the payload's own instrument; hostile and oversized ones aren't looked at again."""
    labels = _labels(spark, d)
    first, _ = payloads.validate_products(labels, F.col("f"))
    better = labels.where("label_id % 5 <> 0").select("label_id", F.encode(F.concat(F.lit('Object = IsisCube Group = Instrument InstrumentId = "'), "f", F.lit('" SpacecraftName = mended End_Group End_Object')), "UTF-8").alias("data"))
    rows = payloads.revalidate(first, better)
    return rows.select("label_id", "reason", "revalidatable", F.coalesce(F.col("mission") == "mended", F.lit(False)).alias("mended"))
