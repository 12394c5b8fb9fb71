"""Payload adapters: metadata of products from their labels, by tables of rules; validation, quarantine and another try.

A label is read as XML first, then as keyword/value text; rules name a path and what it gives. What an adapter can't find is null with a code among
the warnings, never guessed. An adapter is data: a payload's instrument names. labels: label_id (unique), data (binary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.refine import label_bands
from veldspar.sources.labels import HOSTILE, TOO_LARGE, UNPARSEABLE, UNSUPPORTED, KeywordLimits, XmlLimits, dealt, keyword_parsed, xml_parsed
from veldspar.tables import materialise

#: Names under which labels give each payload's instrument, and why no geometry is ever validated here.
INSTRUMENTS = {"OHRC": ("OHRC",), "TMC-2": ("TMC2", "TMC-2", "TMC 2"), "IIRS": ("IIRS",)}
GEOMETRY_NOTE = "no validated ISIS/ALE/usgscsm sensor model path is available in this build"
#: The faults that another label may mend.
MENDABLE = (UNPARSEABLE, UNSUPPORTED)

#: Where XML labels have their facts, below the root.
XML_RULES = {
    "product_id": "Identification_Area/logical_identifier",
    "start": "Observation_Area/Time_Coordinates/start_date_time",
    "stop": "Observation_Area/Time_Coordinates/stop_date_time",
    "investigation": "Observation_Area/Investigation_Area/name",
    "mission_area": "Observation_Area/Mission_Area/name",
    "image": "File_Area_Observational/Array_2D_Image",
}
AXES = {"Line": "lines", "Sample": "samples", "Band": "bands"}
#: Where keyword labels have theirs.
INSTRUMENT, DIMENSIONS, BANDS = "IsisCube/Instrument", "IsisCube/Core/Dimensions", "IsisCube/BandBin"
WORDS = {"mission": f"{INSTRUMENT}/SpacecraftName", "instrument_id": f"{INSTRUMENT}/InstrumentId", "start": f"{INSTRUMENT}/StartTime", "stop": f"{INSTRUMENT}/StopTime"}
COUNTS = {"samples": f"{DIMENSIONS}/Samples", "lines": f"{DIMENSIONS}/Lines", "bands": f"{DIMENSIONS}/Bands"}
LISTS = {"centers": f"{BANDS}/Center", "widths": f"{BANDS}/Width", "bad": f"{BANDS}/BadBand", "filters": f"{BANDS}/FilterName", "regimes": f"{BANDS}/SpectralRegime"}

_WHOLE = r"^[+-]?[0-9]+$"
_INSTANT = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?)(Z|[+-][0-9]{2}:[0-9]{2})$"


def _said(c: Column) -> Column:
    """Text without blanks around it; null if nothing is left."""
    bare = F.btrim(c, F.lit(" \t\r\n"))
    return F.when(bare != "", bare)


def _instant(c: Column) -> Column:
    """A time with an offset; null for any other text: a time without one is never taken for UTC."""
    return F.when(F.coalesce(F.regexp_like(_said(c), F.lit(_INSTANT)), F.lit(False)), _said(c).try_cast("timestamp"))


def _interval(rows: DataFrame, missing: Column) -> tuple[dict[str, Column], list[Column]]:
    """start_utc, stop_utc and their warnings; missing: whether the block of the times isn't there at all."""
    given = F.coalesce(F.col("start") != "", F.lit(False)) & F.coalesce(F.col("stop") != "", F.lit(False))
    start, stop = _instant(F.col("start")), _instant(F.col("stop"))
    sound = F.coalesce(stop >= start, F.lit(False))
    warning = F.when(missing, None).when(~given, "times_missing").when(start.isNull() | stop.isNull(), "times_without_offset").when(~sound, "times_reversed")
    return {"start_utc": F.when(sound, start), "stop_utc": F.when(sound, stop)}, [warning]


def _first(elements: str, at: str | Column) -> Column:
    """The first of a label's elements at a place."""
    return F.get(F.filter(elements, lambda e: e["at"] == at), 0)


_AXES = "struct<axis:int,named:boolean,name:string,counted:boolean,count:string,axes:int,odd:boolean,lines:bigint,samples:bigint,bands:bigint>"


def _axes(elements: str, image: Column) -> Column:
    """Struct of axes (how many), odd (whether a count is no whole number) and the counts, by one walk over the elements of the image's axes in order."""
    path = XML_RULES["image"] + "/Axis_Array"

    def noted(s: Column) -> Column:  # the axis that was read, if any
        whole = F.coalesce(F.regexp_like(_said(s["count"]), F.lit(_WHOLE)), F.lit(False))
        odd = s["odd"] | (s["name"].isNotNull() & (F.coalesce(s["count"], F.lit("")) != "") & ~whole)
        counts = {v: F.when(whole & F.coalesce(_said(s["name"]) == k, F.lit(False)), _said(s["count"]).try_cast("bigint")).otherwise(s[v]) for k, v in AXES.items()}
        return F.struct(odd.alias("odd"), *(c.alias(k) for k, c in counts.items()))

    def step(s: Column, e: Column) -> Column:
        own = e["parent"] == s["axis"]
        n, none = noted(s), F.lit(None).cast("string")
        begun = F.struct(e["n"].alias("axis"), F.lit(False).alias("named"), none.alias("name"), F.lit(False).alias("counted"), none.alias("count"), (s["axes"] + 1).alias("axes"), *(n[k].alias(k) for k in ("odd", *AXES.values())))
        told = lambda **new: F.struct(*(new.get(k, s[k]).alias(k) for k in ("axis", "named", "name", "counted", "count", "axes", "odd", *AXES.values())))
        name, count = own & ~s["named"] & (e["at"] == f"{path}/axis_name"), own & ~s["counted"] & (e["at"] == f"{path}/elements")
        return F.when((e["at"] == path) & (e["parent"] == image["n"]), begun).when(name, told(named=F.lit(True), name=e["text"])).when(count, told(counted=F.lit(True), count=e["text"])).otherwise(s)

    none = F.lit(None)
    start = F.struct(none.alias("axis"), F.lit(False).alias("named"), none.alias("name"), F.lit(False).alias("counted"), none.alias("count"), F.lit(0).alias("axes"), F.lit(False).alias("odd"), *(none.alias(v) for v in AXES.values())).cast(_AXES)
    inside = F.filter(elements, lambda e: F.startswith(e["at"], F.lit(path)))
    return F.aggregate(inside, start, step, lambda s: F.struct(s["axes"].alias("axes"), *(noted(s)[k].alias(k) for k in ("odd", *AXES.values()))))


_FACTS = ("product_id", "mission", "instrument_id", "start_utc", "stop_utc", "lines", "samples", "bands", "warnings")
_FACTS_TYPE = "struct<product_id:string,mission:string,instrument_id:string,start_utc:timestamp,stop_utc:timestamp,lines:bigint,samples:bigint,bands:bigint,warnings:array<string>>"


def _facts(**of: Column) -> Column:
    return F.struct(*(of.get(k, F.lit(None)).alias(k) for k in _FACTS)).cast(_FACTS_TYPE)


def xml_facts(labels: DataFrame) -> DataFrame:
    """labels (with elements, as of xml_parsed) with xml_facts: product_id, mission, start_utc, stop_utc, lines, samples, bands, warnings. Of several children of a name the first counts, at every step; of several
    axes of a name the last. The first element of a path, in the label's order, is the one that the steps lead to, or there is none: elements under later parents come later."""
    at = lambda e: F.array_join(F.slice(e["path"], 2, F.size(e["path"])), "/")
    near = F.transform(F.filter("elements", lambda e: F.size(e["path"]) <= 5), lambda e: F.struct(*(e[k].alias(k) for k in ("n", "parent", "text")), at(e).alias("at")))
    steps = sorted({"/".join(p.split("/")[: k + 1]) for p in XML_RULES.values() for k in range(p.count("/") + 1)})
    rows = labels.withColumn("_near", near).withColumn("_root", _first("_near", ""))
    rows = rows.withColumns({f"_s{i}": _first("_near", p) for i, p in enumerate(steps)})
    chosen = {"": "_root"}
    for depth in sorted({p.count("/") for p in steps}):
        new = {f"_c{i}": p for i, p in enumerate(steps) if p.count("/") == depth}
        rows = rows.withColumns({c: F.when(F.col(f"_s{c[2:]}.parent") == F.col(f"{chosen[p.rpartition('/')[0]]}.n"), F.col(f"_s{c[2:]}")) for c, p in new.items()})
        chosen |= {p: c for c, p in new.items()}
    rows = rows.withColumns({"_axes": _axes("_near", F.col(chosen[XML_RULES["image"]])), **{name: F.col(f"{chosen[p]}.text") for name, p in XML_RULES.items() if name != "image"}})
    has = {p: F.col(c).isNotNull() for p, c in chosen.items()}
    area, times = has["Observation_Area"], has["Observation_Area/Time_Coordinates"]
    interval, times_warning = _interval(rows, ~times)
    mission = F.coalesce(_said(F.col("investigation")), _said(F.col("mission_area")))
    warnings = [
        F.when(~has["Identification_Area"], "identification_missing").when(_said(F.col("product_id")).isNull(), "product_id_missing"), F.when(~area, "observation_missing"), F.when(area & ~times, "times_missing"), *times_warning,
        F.when(area & mission.isNull(), "mission_missing"), F.when(F.col("_axes.axes") == 0, "axes_missing"), F.when(F.col("_axes.odd"), "axis_not_whole"), F.lit("instrument_not_in_scope"), F.lit("calibration_not_in_scope"),
    ]
    facts = _facts(product_id=_said(F.col("product_id")), mission=mission, **interval, **{v: F.col(f"_axes.{v}") for v in AXES.values()}, warnings=F.array_compact(F.array(*warnings)))
    return rows.withColumn("xml_facts", F.when(F.col("elements").isNotNull(), facts)).select(*labels.columns, "xml_facts")


def keyword_facts(labels: DataFrame) -> DataFrame:
    """labels (with fields, as of keyword_parsed) with keyword_facts as of xml_facts, with instrument_id; and band_lists: what label_bands reads, null without a block of bands."""
    at = lambda f: F.array_join(F.concat(f["path"], F.array(f["keyword"])), "/")
    one = lambda f: F.when(~f["is_list"], F.get(f["items"], 0))
    text = lambda f: F.when(one(f)["kind"] != "number", one(f)["value"])
    count = lambda f: F.when((one(f)["kind"] == "number") & one(f)["value"].rlike(_WHOLE), one(f)["value"].try_cast("bigint"))
    rows = labels.withColumn("_kept", F.transform(F.filter("fields", lambda f: f["effective"]), lambda f: F.struct(at(f).alias("at"), f["is_list"].alias("is_list"), f["items"].alias("items"))))
    here = lambda path: F.filter("_kept", lambda f: f["at"] == path)
    of = lambda path, c: F.array_max(F.transform(here(path), c))
    is_block = lambda path: F.exists("_kept", lambda f: (f["at"] == path) & f["items"].isNull())
    block = {f"has_{name}": is_block(path) for name, path in {"cube": "IsisCube", "instrument": INSTRUMENT, "dimensions": DIMENSIONS, "band_bin": BANDS}.items()}
    facts = rows.withColumns({
        **block, **{k: of(p, text) for k, p in WORDS.items()}, **{k: of(p, count) for k, p in COUNTS.items()},
        **{k: F.try_element_at(here(p), F.lit(-1))["items"] for k, p in LISTS.items()},
    })
    cube, dims = F.col("has_cube"), F.col("has_dimensions")
    interval, times_warning = _interval(facts, ~F.col("has_instrument"))
    named = {k: F.when(F.col("has_instrument"), _said(F.col(k))) for k in ("mission", "instrument_id")}
    sizes = F.greatest(*(F.greatest(F.coalesce(F.size(k), F.lit(0)), F.lit(0)) for k in LISTS))
    number = F.coalesce("bands", sizes)
    inside = lambda *codes: [F.when(cube, c) for c in codes]
    warnings = [
        F.when(~cube, "cube_missing"), *inside(
            F.when(~F.col("has_instrument"), "instrument_missing"), F.when(F.col("has_instrument") & named["mission"].isNull(), "mission_missing"), F.when(F.col("has_instrument") & named["instrument_id"].isNull(), "instrument_id_missing"), *times_warning,
            F.when(~dims, "dimensions_missing").when(F.col("samples").isNull() | F.col("lines").isNull(), "dimensions_not_whole"),
            F.when(~F.col("has_band_bin"), "band_bin_missing").when(number == 0, "band_count_unknown"), F.lit("product_id_not_in_scope"), F.lit("calibration_not_in_scope"),
        ),
    ]
    out = _facts(**named, **interval, lines=F.col("lines"), samples=F.col("samples"), bands=F.col("bands"), warnings=F.array_compact(F.array(*warnings)))
    lists = F.struct(F.col("bands").alias("declared_bands"), *LISTS)
    return facts.withColumns({"keyword_facts": F.when(F.col("fields").isNotNull(), out), "band_lists": F.when(cube & F.col("has_band_bin"), lists)}).select(*labels.columns, "keyword_facts", "band_lists")


def _bands(rows: DataFrame) -> DataFrame:
    """Bands of the labels with band_lists, as label_bands gives them."""
    with_unit = lambda k: F.transform(k, lambda i: F.struct(F.when(i["kind"] == "number", i["value"].try_cast("double")).alias("value"), i["unit"].alias("unit")))
    yes, no = ("yes", "true", "1"), ("no", "false", "0")
    whole = lambda i: (i["kind"] == "number") & i["value"].rlike(_WHOLE) & i["unit"].isNull()
    flag = lambda i: F.when(whole(i), i["value"].try_cast("bigint") != 0).when((i["kind"] != "number") & F.lower(F.trim(i["value"])).isin(*yes), True).when((i["kind"] != "number") & F.lower(F.trim(i["value"])).isin(*no), False)
    terms = lambda k: F.transform(k, lambda i: F.when(i["kind"] != "number", i["value"]))
    lists = rows.where("band_lists is not null").select("label_id", "band_lists.*")
    return label_bands(lists.select(
        "label_id", "declared_bands", with_unit("centers").alias("centers"), with_unit("widths").alias("widths"), F.transform("bad", flag).alias("bad_bands"), terms("filters").alias("filters"), terms("regimes").alias("regimes"),
    ))


def _extracted(labels: DataFrame, xml: XmlLimits, keyword: KeywordLimits) -> DataFrame:
    """labels (without data) with format, code, the facts and band_lists: a label stays one row throughout."""
    rows = xml_parsed(dealt(labels), xml).withColumn("data", F.when(F.col("xml_code").isNotNull(), F.col("data")))  # the keyword reader gets what the first one refused
    rows = keyword_facts(keyword_parsed(xml_facts(rows), keyword))
    kind = F.when(F.col("xml_code").isNull(), "xml").when(F.col("keyword_code").isNull(), "keyword")
    either = lambda code: (F.col("xml_code") == code) | (F.col("keyword_code") == code)
    code = F.when(kind.isNotNull(), None).when(either(HOSTILE), HOSTILE).when(either(TOO_LARGE), TOO_LARGE).otherwise(UNPARSEABLE)
    facts = F.coalesce("xml_facts", "keyword_facts")
    warnings = F.coalesce(facts["warnings"], F.array().cast("array<string>"))
    kept = [c for c in labels.columns if c != "data"]
    return rows.select(*kept, kind.alias("format"), code.alias("code"), *(facts[k].alias(k) for k in _FACTS if k != "warnings"), warnings.alias("warnings"), "band_lists")


def extract(labels: DataFrame, xml: XmlLimits = XmlLimits(), keyword: KeywordLimits = KeywordLimits()) -> tuple[DataFrame, DataFrame]:
    """A row per label: label_id, format (xml, keyword or null), code (why neither reader took it: hostile ahead of too large ahead of unparseable), the facts; and the bands of its label."""
    rows = materialise(_extracted(labels.select("label_id", "data"), xml, keyword))
    return rows.drop("band_lists"), _bands(rows)


def validate_products(labels: DataFrame, family: Column, xml: XmlLimits = XmlLimits(), keyword: KeywordLimits = KeywordLimits()) -> tuple[DataFrame, DataFrame]:
    """extract() with payload_family (family: an expression over columns of labels, a key of INSTRUMENTS), reason (null if accepted; an instrument of another payload is unsupported), revalidatable,
    calibration_state, geometry_validated (never) and why; and the bands of accepted products."""
    rows = _extracted(labels.select("label_id", "data", family.alias("payload_family")), xml, keyword)
    expected = F.create_map(*[x for k, v in INSTRUMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    other = F.col("instrument_id").isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(expected, F.col("payload_family")), F.upper("instrument_id")), F.lit(False))
    reason = F.coalesce("code", F.when(other, UNSUPPORTED))
    rows = rows.withColumns({"reason": reason, "revalidatable": F.when(reason.isNotNull(), reason.isin(*MENDABLE)), "calibration_state": F.lit("unknown"), "geometry_validated": F.lit(False), "geometry_note": F.lit(GEOMETRY_NOTE)}).drop("code")
    rows = materialise(rows)
    return rows.drop("band_lists"), _bands(rows.where("reason is null"))


def revalidate(records: DataFrame, labels: DataFrame) -> DataFrame:
    """records: rows of validate_products. Those that a new label (labels: label_id, data) may mend are validated again; all others stay as they are."""
    again = records.where("revalidatable").select("label_id", "payload_family").join(labels.select("label_id", "data"), "label_id")
    mended, _ = validate_products(again, F.col("payload_family"))
    return mended.unionByName(records.join(again.select("label_id"), "label_id", "left_anti"))
