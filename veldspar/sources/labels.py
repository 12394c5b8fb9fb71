"""Product labels, XML and keyword/value, read as tables under limits: a status for each label and a row for each element or statement.

A label stays one row: it is taken apart into an array of tokens by one regular expression (linear in its length, every quantifier on a group possessive), and one walk over
that array keeps the blocks that are open, finds the first fault and gives what is read. Labels are dealt once, by label_id, and nothing else is shuffled, sorted or joined; a label
is as large as its limit at most. Nothing is ever fetched or expanded: a document type or entity declaration is refused before any token is read.

A status is null (sound) or a code. Of several faults the first in the label counts. Labels: label_id (unique), data (binary). Defined results: null data can't be parsed;
empty data is a sound keyword/value label without statements, but no XML; text that isn't UTF-8 can't be parsed; an empty table gives empty results. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.tables import materialise

#: What is wrong with a label.
HOSTILE, TOO_LARGE, UNPARSEABLE, UNSUPPORTED = "input.hostile_label", "input.resource_limit_exceeded", "input.label_unparseable", "input.unsupported_payload"


@dataclass(frozen=True)
class KeywordLimits:
    size: int = 5 << 20
    depth: int = 16
    statements: int = 10_000
    items: int = 10_000


@dataclass(frozen=True)
class XmlLimits:
    size: int = 10 << 20
    depth: int = 64
    elements: int = 100_000
    attributes: int = 256


def _any(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


#: Items that a walk takes at a time, on each of LEVELS levels: the state of an aggregate is copied at every step, so the rows that it gathers are kept few.
CHUNK, LEVELS = 20, 2


def _walk(items: str, state: Column, kind: str, step: Callable[[Column, Column], Column], row: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Struct of the state after all of a column's items (step: the state before an item, the item) and all rows of type `kind` (by the same arguments: whether there is one, and the row) in order."""
    both = lambda state, rows: F.struct(state.alias("state"), rows.alias("rows"))
    none, n = F.array().cast(f"array<{kind}>"), F.size(items)
    grown = lambda rows, there, one: F.when(there, F.concat(rows, F.array(one))).otherwise(rows)

    def level(at: Column, state: Column, k: int) -> Column:
        if k == 0:
            return F.aggregate(F.slice(items, at + 1, F.lit(CHUNK)), both(state, none), lambda a, x: both(step(a["state"], x), grown(a["rows"], *row(a["state"], x))))
        to = n if k == LEVELS else F.least(n, at + CHUNK ** (k + 1))
        part = lambda a, i: F.get(F.transform(F.array(level(i, a["state"], k - 1)), lambda r: both(r["state"], F.concat(a["rows"], r["rows"]))), 0)
        return F.aggregate(F.sequence(at, to - 1, F.lit(CHUNK**k)), both(state, none), part)

    return F.when(n > 0, level(F.lit(0), state, LEVELS)).otherwise(both(state, none))


def _updated(state: Column, names: tuple[str, ...], **new: Column) -> Column:
    return F.struct(*(new.get(k, state[k]).alias(k) for k in names))


def _text(labels: DataFrame, size: int, hostile: str | None) -> DataFrame:
    """labels with _text (of what may be parsed) and _refused (a code)."""
    data = F.col("data").cast("binary")
    text = data.cast("string")
    refused = F.when(F.octet_length(data) > size, TOO_LARGE)
    if hostile:
        refused = refused.when(F.regexp_like(text, F.lit(hostile)), HOSTILE)
    refused = refused.when(data.isNull() | ~F.is_valid_utf8(text), UNPARSEABLE)
    return labels.withColumn("_refused", refused).withColumn("_text", F.when(F.col("_refused").isNull(), text))


def dealt(labels: DataFrame) -> DataFrame:
    """labels over all partitions: a file of few blocks would keep all of them in few tasks."""
    return labels.repartition(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label_id")


# --- keyword/value labels ----------------------------------------------------------------------------------------

_NUMBER = r"[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?"
_WORD = r"[A-Za-z_^][A-Za-z0-9_:\-]*+"
_PVL_TOKEN = _any(r"/\*[\s\S]*?\*/", r"#[^\n]*+", '"[^"]*"', "'[^']*'", rf"{_NUMBER}[ \t]*<[^>]*>", _NUMBER, _WORD, r"[=(){},]", r"[^ \t\r\n]")
#: Letters of kinds of tokens: S text, N number, I word, E end, X and Y ends of an object and a group, O and G their beginnings, B none of these; signs stand for themselves.
_NAME, _SCALAR = "[SIEXYOG]", "[SNIEXYOG]"
_LIST = rf"{_SCALAR}(?:,{_SCALAR})*+"
_ASSIGN = rf"I={_any(_SCALAR, rf'[(](?:{_LIST})?[)]', rf'[{{](?:{_LIST})?[}}]')}"
_STATEMENT = _any("E.*+", rf"[XY](?:={_NAME})?", rf"[OG]={_NAME}", _ASSIGN, ".++")


_SPECIAL = {"END": "E", "END_OBJECT": "X", "END_GROUP": "Y", "OBJECT": "O", "GROUP": "G"}


def _kind(token: Column) -> Column:
    special = F.try_element_at(F.create_map(*[F.lit(x) for kv in _SPECIAL.items() for x in kv]), F.upper(token))
    first = F.substring(token, 1, 1)
    kind = F.when(F.regexp_like(token, F.lit("^[A-Za-z_^]")), F.coalesce(special, F.lit("I"))).when(first.isin(*"=(){},"), first).when(first.isin('"', "'") & (F.length(token) > 1), "S")
    return kind.when(F.regexp_like(token, F.lit(f"^{_NUMBER}")), "N").otherwise("B")


def _scalar(kind: Column, token: Column) -> Column:
    """kind (text, number or word), value and unit of a token."""
    unit = F.regexp_extract(token, r"<([^>]*)>$", 1)
    with_unit = (kind == "N") & F.endswith(token, F.lit(">"))
    value = F.when(kind == "S", F.substring(token, 2, F.length(token) - 2)).when(with_unit, F.regexp_extract(token, f"^({_NUMBER})", 1)).otherwise(token)
    name = F.when(kind == "S", "text").when(kind == "N", "number").otherwise("word")
    return F.struct(name.alias("kind"), value.alias("value"), F.when(with_unit, unit).alias("unit"))


_BLOCK = "struct<n:int,name:string,block:string>"
_ITEM = "struct<kind:string,value:string,unit:string>"
_WRITE = f"struct<n:int,opened:int,keyword:string,inside:array<int>,path:array<string>,is_list:boolean,items:array<{_ITEM}>>"
_KW_STATE = ("n", "at", "depth", "counted", "stack", "fault")


def keyword_parsed(labels: DataFrame, limits: KeywordLimits = KeywordLimits()) -> DataFrame:
    """labels with keyword_code (null: sound) and fields, an array of what keyword_labels gives for a sound label (null for others)."""
    rows = _text(labels, limits.size, None)
    tokens = F.filter(F.regexp_extract_all("_text", F.lit(_PVL_TOKEN), 0), lambda t: ~(F.startswith(t, F.lit("/*")) | F.startswith(t, F.lit("#"))))
    rows = rows.withColumn("_tokens", tokens).withColumn("_kinds", F.transform("_tokens", _kind))
    shapes = F.regexp_extract_all(F.array_join("_kinds", ""), F.lit(_STATEMENT), 0)
    is_ = lambda s, pattern: F.regexp_like(s, F.lit(f"^{pattern}$"))
    what = lambda s: F.when(F.startswith(s, F.lit("E")), "ends").when(F.regexp_like(s, F.lit("^[XY]")), "closes").when(is_(s, rf"[OG]={_NAME}"), "opens").when(is_(s, _ASSIGN), "assigns").otherwise("loose")
    rows = rows.withColumn("_statements", F.transform(shapes, lambda s: F.struct(s.alias("shape"), F.length(s).alias("long"), what(s).alias("what"))))
    token, kind = lambda i: F.get("_tokens", i), lambda i: F.get("_kinds", i)

    def fault(s: Column, x: Column) -> Column:
        opener = F.when(s["depth"].between(1, limits.depth), F.get(s["stack"], s["depth"] - 1)["block"])
        wrong_end = ~F.coalesce(opener == F.when(F.startswith(x["shape"], F.lit("X")), "O").otherwise("G"), F.lit(False))
        listed = F.regexp_extract(x["shape"], rf"^I=[({{]((?:{_SCALAR},)*+{_SCALAR}?)", 1)  # as far as a list is one
        long = F.floor((F.length(listed) + 1) / 2) > limits.items
        return (
            F.when(x["what"] == "ends", None).when(x["what"] == "closes", F.when(wrong_end, UNPARSEABLE)).when(counts(x) & (s["counted"] >= limits.statements), TOO_LARGE)
            .when(x["what"] == "opens", F.when(s["depth"] >= limits.depth, TOO_LARGE)).when((x["long"] > 3) & long, TOO_LARGE).when(x["what"] == "loose", UNPARSEABLE)
        )

    counts = lambda x: x["what"].isin("opens", "assigns") | ((x["what"] == "loose") & F.startswith(x["shape"], F.lit("I=")))

    def step(s: Column, x: Column) -> Column:
        name = _scalar(kind(s["at"] + 2), token(s["at"] + 2))["value"]
        opened = F.concat(s["stack"], F.array(F.struct(s["n"].alias("n"), name.alias("name"), F.substring(x["shape"], 1, 1).alias("block"))))
        opens, closes = x["what"] == "opens", x["what"] == "closes"
        new = _updated(
            s, _KW_STATE, n=s["n"] + 1, at=s["at"] + x["long"], depth=s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), counted=s["counted"] + F.when(counts(x), 1).otherwise(0),
            stack=F.when(opens & (s["depth"] < limits.depth), opened).when(closes, F.slice(s["stack"], 1, F.greatest(s["depth"] - 1, F.lit(0)))).otherwise(s["stack"]), fault=fault(s, x),
        )
        return F.when(s["fault"].isNotNull(), s).otherwise(new)

    def writes(s: Column, x: Column) -> tuple[Column, Column]:
        closes = x["what"] == "closes"
        own, around = F.get(s["stack"], s["depth"] - 1), F.when(closes, F.slice(s["stack"], 1, F.greatest(s["depth"] - 1, F.lit(0)))).otherwise(s["stack"])
        alone = x["long"] == 3
        at, n = s["at"] + F.when(alone, 3).otherwise(4), F.when(alone, 1).otherwise(F.greatest(x["long"] - 4, F.lit(0)))
        pairs = F.zip_with(F.slice("_kinds", at, n), F.slice("_tokens", at, n), lambda k, t: F.struct(k.alias("k"), t.alias("t")))
        items = F.transform(F.filter(pairs, lambda p: p["k"] != ","), lambda p: _scalar(p["k"], p["t"]))
        one = F.struct(
            s["n"].alias("n"), F.when(closes, own["n"]).alias("opened"), F.when(closes, own["name"]).otherwise(token(s["at"])).alias("keyword"), F.transform(around, lambda b: b["n"]).alias("inside"),
            F.transform(around, lambda b: b["name"]).alias("path"), (~alone).alias("is_list"), F.when(~closes, items).alias("items"),
        )
        return s["fault"].isNull() & x["what"].isin("assigns", "closes"), one

    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("counted"), F.array().cast(f"array<{_BLOCK}>").alias("stack"), F.lit(None).cast("string").alias("fault"))
    rows = rows.withColumn("_walk", F.when(F.col("_refused").isNull(), _walk("_statements", first, _WRITE, step, writes)))
    end = F.col("_walk.state")
    rows = rows.withColumn("keyword_code", F.coalesce("_refused", end["fault"], F.when(end["depth"] != 0, UNPARSEABLE))).withColumn("_writes", F.when(F.col("keyword_code").isNull(), F.col("_walk.rows")))
    # of the writes of one keyword in one block the last counts: they stand side by side when sorted
    keys = F.sort_array(F.transform("_writes", lambda w: F.struct(w["keyword"].alias("keyword"), F.coalesce(F.get(w["inside"], F.size(w["inside"]) - 1), F.lit(-1)).alias("in"), w["n"].alias("n"))))
    rows = rows.withColumn("_keys", keys)
    after = lambda i: F.get("_keys", i + 1)
    marks = F.transform("_keys", lambda k, i: F.struct(k["n"].alias("n"), F.coalesce((after(i)["keyword"] == k["keyword"]) & (after(i)["in"] == k["in"]), F.lit(False)).alias("replaced")))
    rows = rows.withColumn("_marks", F.sort_array(marks))
    rows = rows.withColumn("_written", F.zip_with("_writes", "_marks", lambda w, m: F.struct(w.alias("w"), m["replaced"].alias("replaced"))))
    gone = F.transform(F.filter("_written", lambda x: x["replaced"] & x["w"]["opened"].isNotNull()), lambda x: x["w"]["opened"])
    rows = rows.withColumn("_gone", gone)
    kept = lambda x: ~x["replaced"] & ((F.size("_gone") == 0) | ~F.arrays_overlap(x["w"]["inside"], "_gone"))
    fields = F.transform("_written", lambda x: F.struct(*(x["w"][k].alias(k) for k in ("n", "path", "keyword", "is_list", "items")), kept(x).alias("effective")))
    return rows.withColumn("fields", fields).select(*labels.columns, "keyword_code", "fields")


def keyword_labels(labels: DataFrame, limits: KeywordLimits = KeywordLimits()) -> tuple[DataFrame, DataFrame]:
    """Status (label_id, code) and fields of sound labels: label_id, n (its place), path (names of the blocks around it), keyword, is_list, items (structs of kind, value, unit; null for a block, whose
    keyword is its name), and effective: whether no later statement or block of the same name in the same block replaces it or a block around it."""
    rows = materialise(keyword_parsed(dealt(labels.select("label_id", "data")), limits).select("label_id", "keyword_code", "fields"))
    return rows.select("label_id", F.col("keyword_code").alias("code")), rows.select("label_id", F.inline("fields"))


# --- XML labels --------------------------------------------------------------------------------------------------

_XML_NAME = r"[A-Za-z_:\u0080-￿][A-Za-z0-9_:.\-\u0080-￿]*+"
_ATTRIBUTE = rf"\s++{_XML_NAME}\s*+=\s*+(?:\"[^<\"]*+\"|'[^<']*+')"
_START = rf"<{_XML_NAME}(?:{_ATTRIBUTE})*+\s*+/?>"
_XML_TOKEN = _any(r"<!--[\s\S]*?-->", r"<!\[CDATA\[[\s\S]*?\]\]>", r"<\?[\s\S]*?\?>", rf"</{_XML_NAME}\s*+>", _START, "[^<]++", "<[^<]*+")
_HOSTILE_XML = r"(?i)<!\s*(?:DOCTYPE|ENTITY)"
_ENTITY = "&(?!(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});)"


def _decoded(text: Column) -> Column:
    """Text with its character references and the five named ones replaced."""
    names = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

    def one(t: Column) -> Column:
        out = t
        for k, v in names.items():
            out = F.when(t == k, v).otherwise(out)
        digits = F.when(F.startswith(t, F.lit("&#x")), F.regexp_extract(t, "^&#x([0-9a-fA-F]+);", 1)).otherwise(F.hex(F.regexp_extract(t, "^&#([0-9]+);", 1).try_cast("bigint")))
        return F.when(F.startswith(t, F.lit("&#")), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(out)

    parts = F.regexp_extract_all(text, F.lit("&[^;]*+;|[^&]++"), 0)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


_OPEN = "struct<n:int,name:string,bound:array<string>>"
_TAG = "struct<n:int,kind:string,parent:int,path:array<string>,name:string>"
_XML_STATE = ("depth", "elements", "roots", "stack", "fault")


def _token_kind(t: Column) -> Column:
    """What a token is; loose: none of these."""
    whole = lambda begin, end, kind: F.when(F.endswith(t, F.lit(end)) & (F.length(t) >= len(begin + end)), kind).otherwise("loose")
    starts = lambda begin: F.startswith(t, F.lit(begin))
    return (
        F.when(~starts("<"), "text").when(starts("</"), F.when(F.regexp_like(t, F.lit(rf"^</{_XML_NAME}\s*+>$")), "end").otherwise("loose")).when(starts("<?"), whole("<?", "?>", "instruction"))
        .when(starts("<!--"), whole("<!--", "-->", "comment")).when(starts("<![CDATA["), whole("<![CDATA[", "]]>", "cdata"))
        .when(F.regexp_like(t, F.lit(rf"^(?:{_START})$")), F.when(F.endswith(t, F.lit("/>")), "single").otherwise("start")).otherwise("loose")
    )


def xml_parsed(labels: DataFrame, limits: XmlLimits = XmlLimits()) -> DataFrame:
    """labels with xml_code (null: sound) and elements, an array of what xml_labels gives for a sound label (null for others)."""
    rows = _text(labels, limits.size, _HOSTILE_XML)
    tokens = F.regexp_extract_all(F.regexp_replace("_text", "^\ufeff", ""), F.lit(_XML_TOKEN), 0)
    rows = rows.withColumn("_kinds", F.transform(tokens, lambda t, i: F.struct(i.alias("n"), t.alias("token"), _token_kind(t).alias("kind"))))
    loose = F.array_position(F.transform("_kinds", lambda t: t["kind"]), "loose").cast("int")
    rows = rows.withColumn("_sure", F.slice("_kinds", 1, F.when(loose > 0, loose).otherwise(F.size("_kinds"))))  # nothing after a fault counts
    empty = F.array().cast("array<string>")

    def part(t: Column) -> Column:
        tag = t["kind"].isin("start", "single")
        heads = F.when(tag & F.contains(t["token"], F.lit("=")), F.regexp_extract_all(t["token"], F.lit(rf"\s({_XML_NAME})\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')"), 1)).otherwise(empty)
        name = F.when(tag, F.regexp_extract(t["token"], f"^<({_XML_NAME})", 1)).when(t["kind"] == "end", F.regexp_extract(t["token"], f"^</({_XML_NAME})", 1))
        return F.struct(t["n"].alias("n"), t["token"].alias("token"), t["kind"].alias("kind"), name.alias("name"), heads.alias("heads"))

    rows = rows.withColumn("_parts", F.transform("_sure", part))
    # plain text after a start or ahead of an end is inside an element, or that tag is a fault of its own: the walk needn't see it
    plain = lambda p, i: (p["kind"] == "text") & ~F.contains(p["token"], F.lit("&")) & ~F.contains(p["token"], F.lit("]]>")) & ((F.get("_parts", i - 1)["kind"] == "start") | (F.get("_parts", i + 1)["kind"] == "end"))
    rows = rows.withColumn("_items", F.filter("_parts", lambda p, i: ~F.coalesce(plain(p, i), F.lit(False))))
    bound = lambda heads: F.transform(F.filter(heads, lambda a: F.startswith(a, F.lit("xmlns:"))), lambda a: F.substring(a, 7, 1 << 20))
    prefixes = lambda names: F.filter(F.transform(F.filter(names, lambda a: F.contains(a, F.lit(":")) & ~F.startswith(a, F.lit("xmlns:"))), lambda a: F.substring_index(a, ":", 1)), lambda p: p != "xml")
    local = lambda c: F.substring_index(c, ":", -1)

    def fault(s: Column, x: Column) -> Column:
        token, outside = x["token"], s["depth"] == 0
        has = lambda pattern: F.regexp_like(token, F.lit(pattern))
        reference = F.contains(token, F.lit("&")) & has(_ENTITY)
        known = F.concat(bound(x["heads"]), F.flatten(F.transform(s["stack"], lambda b: b["bound"])))
        unbound = F.contains(token, F.lit(":")) & (F.size(F.array_except(prefixes(F.concat(F.array(x["name"]), x["heads"])), known)) > 0)
        twice = (F.size(x["heads"]) > 1) & (F.size(F.array_distinct(x["heads"])) < F.size(x["heads"]))
        too_large = (s["depth"] >= limits.depth) | (s["elements"] >= limits.elements) | (F.size(x["heads"]) > limits.attributes)
        wrong_end = ~F.coalesce(F.when(s["depth"].between(1, limits.depth), F.get(s["stack"], s["depth"] - 1)["name"]) == x["name"], F.lit(False))
        return (
            F.when(x["kind"] == "text", F.when((outside & ~has(r"^[ \t\r\n]*+$")) | reference | F.contains(token, F.lit("]]>")), UNPARSEABLE))
            .when(x["kind"].isin("start", "single"), F.when(twice | unbound | reference | (outside & (s["roots"] > 0)), UNPARSEABLE).when(too_large, TOO_LARGE)).when(x["kind"] == "end", F.when(wrong_end, UNPARSEABLE))
            .when(x["kind"] == "cdata", F.when(outside, UNPARSEABLE)).when(x["kind"] == "comment", F.when(has(r"^<!--[\s\S]*?--(?!>$)[\s\S]*-->$") | has("--->$"), UNPARSEABLE))
            .when(x["kind"] == "instruction", F.when(has(r"(?i)^<\?xml[\s?]") & ((x["n"] > 0) | ~has(r"^<\?xml\s+version\s*=")), UNPARSEABLE)).otherwise(UNPARSEABLE)
        )

    def step(s: Column, x: Column) -> Column:
        opens, closes, tag = x["kind"] == "start", x["kind"] == "end", x["kind"].isin("start", "single")
        opened = F.concat(s["stack"], F.array(F.struct(x["n"].alias("n"), x["name"].alias("name"), bound(x["heads"]).alias("bound"))))
        moved = _updated(
            s, _XML_STATE, depth=s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), elements=s["elements"] + F.when(tag, 1).otherwise(0), roots=s["roots"] + F.when(tag & (s["depth"] == 0), 1).otherwise(0),
            stack=F.when(opens & (s["depth"] < limits.depth), opened).when(closes, F.slice(s["stack"], 1, F.greatest(s["depth"] - 1, F.lit(0)))).otherwise(s["stack"]), fault=fault(s, x),
        )
        return F.when(s["fault"].isNotNull(), s).when(tag | closes, moved).otherwise(_updated(s, _XML_STATE, fault=fault(s, x)))

    def tags(s: Column, x: Column) -> tuple[Column, Column]:
        tag = x["kind"].isin("start", "single")
        path = F.concat(F.transform(s["stack"], lambda b: local(b["name"])), F.array(local(x["name"])))
        one = F.struct(x["n"].alias("n"), x["kind"].alias("kind"), F.when(tag, F.get(s["stack"], F.size(s["stack"]) - 1)["n"]).alias("parent"), F.when(tag, path).alias("path"), F.when(tag, local(x["name"])).alias("name"))
        return s["fault"].isNull() & (tag | (x["kind"] == "end")), one

    first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("elements"), F.lit(0).alias("roots"), F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit(None).cast("string").alias("fault"))
    rows = rows.withColumn("_walk", F.when(F.col("_refused").isNull(), _walk("_items", first, _TAG, step, tags)))
    end = F.col("_walk.state")
    rows = rows.withColumn("xml_code", F.coalesce("_refused", end["fault"], F.when((end["depth"] != 0) | (end["roots"] == 0), UNPARSEABLE))).withColumn("_tags", F.when(F.col("xml_code").isNull(), F.col("_walk.rows")))

    def element(t: Column, i: Column) -> Column:
        said = F.filter(F.slice("_parts", t["n"] + 2, F.get("_tags", i + 1)["n"] - t["n"] - 1), lambda p: p["kind"].isin("text", "cdata"))  # up to the next tag
        text = F.array_join(F.transform(said, lambda p: F.when(p["kind"] == "cdata", F.substring(p["token"], 10, F.length(p["token"]) - 12)).otherwise(_decoded(p["token"]))), "")
        return F.struct(*(t[k].alias(k) for k in ("n", "kind", "parent", "path", "name")), F.when((t["kind"] == "start") & (F.size(said) > 0), text).alias("text"))

    elements = F.filter(F.transform("_tags", element), lambda e: e["kind"] != "end")
    elements = F.transform(elements, lambda e: F.struct(*(e[k].alias(k) for k in ("n", "parent", "path", "name", "text"))))
    return rows.withColumn("elements", elements).select(*labels.columns, "xml_code", "elements")


def xml_labels(labels: DataFrame, limits: XmlLimits = XmlLimits()) -> tuple[DataFrame, DataFrame]:
    """Status (label_id, code) and elements of sound labels: label_id, n (its place), parent (its parent's, null for the root), path (local names from the root down, its own last), name (local), and text
    (ahead of its first child element, references replaced; null if there is none). A label that declares a document type or an entity is hostile, whatever else it holds.
    Well-formed means: one root, tags that match, quoted attributes without repeats, known references, bound prefixes; what a document type would define is never known."""
    rows = materialise(xml_parsed(dealt(labels.select("label_id", "data")), limits).select("label_id", "xml_code", "elements"))
    return rows.select("label_id", F.col("xml_code").alias("code")), rows.select("label_id", F.inline("elements"))
