"""Labels stay one row each: nothing but their dealing is shuffled, long labels are walked whole, and first children count."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from veldspar.operators import payloads
from veldspar.sources import labels as lb


def _labels(spark, datas):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(datas)], "label_id long, data binary")


def test_no_token_is_shuffled(spark):
    rows = lb.keyword_parsed(lb.xml_parsed(_labels(spark, [b"<a/>"])))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Window", "Sort", "Generate"))
    status, elements = lb.xml_labels(_labels(spark, [b"<a/>"]))
    assert status.join(elements, "label_id").count() == 1


def test_end_tags_hold_a_name_alone(spark):
    status, _ = lb.xml_labels(_labels(spark, [b"<a></a b>", b"<a></a\n>"]))
    assert {r["label_id"]: r["code"] for r in status.collect()} == {0: lb.UNPARSEABLE, 1: None}


def test_long_labels_are_walked_whole(spark):
    data = b"<r>" + b"".join(b"<s i='%d'>t%d<u/><![CDATA[x]]></s> " % (i, i) for i in range(1_700)) + b"</r>"
    status, elements = lb.xml_labels(_labels(spark, [data, data[:-4], data.replace(b"t1699<", b"t1699&x;<")]))
    assert {r["label_id"]: r["code"] for r in status.collect()} == {0: None, 1: lb.UNPARSEABLE, 2: lb.UNPARSEABLE}
    assert [(r["name"], r["text"]) for r in elements.orderBy("n").collect()] == [(e.tag, e.text) for e in ET.fromstring(data).iter()]  # noqa: S314
    words = b"Group = g " + b" ".join(b"k%d = %d" % (i, i) for i in range(3_300)) + b" k7 = 0 End_Group"
    status, fields = lb.keyword_labels(_labels(spark, [words, words[:-9]]))
    assert {r["label_id"]: r["code"] for r in status.collect()} == {0: None, 1: lb.UNPARSEABLE}
    got = fields.where("items is not null").orderBy("n").collect()
    assert [(r["keyword"], r["items"][0]["value"]) for r in got] == [(f"k{i}", str(i)) for i in range(3_300)] + [("k7", "0")]
    assert [r["keyword"] for r in got if not r["effective"]] == ["k7"]


def test_first_children_and_last_axes(spark):
    axis = lambda name, n: f"<Axis_Array><axis_name>{name}</axis_name><elements>{n}</elements><elements>9</elements></Axis_Array>"
    image = lambda *axes: f"<Array_2D_Image>{''.join(axes)}</Array_2D_Image>"
    data = [
        f"<p><Identification_Area/><Identification_Area><logical_identifier>late</logical_identifier></Identification_Area><File_Area_Observational>{image(axis('Line', 3), axis('Line', 4), axis('Sample', 'x'))}{image(axis('Sample', 5))}</File_Area_Observational></p>",
        f"<p><Identification_Area><logical_identifier>one</logical_identifier></Identification_Area><File_Area_Observational/><File_Area_Observational>{image(axis('Line', 3))}</File_Area_Observational></p>",
    ]
    rows, _ = payloads.extract(_labels(spark, [d.encode() for d in data]))
    got = [(r["format"], r["product_id"], r["lines"], r["samples"], r["warnings"][:-2]) for r in rows.orderBy("label_id").collect()]
    assert got == [("xml", None, 4, None, ["product_id_missing", "observation_missing", "axis_not_whole"]), ("xml", "one", None, None, ["observation_missing", "axes_missing"])]
