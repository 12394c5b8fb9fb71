"""Label readers: sound, hostile and broken labels; XML against the standard library's parser."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

import pytest

from veldspar.sources import labels as lb

PVL = b"""/* made by hand */
^IMAGE = ("cube.img", 65)   # a pointer is a word like any other
Object = IsisCube
  Group = Instrument
    SpacecraftName = "Chandrayaan # 2"  StartTime = '2021-06-01T12:00:00Z'
    Scale = 10.5 <km>
  End_Group = Instrument
  Group = BandBin
    Center = (0.8 <um>, 900 <nm>, -1.5e3)
    Empty = {}
    Object = yes
    End_Object
  End_Group
End_Object
End
this is never read ((("""


def _run(spark, read, datas, *args):
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(datas)], "label_id long, data binary")
    status, found = read(rows, *args)
    return {r["label_id"]: r["code"] for r in status.collect()}, found.orderBy("label_id", "n").collect()


def test_keyword_label(spark):
    code, fields = _run(spark, lb.keyword_labels, [PVL])
    assert code == {0: None}
    got = {(*r["path"], r["keyword"]): (r["is_list"], [tuple(i) for i in r["items"]]) for r in fields if r["items"] is not None}
    assert got == {
        ("^IMAGE",): (True, [("text", "cube.img", None), ("number", "65", None)]),
        ("IsisCube", "Instrument", "SpacecraftName"): (False, [("text", "Chandrayaan # 2", None)]),
        ("IsisCube", "Instrument", "StartTime"): (False, [("text", "2021-06-01T12:00:00Z", None)]),
        ("IsisCube", "Instrument", "Scale"): (False, [("number", "10.5", "km")]),
        ("IsisCube", "BandBin", "Center"): (True, [("number", "0.8", "um"), ("number", "900", "nm"), ("number", "-1.5e3", None)]),
        ("IsisCube", "BandBin", "Empty"): (True, []),
    }
    assert all(r["effective"] for r in fields)
    assert [(*r["path"], r["keyword"]) for r in fields if r["items"] is None] == [("IsisCube", "Instrument"), ("IsisCube", "BandBin", "yes"), ("IsisCube", "BandBin"), ("IsisCube",)]


def test_keyword_faults(spark):
    small = lb.KeywordLimits(size=2_000, depth=3, statements=5, items=4)
    cases = {
        b"": None, b"A = 1": None, b"a = (1, 2, 3, 4)": None, b"End": None, b"End_x = 3": None, b"A = End\nEND": None,
        b"A = Object Object = B End_Object": None, b"Object=A Group=B End_Group = 'any' End_Object = B End": None,
        b"x" * 2_001: lb.TOO_LARGE, b"a = (1, 2, 3, 4, 5)": lb.TOO_LARGE, b"a = (1, 2, 3, 4, 5, =": lb.TOO_LARGE, b"a=1 b=2 c=3 d=4 e=5 f=6": lb.TOO_LARGE, b"a=1 b=2 c=3 d=4 e=5 f=(": lb.TOO_LARGE,
        b"Group=a Group=b Group=c Group=d": lb.TOO_LARGE, b"Group=a\n" * 60: lb.TOO_LARGE,
        b"A = (1, (2))": lb.UNPARSEABLE, b"A = (1 2)": lb.UNPARSEABLE, b"A = \"open": lb.UNPARSEABLE, b"A = 1 /* open": lb.UNPARSEABLE, b"A = 5 <km": lb.UNPARSEABLE, b"A": lb.UNPARSEABLE, b"A =": lb.UNPARSEABLE,
        b"= 3": lb.UNPARSEABLE, b"End_Object": lb.UNPARSEABLE, b"Object = A End_Group": lb.UNPARSEABLE, b"Object = A": lb.UNPARSEABLE, b"Object = 5 End_Object": lb.UNPARSEABLE, b"End_Group = 5": lb.UNPARSEABLE,
        b"T = 2021-06-01T12:00:00Z": lb.UNPARSEABLE, b"A = \xff": lb.UNPARSEABLE, b"A = 1 ; B = 2": lb.UNPARSEABLE, b"\x0c A = 1": lb.UNPARSEABLE, None: lb.UNPARSEABLE, b"<a/>": lb.UNPARSEABLE,
    }
    code, _ = _run(spark, lb.keyword_labels, list(cases), small)
    assert [code[i] for i in range(len(cases))] == list(cases.values())


def test_keyword_long_lists_and_replaced_blocks(spark):
    long = b"a = (" + b", ".join(b"%d" % i for i in range(10_000)) + b")"
    twice = b"Group = g x = 1 y = 2 End_Group x = 0 Group = g x = 3 End_Group x = 5 Object = x k = 1 End_Object Group = h g = 7 End_Group"
    code, fields = _run(spark, lb.keyword_labels, [long, long.replace(b")", b", 1)"), twice])
    assert code == {0: None, 1: lb.TOO_LARGE, 2: None}
    assert len(fields[0]["items"]) == 10_000
    kept = [(*r["path"], r["keyword"], r["items"][0]["value"]) for r in fields[1:] if r["effective"] and r["items"]]
    assert kept == [("g", "x", "3"), ("x", "k", "1"), ("h", "g", "7")]


def test_xml_faults(spark):
    small = lb.XmlLimits(size=3_000, depth=4, elements=8, attributes=3)
    cases = {
        b"<a/>": None, b"<?xml version='1.0'?><a><b>t</b><!-- c --><b/></a>\n": None, b"<a x='1' y=\"2\" z='3'/>": None, b"<a><b><c><d/></c></b></a>": None, b"\xef\xbb\xbf<a/>": None,
        b"<p:a xmlns:p='u'><p:b p:c='1'/></p:a>": None, b"<a>Solar SYSTEM https://x.org/?a=1&amp;b</a>": None, b"<a><![CDATA[<b>&x;]]></a>": None, b"<a>&#65;&#x42;</a>": None,
        b"<!DOCTYPE a><a/>": lb.HOSTILE, b"<! doctype a [<!ENTITY x 'y'>]><a>&x;</a>": lb.HOSTILE, b"<a><!ENTITY x></a>": lb.HOSTILE, b"<a><!-- <!DOCTYPE --></a>": lb.HOSTILE,
        b"<a>" + b"x" * 3_000 + b"</a>": lb.TOO_LARGE, b"<!DOCTYPE a>" + b"x" * 3_000: lb.TOO_LARGE, b"<a><b><c><d><e/></d></c></b></a>": lb.TOO_LARGE, b"<a>" * 200: lb.TOO_LARGE, b"<a>" + b"<b/>" * 9 + b"</a>": lb.TOO_LARGE, b"<a a='1' b='2' c='3' d='4'/>": lb.TOO_LARGE,
        b"": lb.UNPARSEABLE, b"plain": lb.UNPARSEABLE, b"<a>": lb.UNPARSEABLE, b"<a></b>": lb.UNPARSEABLE, b"<a/><b/>": lb.UNPARSEABLE, b"<a/>text": lb.UNPARSEABLE, b"<a x='1' x='2'/>": lb.UNPARSEABLE, b"<a x=1/>": lb.UNPARSEABLE,
        b"<a>&nbsp;</a>": lb.UNPARSEABLE, b"<a>&</a>": lb.UNPARSEABLE, b"<p:a/>": lb.UNPARSEABLE, b"<a p:x='1'/>": lb.UNPARSEABLE, b"<a>\xff</a>": lb.UNPARSEABLE, b"<a><b></a></b>": lb.UNPARSEABLE, b"< a/>": lb.UNPARSEABLE,
        b"<a><!-- a -- b --></a>": lb.UNPARSEABLE, b" <?xml version='1.0'?><a/>": lb.UNPARSEABLE, b"</a>": lb.UNPARSEABLE, b"<a>]]></a>": lb.UNPARSEABLE, None: lb.UNPARSEABLE, b"<a x='<'/>": lb.UNPARSEABLE,
    }
    code, _ = _run(spark, lb.xml_labels, list(cases), small)
    assert [code[i] for i in range(len(cases))] == list(cases.values())


def _noise(rng: random.Random) -> bytes:
    def node(depth):
        tag = rng.choice(["a", "b:c", "Axis_Array", "x-1"])
        inner = "".join(rng.choice(["t", " &lt;&#233; ", "<![CDATA[<q>]]>", "<!-- n -->", node(depth + 1) if depth < 4 else "."]) for _ in range(rng.randrange(4)))
        attr = "".join(rng.sample([" u='1'", ' v="2 > 1"', " b:w='&amp;'"], rng.randrange(3)))
        return f"<{tag}{attr}>{inner}</{tag}>" if inner else f"<{tag}{attr}/>"

    text = f"<?xml version='1.0' encoding='UTF-8'?>\n<r xmlns:b='u'>{node(0)}{node(0)}</r>"
    for _ in range(rng.randrange(3)):  # mutilate
        i = rng.randrange(40, len(text))
        text = text[:i] + rng.choice(["", "<", ">", "/", "'", "&", "x", "</a>", "<a>"]) + text[i + rng.randrange(3) :]
    return text.encode()


@pytest.mark.parametrize("seed", [1, 2])
def test_xml_against_the_standard_library(spark, seed):
    rng = random.Random(seed)
    datas = [_noise(rng) for _ in range(150)]
    code, elements = _run(spark, lb.xml_labels, datas)
    local = lambda t: t.rsplit("}", 1)[-1].rsplit(":", 1)[-1]
    sound = 0
    for i, data in enumerate(datas):
        try:
            root = ET.fromstring(data)  # noqa: S314
        except (ET.ParseError, ValueError):
            assert code[i] == lb.UNPARSEABLE, data
            continue
        assert code[i] is None, data
        sound += 1
        want = [(local(e.tag), e.text) for e in root.iter()]
        assert [(r["name"], r["text"]) for r in elements if r["label_id"] == i] == want, data
    assert 10 < sound < 150


def test_empty_tables(spark):
    for read in (lb.keyword_labels, lb.xml_labels):
        assert _run(spark, read, []) == ({}, [])
