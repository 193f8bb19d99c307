import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import ids, labels
from folioscope.functions import text as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rounding_is_half_to_even(spark):
    box = G.box_to_pixels(G.Box(*(F.lit(v) for v in (0.5, 1.5, 2.5, 3.5))), F.lit(1000), F.lit(1000))
    assert tuple(one(spark, *box.columns())) == (0, 2, 2, 4)


def test_boxes(spark):
    a, b = G.Box(*map(F.lit, (0, 0, 10, 10))), G.Box(*map(F.lit, (5, 5, 15, 15)))
    assert one(spark, G.iou(a, b))[0] == 25 / 175
    assert one(spark, G.iou(a, G.Box(*map(F.lit, (10, 0, 20, 10)))))[0] == 0.0
    flat = G.Box(*map(F.lit, (3, 3, 3, 3)))
    assert one(spark, G.iou(flat, flat))[0] == 0.0
    assert tuple(one(spark, *G.union_box(a, b).columns())) == (0, 0, 15, 15)
    assert tuple(one(spark, *G.expand_box(b, 7, F.lit(20), F.lit(18)).columns())) == (0, 0, 20, 18)
    assert tuple(one(spark, *G.normalize_box(b, F.lit(0), F.lit(100)).columns())) == (None, 50.0, None, 150.0)
    for values, ok in (((0, 0, 1000, 1000), True), ((0, 0, 1000.1, 5), False), ((5, 0, 5, 5), False), ((6, 0, 5, 5), False), ((-1, 0, 5, 5), False)):
        assert one(spark, G.valid_box(G.Box(*map(F.lit, values))))[0] is ok
    assert one(spark, G.valid_box(G.Box(F.lit(None), *map(F.lit, (0, 1, 1)))))[0] is False


def test_polygons(spark):
    def at(points):
        return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))

    none = F.array().cast("array<struct<x:double,y:double>>")
    box = G.Box(*map(F.lit, (0, 0, 2, 2)))
    triangle = at([(0, 0), (2, 0), (0, 2)])
    assert one(spark, G.region_iou(triangle, box, none, box))[0] == pytest.approx(0.5)
    assert one(spark, G.region_iou(at([(0, 0), (1, 1)]), box, none, box))[0] == 1.0  # two points are no polygon
    dart = at([(0, 0), (2, 0), (2, 2), (1, 0.5), (0, 2)])
    assert one(spark, G.region_iou(dart, box, at([(0, 0), (2, 0), (2, 1), (0, 1)]), box))[0] == pytest.approx((11 / 6) / (2.5 + 2 - 11 / 6))
    bow = at([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert one(spark, G.region_iou(bow, box, none, box))[0] == pytest.approx(0.5)


def test_clipping_equals_slabs():
    r = random.Random(3)
    for _ in range(300):
        shapes = []
        for _ in range(2):
            turns = sorted(r.random() * 2 * math.pi for _ in range(r.randint(3, 8)))
            cx, cy, size = (r.random() * 3 for _ in range(3))
            shapes.append([(cx + (size + 0.2) * math.cos(t), cy + (size + 0.2) * math.sin(t)) for t in turns][:: r.choice((1, -1))])
        import numpy as np

        assert G.areas(*shapes) == pytest.approx(G.polygon_areas(*map(np.array, shapes)), abs=1e-9)


@pytest.mark.parametrize(("a", "b", "n"), [("a b c d", "a x c", 2), ("", "a b", 2), ("a b", "", 2), ("", "", 0), ("a b", "a b", 0)])
def test_word_distance(spark, a, b, n):
    assert one(spark, T.word_distance(T.words(F.lit(a)), T.words(F.lit(b))))[0] == n


def test_rates(spark):
    rate = lambda a, b: one(spark, T.htr_metrics(F.lit(a), F.lit(b)))[0]
    m = rate("سلام", "سَلام")
    assert (m["char_errors"], m["ref_chars"], m["cer"]) == (1, 4, 0.25)
    assert rate("x", "")["cer"] == 1.0 and rate("", "")["cer"] == 0.0 and rate("", "x")["wer"] == 1.0
    assert rate("a", "abc")["cer"] == 2.0
    assert rate("a b\x1cc", "a")["ref_words"] == 3 and rate("😀", "x")["char_errors"] == 1


def test_directions(spark):
    rows = spark.createDataFrame([("12 سلام a",), ("1 a س",), ("12",), ("",), (None,), ("שלום",)], "t string")
    assert [r[0] for r in rows.select(T.direction("t")).collect()] == ["rtl", "ltr", "auto", "auto", None, "rtl"]


def test_labels(spark):
    cases = {" Main ": "main_text", "Body-Text": "main_text", "STAMP seal": "stamp_or_seal", "cataloguing mark": "archival_mark", "unknown": "unknown", "Title": "unknown", "": "unknown", None: "unknown", "marginal_text": "marginal_text"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", labels.region_type(F.col("t")), labels.display_label(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == cases
    shown = {r[0]: r[2] for r in rows}
    assert shown[None] == shown[""] == "Unclassified region" and shown["Title"] == "Title" and shown["marginal_text"] == "Marginal text"
    assert one(spark, labels.system_name(F.lit("other")))[0] == "other"


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/crops/p1/r.1.png",), ("crops/p1/r2.png",), ("crops/p2/r2.png",), ("xcrops/p1/r2.png",), (None,)], "i string")
    assert [r[0] for r in rows.select(ids.region_of_crop(F.col("i"), F.lit("p1"))).collect()] == ["r.1", "r2", None, None, None]
    paths = {"../data/x/y.png": "x/y.png", "x/../y.png": "y.png", "../y.png": None, "x/../../data/y": None, "/etc/x": None, "./a/./b": "a/b"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", ids.within_root(F.col("p"))).collect()
    assert dict(map(tuple, rows)) == paths
    assert tuple(one(spark, ids.stem(F.lit("a/b.c.xml")), ids.suffix(F.lit("a/b.C.XML")))) == ("b.c", "xml")


def test_replies(spark):
    cases = {'{"a": 1}': '{"a":1}', ' \n```json\n{"a": 1}\n```\n': '{"a":1}', '```\n{"a": 1}': '{"a":1}', "[1]": None, "no": None, '```json\n[1]\n```': None}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", F.to_json(ids.reply_object(F.col("c")))).collect()
    assert dict(map(tuple, rows)) == cases
    assert one(spark, ids.data_url(F.lit("x.JPG"), F.lit(b"ab")), ids.data_url(F.lit("x.gif"), F.lit(b"ab")))[0] == "data:image/jpeg;base64,YWI="


def test_data_urls_and_file_names_of_odd_paths(spark):
    """A long content stays one line of base64, and a line feed at the end belongs to the name."""
    import base64

    long = bytes(range(256)) * 20
    assert one(spark, ids.data_url(F.lit("x.png"), F.lit(long)))[0] == "data:image/png;base64," + base64.b64encode(long).decode()
    assert list(one(spark, *(ids.file_name(F.lit(p)) for p in ("a/b", "a/b//", "a/\n", "a/b\n", "///", "")))) == ["b", "b", "\n", "b\n", "", ""]


def test_directions_of_all_characters(spark):
    """The pattern and Unicode's own table agree on every code point."""
    import unicodedata

    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes if c < 0x30000 or c % 97 == 0], "c int, t string")
    want = {"L": "ltr", "R": "rtl", "AL": "rtl"}
    found = {r["c"]: r["d"] for r in rows.select("c", T.direction("t").alias("d")).collect()}
    assert all(d == want.get(unicodedata.bidirectional(chr(c)), "auto") for c, d in found.items()) and len(found) > 190_000


def test_distances_equal_the_built_in(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abé😀 س"[: r.randint(1, 7)]) for _ in range(r.choice((0, 1, 5, 63, 64, 65, 200, 700)))) for _ in range(160)]
    pairs = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)] + [(a, a[:40] + "x" + a[41:]) for a in texts] + [(None, "x"), ("x", None)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    found = rows.select(T.char_distance(F.col("a"), F.col("b")).alias("mine"), F.levenshtein("a", "b").alias("built_in"), T.word_distance(F.split("a", "é"), F.split("b", "é")).alias("words"), "a", "b").collect()
    assert all(x["mine"] == x["built_in"] for x in found)
    code = {}
    for x in found[:160]:
        one, other = ("".join(chr(0x4E00 + code.setdefault(w, len(code))) for w in x[c].split("é")) for c in ("a", "b"))
        assert x["words"] == T.distance(one, other)


def test_convex_polygons_are_clipped_together(monkeypatch):
    import random

    import pyarrow as pa
    from folioscope.functions import geometry

    r = random.Random(3)

    def cut(x, y, w, h):
        return [(x + w / 3, y), (x + w, y), (x + w, y + h - w / 3), (x + 2 * w / 3, y + h), (x, y + h), (x, y + w / 3)]

    def shape(k):
        if k == 0:
            return None
        return cut(*(r.randint(30, 90) for _ in range(4))) if k < 4 else [(r.randint(0, 99), r.randint(0, 99)) for _ in range(r.randint(0, 6))]

    points = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    boxes = pa.struct([(c, pa.float64()) for c in geometry.Box._fields])
    shapes = [[(s := shape(r.randint(0, 6))) and [{"x": float(x), "y": float(y)} for x, y in s] for _ in range(400)] for _ in range(2)]
    around = [[dict(zip(geometry.Box._fields, (float(r.randint(0, 40)), float(r.randint(0, 40)), float(r.randint(50, 90)), float(r.randint(50, 90))))) for _ in range(400)] for _ in range(2)]
    columns = lambda n: tuple(pa.array(v[:n], t) for i in range(2) for v, t in ((shapes[i], points), (around[i], boxes)))
    got = next(geometry._polygon_iou(iter([columns(400)]))).to_pylist()
    for a, b, c, d, found in zip(shapes[0], around[0], shapes[1], around[1], got, strict=True):
        one, other, shared = geometry.areas(geometry._shape(a, b), geometry._shape(c, d))
        assert abs(found - (shared / (one + other - shared) if one + other - shared else 0.0)) < 1e-12
    monkeypatch.setattr(geometry, "areas", None)  # none of these goes one by one
    shapes = [[[{"x": float(x), "y": float(y)} for x, y in cut(i, 2 * i, 60, 90)] for i in range(50)], [[{"x": float(x), "y": float(y)} for x, y in cut(i + 5, i, 90, 60)] for i in range(50)]]
    assert len(next(geometry._polygon_iou(iter([columns(50)])))) == 50


def test_distances_hold_few_objects_at_once():
    import pyarrow as pa

    class Part:
        def __init__(self, of):
            self.of = of

        def __len__(self):
            return len(self.of)

        def slice(self, at, n):
            assert n <= 256
            return self.of.slice(at, n)

    texts = [f"text {i % 7}" for i in range(600)] + [None]
    got = next(T._distances(iter([(Part(pa.array(texts)), Part(pa.array(texts[1:] + ["x"])))]))).to_pylist()
    assert got == [None if a is None or b is None else T.distance(a, b) for a, b in zip(texts, texts[1:] + ["x"], strict=True)]
