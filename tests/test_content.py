import pytest

from quire.functions import content as c
from quire.functions.syntax import SyntaxRefusal

FONTS = {"F1": ({65: 500, 32: 250}, 600, (0, -200, 700, 800))}


def test_text_positions():
    raw = b"BT /F1 10 Tf 100 50 Td 2 Tc 5 Tw (A A) Tj [(A) -1000 (A)] TJ 0 -12 TD T* (A) Tj ET"
    got = [(round(x.x, 6), round(x.y, 6), x.code) for x in c.walk(raw, FONTS)]
    assert got == [
        (100, 50, 65), (107, 50, 32), (116.5, 50, 65), (123.5, 50, 65), (140.5, 50, 65), (100, 26, 65),
    ]


def test_state_scale_and_boxes():
    raw = b"q 2 0 0 2 10 0 cm BT /F1 10 Tf 50 Tz 1 0 0 1 5 5 Tm (A) Tj ET Q 1 w 0 0 10 20 re S 5 5 m 6 9 l f sh"
    glyph, stroke, fill, shade = c.walk(raw, FONTS)
    assert (glyph.x, glyph.y) == (20, 10) and glyph.box == (20, 6, 27, 26)
    assert stroke.box == (-0.5, -0.5, 10.5, 20.5) and fill.box == (5, 5, 6, 9) and shade.box is None


def test_forms():
    forms = {"X": ((1, 0, 0, 1, 7, 0), b"BT /F1 1 Tf (A) Tj ET /Y Do"), "Y": (c.IDENTITY, b"0 0 1 1 re f"), "Z": (c.IDENTITY, b"/Z Do")}
    glyph, ink = c.walk(b"1 0 0 1 1 1 cm /X Do", FONTS, forms)
    assert (glyph.x, glyph.y, glyph.path) == (8, 1, ("X",)) and ink.path == ("X", "Y")
    for raw, rule in ((b"/Z Do", "form-cycle"), (b"Q", "unbalanced-restore"), (b"BT (A) Tj", "font-unknown"), (b"1 cm", "too-few-operands")):
        with pytest.raises(SyntaxRefusal, match=rule):
            list(c.walk(raw, FONTS, forms))


def test_own_resources_of_forms():
    narrow = {"F1": ({65: 100}, 600, (0, -200, 700, 800))}
    text = b"BT /F1 10 Tf (AA) Tj ET /Y Do"
    forms = {"own": (c.IDENTITY, text, narrow, {}), "none": (c.IDENTITY, text), "Y": (c.IDENTITY, b"0 0 1 1 re f")}
    first, second, outside = c.walk(b"/own Do", FONTS, forms)
    assert (first.x, second.x) == (0, 1) and outside.path == ("own",)  # Y is no form there
    first, second, inside = c.walk(b"/none Do", FONTS, forms)
    assert (first.x, second.x) == (0, 5) and inside.path == ("none", "Y")


def test_codes_of_two_bytes():
    fonts = {"C": ({0x0020: 500, 0x4142: 250}, 1000, (0, -100, 1000, 900), 2)}
    got = [(round(x.x, 6), x.code) for x in c.walk(b"BT /C 10 Tf 7 Tw <00204142> Tj <0021> Tj ET", fonts)]
    assert got == [(0, 0x20), (5, 0x4142), (7.5, 0x21)]  # no word spacing for a space of two bytes
    with pytest.raises(SyntaxRefusal, match="cut-code"):
        list(c.walk(b"BT /C 10 Tf (ABC) Tj ET", fonts))


def test_colours():
    raw = bytes([1, 2, 3, 4, 5, 6, 7, 8, 0, 0, 9, 10, 11, 12, 13, 14, 15, 16, 0, 0])
    assert c.rgba(raw, 2, 2, 10) == bytes([3, 2, 1, 4, 7, 6, 5, 8, 11, 10, 9, 12, 15, 14, 13, 16])
    assert c.rgba(raw, 1, 2, 10, alpha=False) == bytes([3, 2, 1, 11, 10, 9])


def test_glyph_rows(spark):
    from quire.sources.documents import glyph_rows

    streams = [(1, 1, bytearray(b"BT /F1 10 Tf (A) Tj ET 0 0 5 5 re f")), (1, 2, bytearray(b"Q")), (2, 1, None)]
    got = glyph_rows(spark.createDataFrame(streams, "doc_id long, page_no long, content binary"), FONTS).collect()
    assert [(r.doc_id, r.page_no, r.kind, r.code, r.rule) for r in got] == [
        (1, 1, "glyph", 65, None), (1, 1, "ink", None, None), (1, 2, "refused", None, "unbalanced-restore"),
    ]
