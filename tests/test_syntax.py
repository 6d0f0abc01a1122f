import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.functions import syntax as s


def kinds(raw, **k):
    return [(t.kind, t.value) for t in s.tokens(raw, **k)]


def test_tokens():
    assert kinds(b"/F#311 12.5 Tf % c\n(a(b)\\)) <4 1> [1 true] << /K >> {x") == [
        ("name", b"F11"), ("number", b"12.5"), ("keyword", b"Tf"), ("string", b"(a(b)\\))"), ("string", b"<4 1>"), ("array_open", b"["),
        ("number", b"1"), ("keyword", b"true"), ("array_close", b"]"), ("dict_open", b"<<"), ("name", b"K"), ("dict_close", b">>"),
        ("brace", b"{"), ("keyword", b"x"),
    ]
    assert kinds(b"12abc -.5") == [("keyword", b"12abc"), ("number", b"-.5")]


@pytest.mark.parametrize(
    "raw, rule",
    [(b"(a", "unclosed-string"), (b"<12", "unclosed-string"), (b")", "stray-close"), (b">", "stray-close"), (b"/a#4", "truncated-escape"),
     (b"/a#zz", "bad-escape"), (b"/" + b"a" * 255, "name-token-too-long"), (b"ID x", "inline-image-without-bi"), (b"BI BI", "inline-image-nested-bi")],
)
def test_refusals(raw, rule):
    with pytest.raises(s.SyntaxRefusal, match=rule):
        list(s.tokens(raw))


def test_separators():
    assert kinds(b"1\x802") == [("number", b"1"), ("number", b"2")]
    with pytest.raises(s.SyntaxRefusal, match="high-byte-separator"):
        list(s.tokens(b"1\x802", strict=True))
    assert kinds(b"% \x80\n1", strict=True) == [("number", b"1")]


def test_inline_images():
    # 5 x 3 pixels of three components of 8 bits: 45 bytes, among them what looks like names and an end
    data = (b"/Hid <</Den 1>> EI (not a string " * 2)[:45]
    raw = b"/Before gs BI /Width 5 /Height 3 /ColorSpace /RGB /BitsPerComponent 8 ID " + data + b"\nEI /After gs"
    assert s.names_in(raw) == ([b"After", b"Before", b"BitsPerComponent", b"ColorSpace", b"Height", b"RGB", b"Width"], True)
    # a filter hides how long the data are, so nothing behind it is read
    names, whole = s.names_in(b"/Seen Do BI /Height 9 /Width 9 /Filter /AHx ID 00ff> EI /Unseen Do")
    assert b"Seen" in names and b"Unseen" not in names and not whole


def test_operations():
    ops = list(s.operations(b"q 1 0 0 1 5 6 cm\n[(a) -20 (b)] TJ Q"))
    assert [(o.operator, len(o.operands)) for o in ops] == [(b"q", 0), (b"cm", 6), (b"TJ", 5), (b"Q", 0)]
    assert ops[1].start == 2 and ops[1].end == 16
    for raw, rule in ((b"[1 Tj]", "operator-inside-operand"), (b"]", "unbalanced"), (b"1 2", "operands-without-operator"), (b"1 " * 65 + b"x", "too-many-operands"), (b"[" * 65, "too-deep")):
        with pytest.raises(s.SyntaxRefusal, match=rule):
            list(s.operations(raw))


@given(st.binary(max_size=60))
def test_literal_round_trip(value):
    assert s.decode_string(s.encode_literal(value)) == value


def test_strings():
    assert s.decode_string(b"(\\101\\7x\\\n\\q\\()") == b"A\x07xq("
    assert s.decode_string(b"(\\400)") == b"\x00"
    assert s.decode_string(b"<48 65 6>") == b"He`"
    for raw, rule in ((b"(a\rb)", "raw-carriage-return"), (b"(a))", "bad-literal-string"), (b"<4x>", "bad-hex-string")):
        with pytest.raises(s.SyntaxRefusal, match=rule):
            s.decode_string(raw)


def test_keys_numbers_maps():
    assert s.top_keys(b"<< /A 1 /B << /C 2 >> /D [/E /F] /G /H /I 3 0 R /J (x) >>") == [b"A", b"B", b"D", b"G", b"I", b"J"]
    assert s.numbers_in(b"1 -2.5 .5 4. x 5x") == [1.0, -2.5, 0.5, 4.0]
    raw = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <0079>] endbfrange"
    spaces, codes = s.to_unicode(raw)
    assert spaces == [(b"\x00", b"\xff")]
    assert {k: v[0][1].decode("utf-16-be") for k, v in codes.items()} == {1: "A", 2: "a", 3: "b", 4: "c", 5: "x", 6: "y"}
