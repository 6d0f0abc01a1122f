"""Content-stream syntax: tokens, operations, strings, names, dictionary keys and ToUnicode maps.

Plain functions on bytes, used by the table functions below and inside Arrow batches. They refuse with SyntaxRefusal,
whose rule names the reason; the callers turn refusals into rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: White space and delimiters of the syntax, and its ceilings.
WHITE = b"\x00\t\n\x0c\r \x80\xff"
DELIMITERS = b"()<>[]{}/%"
MOST_NESTED, MOST_TOKEN, MOST_STRING, MOST_OPERANDS, MOST_OPERATIONS = 64, 255, 32_767, 64, 1 << 20
MOST_NAMES, MOST_KEYS, MOST_CODES = 65_536, 4_096, 65_536
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\x08", b"f": b"\x0c", b"(": b"(", b")": b")", b"\\": b"\\", b"\n": b""}

_W, _D = re.escape(WHITE), re.escape(DELIMITERS)
TRIVIA = re.compile(rb"(?:[" + _W + rb"]|%[^\r\n]*)*")
WORD = re.compile(rb"[^" + _W + _D + rb"]+")
NUMERIC = re.compile(rb"[0-9+.\-]+")
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
HEX = re.compile(rb"<[^>]*>")


class SyntaxRefusal(ValueError):
    def __init__(self, rule: str, kind: str = "Malformed"):
        super().__init__(rule)
        self.rule, self.kind = rule, kind


class Token(NamedTuple):
    kind: str  # name, dict_open, dict_close, array_open, array_close, brace, string, number, keyword
    value: bytes
    start: int
    end: int


def _name(raw: bytes, start: int, end: int) -> bytes:
    out, at = bytearray(), start + 1
    while at < end:
        if raw[at : at + 1] == b"#":
            pair = raw[at + 1 : at + 3]
            if len(pair) < 2:
                raise SyntaxRefusal("truncated-escape")
            if not re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                raise SyntaxRefusal("bad-escape")
            out.append(int(pair, 16))
            at += 3
        else:
            out += raw[at : at + 1]
            at += 1
    return bytes(out)


def _string_end(raw: bytes, at: int) -> int:
    depth = 0
    for m in re.compile(rb"\\.|[()]", re.DOTALL).finditer(raw, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    raise SyntaxRefusal("unclosed-string")


def tokens(raw: bytes, strict: bool = False, at: int = 0) -> Iterator[Token]:
    """The tokens of a content stream from a place on. strict: bytes 0x80 and 0xFF between tokens refuse.

    The data of an inline image are skipped by the length that its dictionary gives; an image without one ends
    the reading, as a last token of kind `unknown_extent`, or refuses if strict.
    """
    image, n = None, len(raw)
    while True:
        m = TRIVIA.match(raw, at)
        if strict and re.search(rb"[\x80\xff]", re.sub(rb"%[^\r\n]*", b"", m[0])):
            raise SyntaxRefusal("high-byte-separator")
        start = at = m.end()
        if at >= n:
            return
        byte = raw[at : at + 1]
        if byte == b"/":
            word = WORD.match(raw, at + 1)
            at = word.end() if word else at + 1
            if at - start > MOST_TOKEN:
                raise SyntaxRefusal("name-token-too-long", "Unsupported")
            yield Token("name", _name(raw, start, at), start, at)
        elif byte == b"(":
            at = _string_end(raw, at)
            yield Token("string", raw[start:at], start, at)
        elif raw.startswith((b"<<", b">>"), at):
            at += 2
            yield Token("dict_open" if byte == b"<" else "dict_close", raw[start:at], start, at)
        elif byte == b"<":
            word = HEX.match(raw, at)
            if not word:
                raise SyntaxRefusal("unclosed-string")
            at = word.end()
            yield Token("string", word[0], start, at)
        elif byte in b"[]{}":
            at += 1
            yield Token({b"[": "array_open", b"]": "array_close"}.get(byte, "brace"), byte, start, at)
        elif byte in b">)":
            raise SyntaxRefusal("stray-close")
        else:
            word = WORD.match(raw, at)
            at = word.end()
            if NUMERIC.fullmatch(word[0]):
                yield Token("number", word[0], start, at)
                continue
            if word[0] == b"BI":
                if image is not None:
                    raise SyntaxRefusal("inline-image-nested-bi")
                image = at
            yield Token("keyword", word[0], start, at)
            if word[0] == b"ID":
                if image is None:
                    raise SyntaxRefusal("inline-image-without-bi")
                size = _image_bytes(raw[image:start])
                image = None
                if size is None:
                    if strict:
                        raise SyntaxRefusal("inline-image-filtered")
                    yield Token("unknown_extent", b"", at, n)
                    return
                at += 1 + size
                tail = re.compile(rb"[" + _W + rb"]*EI(?=[" + _W + _D + rb"]|\Z)").match(raw, at)
                if not tail:
                    raise SyntaxRefusal("inline-image-without-ei")
                at = tail.end() - 2


#: Components of the device colour spaces, by their inline names.
COMPONENTS = {b"G": 1, b"DeviceGray": 1, b"RGB": 3, b"DeviceRGB": 3, b"CMYK": 4, b"DeviceCMYK": 4}


def _image_bytes(dictionary: bytes) -> int | None:
    """The bytes of an unfiltered inline image's data; None if a filter or an unknown colour space hides them."""
    pairs: dict[bytes, Token] = {}
    key = None
    for t in tokens(dictionary):
        if key is None:
            key = t.value if t.kind == "name" else None
        else:
            pairs[key], key = t, None
    if pairs.keys() & {b"F", b"Filter"}:
        return None

    def whole(*names: bytes) -> int | None:
        found = next((pairs[k] for k in names if k in pairs), None)
        return int(found.value) if found and re.fullmatch(rb"\d+", found.value) else None

    width, height, bits = whole(b"W", b"Width"), whole(b"H", b"Height"), whole(b"BPC", b"BitsPerComponent")
    mask = next((pairs[k].value for k in (b"IM", b"ImageMask") if k in pairs), b"false")
    space = next((pairs[k].value for k in (b"CS", b"ColorSpace") if k in pairs), None)
    parts, bits = (1, 1) if mask == b"true" else (COMPONENTS.get(space), bits)
    if None in (width, height, bits, parts):
        return None
    return (width * parts * bits + 7) // 8 * height


class Operation(NamedTuple):
    operator: bytes
    operands: list[Token]
    start: int
    end: int


def operations(raw: bytes, strict: bool = False) -> Iterator[Operation]:
    """Operators with the tokens before them; operand counts, nesting and the number of operations are bounded."""
    held: list[Token] = []
    opened: list[str] = []
    count = top = 0
    for t in tokens(raw, strict):
        if t.kind in ("array_open", "dict_open"):
            top += not opened
            opened.append(t.kind[:-5])
            if len(opened) > MOST_NESTED:
                raise SyntaxRefusal("too-deep", "Unsupported")
        elif t.kind in ("array_close", "dict_close"):
            if not opened or opened.pop() != t.kind[:-6]:
                raise SyntaxRefusal("unbalanced")
        elif t.kind == "keyword" and t.value not in (b"true", b"false", b"null"):
            if opened:
                raise SyntaxRefusal("operator-inside-operand")
            count += 1
            if count > MOST_OPERATIONS:
                raise SyntaxRefusal("too-many-operations", "Unsupported")
            yield Operation(t.value, held, held[0].start if held else t.start, t.end)
            held, top = [], 0
            continue
        else:
            top += not opened
        if top > MOST_OPERANDS:
            raise SyntaxRefusal("too-many-operands", "Unsupported")
        held.append(t)
    if opened or held and held[-1].kind != "unknown_extent":
        raise SyntaxRefusal("operands-without-operator")


def names_in(raw: bytes) -> tuple[list[bytes], bool]:
    """The distinct names of a stream, sorted, and whether it was read to its end."""
    found, whole = set(), True
    for t in tokens(raw):
        whole = whole and t.kind != "unknown_extent"
        if t.kind == "name":
            found.add(t.value)
            if len(found) > MOST_NAMES:
                raise SyntaxRefusal("too-many-names", "Unsupported")
    return sorted(found), whole


def numbers_in(raw: bytes) -> list[float]:
    return [float(t.value) for t in tokens(raw) if t.kind == "number" and NUMBER.match(t.value)]


def top_keys(raw: bytes) -> list[bytes]:
    """The keys of a dictionary's own entries, in order, not those of values inside it."""
    depth, key, out = 0, True, []
    for t in tokens(raw):
        if t.kind in ("dict_open", "array_open"):
            depth += 1
            key = key if depth > 1 else True
        elif t.kind in ("dict_close", "array_close"):
            depth -= 1
            key = depth == 1 or key
        elif depth == 1:
            if key and t.kind == "name":
                out.append(t.value)
                key = False
                if len(out) > MOST_KEYS:
                    raise SyntaxRefusal("too-many-keys", "Unsupported")
            elif not key:
                key = t.kind != "number" or not re.match(rb"\s*\d+\s+R\b", raw[t.end :])
    return out


def decode_string(raw: bytes) -> bytes:
    """The bytes that a literal or hexadecimal string token stands for."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[\s\x00]", b"", raw[1:-1])
        if raw[-1:] != b">" or not re.fullmatch(rb"[0-9A-Fa-f]*", digits):
            raise SyntaxRefusal("bad-hex-string")
        out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        if raw[:1] != b"(" or _string_end(raw, 0) != len(raw):
            raise SyntaxRefusal("bad-literal-string")

        def one(m: re.Match) -> bytes:
            if m[1]:
                return bytes([int(m[1], 8) & 255])
            if m[0] == b"\r":
                raise SyntaxRefusal("raw-carriage-return", "Unsupported")
            return b"" if m[2] in (b"\r", b"\r\n") else ESCAPES.get(m[2], m[2])

        out = re.sub(rb"\\(?:([0-7]{1,3})|(\r\n|.))|\r", one, raw[1:-1], flags=re.DOTALL)
    if len(out) > MOST_STRING:
        raise SyntaxRefusal("string-too-long", "Unsupported")
    return out


def encode_literal(value: bytes) -> bytes:
    return b"(" + re.sub(rb"[()\\]", rb"\\\g<0>", value).replace(b"\n", b"\\n").replace(b"\r", b"\\r") + b")"


def to_unicode(raw: bytes) -> tuple[list[tuple[bytes, bytes]], dict[int, list[tuple[int, bytes]]]]:
    """A ToUnicode map: its codespace ranges, and code -> [(digits of the code, UTF-16 bytes)]."""
    spaces, codes = [], {}
    block, held, depth = b"", [], 0

    def put(code: int, digits: int, value: bytes) -> None:
        codes.setdefault(code, []).append((digits, value))
        if len(codes) > MOST_CODES:
            raise SyntaxRefusal("too-many-codes", "Unsupported")

    for t in tokens(raw):
        if t.kind == "keyword":
            if t.value in (b"begincodespacerange", b"beginbfchar", b"beginbfrange"):
                block, held = t.value[5:], []
                continue
            if t.value == b"end" + block and block:
                if block == b"bfrange":
                    _ranges(held, put)
                elif len(held) % 2:
                    raise SyntaxRefusal("odd-entries")
                else:
                    for a, b in zip(held[::2], held[1::2], strict=True):
                        if block == b"codespacerange":
                            spaces.append((a, b))
                        else:
                            put(int.from_bytes(a), 2 * len(a), b)
            block = b""
        elif block:
            if t.kind in ("array_open", "array_close"):
                depth += 1 if t.kind == "array_open" else -1
                held.append(t.kind)
            elif t.kind == "string":
                held.append(decode_string(t.value))
    return spaces, codes


def _ranges(held: list, put) -> None:
    at = 0
    while at < len(held):
        if len(held) < at + 3:
            raise SyntaxRefusal("odd-entries")
        low, high, to = held[at : at + 3]
        a, b = int.from_bytes(low), int.from_bytes(high)
        if b < a or b - a >= MOST_CODES:
            raise SyntaxRefusal("bad-range")
        if to == "array_open":
            end = held.index("array_close", at)
            for k, value in enumerate(held[at + 3 : end][: b - a + 1]):
                put(a + k, 2 * len(low), value)
            at = end + 1
        else:
            base = int.from_bytes(to)
            for k in range(b - a + 1):
                put(a + k, 2 * len(low), (base + k).to_bytes(max(1, len(to))))
            at += 3
