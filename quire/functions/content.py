"""A content-stream interpreter: from operations to placed glyphs and painted boxes.

It keeps a state stack and the two matrices of text, and yields rows (kind, ...): `glyph` with its origin, box, font, code and
operation, or `ink` with the box of a painted path, or None where the extent is not known (images drawn by name, shadings).
Fonts are a mapping name -> (code widths, default width, box of the font), in thousandths, and for composite fonts the
bytes of a code; forms are name -> (matrix, content), and the fonts and forms of their own resources where they have any.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from .syntax import SyntaxRefusal, decode_string, operations

#: The deepest nesting of forms, the most forms drawn, and the most inks of a page.
MOST_FORMS_DEEP, MOST_FORMS, MOST_INK = 16, 4_096, 200_000
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
PAINTS = frozenset(b"S s f F f* B B* b b*".split())


class Glyph(NamedTuple):
    x: float
    y: float
    box: tuple[float, float, float, float]
    font: str
    code: int
    op_ord: int
    path: tuple[str, ...]


class Ink(NamedTuple):
    box: tuple[float, float, float, float] | None
    op_ord: int
    path: tuple[str, ...]


def times(m: tuple, n: tuple) -> tuple:
    """First m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def placed(m: tuple, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def box_of(m: tuple, left: float, bottom: float, right: float, top: float) -> tuple:
    xs, ys = zip(*(placed(m, x, y) for x in (left, right) for y in (bottom, top)), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


class _State(NamedTuple):
    ctm: tuple = IDENTITY
    font: str = ""
    size: float = 0.0
    chars: float = 0.0
    words: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    width: float = 1.0


def walk(raw: bytes, fonts: dict, forms: dict | None = None) -> Iterator[Glyph | Ink]:
    drawn = [0]
    yield from _walk(raw, fonts, forms or {}, IDENTITY, (), drawn)


def _walk(raw: bytes, fonts: dict, forms: dict, ctm: tuple, path: tuple[str, ...], drawn: list[int]) -> Iterator[Glyph | Ink]:
    state, stack, tm, line = _State(ctm=ctm), [], IDENTITY, IDENTITY
    points: list[tuple[float, float]] = []
    inks = 0

    def show(text: bytes, at: int) -> Iterator[Glyph]:
        nonlocal tm
        if state.font not in fonts:
            raise SyntaxRefusal("font-unknown", "Unsupported")
        widths, usual, (l, b, r, t), *more = fonts[state.font]
        size = more[0] if more else 1
        if len(text) % size:
            raise SyntaxRefusal("cut-code")
        for k in range(0, len(text), size):
            code = int.from_bytes(text[k : k + size])
            w = widths.get(code, usual) / 1000
            whole = times((state.size * state.scale, 0, 0, state.size, 0, state.rise), times(tm, state.ctm))
            box = box_of(whole, min(0, l / 1000), min(0, b / 1000), max(w, r / 1000), t / 1000)
            yield Glyph(*placed(whole, 0, 0), box, state.font, code, at, path)
            move = (w * state.size + state.chars + (state.words if size == 1 and code == 32 else 0)) * state.scale
            tm = times((1, 0, 0, 1, move, 0), tm)

    def next_line(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = times((1, 0, 0, 1, x, y), line)

    for at, op in enumerate(operations(raw, strict=True)):
        name = op.operator
        numbers = [float(t.value) for t in op.operands if t.kind == "number"]
        strings = [t for t in op.operands if t.kind == "string"]
        try:
            if name == b"q":
                stack.append(state)
            elif name == b"Q":
                if not stack:
                    raise SyntaxRefusal("unbalanced-restore")
                state = stack.pop()
            elif name == b"cm":
                state = state._replace(ctm=times(tuple(numbers[:6]), state.ctm))
            elif name == b"BT":
                tm = line = IDENTITY
            elif name == b"Tf":
                state = state._replace(font=op.operands[0].value.decode("latin-1"), size=numbers[0])
            elif name in (b"Tc", b"Tw", b"TL", b"Ts", b"w"):
                field = {b"Tc": "chars", b"Tw": "words", b"TL": "leading", b"Ts": "rise", b"w": "width"}[name]
                state = state._replace(**{field: numbers[0]})
            elif name == b"Tz":
                state = state._replace(scale=numbers[0] / 100)
            elif name in (b"Td", b"TD"):
                if name == b"TD":
                    state = state._replace(leading=-numbers[1])
                next_line(numbers[0], numbers[1])
            elif name == b"Tm":
                tm = line = tuple(numbers[:6])
            elif name == b"T*":
                next_line(0, -state.leading)
            elif name == b"Tj":
                yield from show(decode_string(strings[0].value), at)
            elif name in (b"'", b'"'):
                if name == b'"':
                    state = state._replace(words=numbers[0], chars=numbers[1])
                next_line(0, -state.leading)
                yield from show(decode_string(strings[0].value), at)
            elif name == b"TJ":
                for t in op.operands:
                    if t.kind == "string":
                        yield from show(decode_string(t.value), at)
                    elif t.kind == "number":
                        tm = times((1, 0, 0, 1, -float(t.value) / 1000 * state.size * state.scale, 0), tm)
            elif name == b"re":
                x, y, w, h = numbers[:4]
                points += [placed(state.ctm, x + i, y + j) for i in (0, w) for j in (0, h)]
            elif name in (b"m", b"l", b"c", b"v", b"y"):
                points += [placed(state.ctm, x, y) for x, y in zip(numbers[::2], numbers[1::2], strict=False)]
            elif name in PAINTS or name in (b"sh", b"ID"):
                inks += 1
                if inks > MOST_INK:
                    raise SyntaxRefusal("too-much-ink", "Unsupported")
                if name in PAINTS and points:
                    xs, ys = zip(*points, strict=True)
                    reach = state.width / 2 * max(map(abs, state.ctm[:4])) if name[:1] in b"SsBb" else 0.0
                    yield Ink((min(xs) - reach, min(ys) - reach, max(xs) + reach, max(ys) + reach), at, path)
                elif name == b"ID":
                    yield Ink(box_of(state.ctm, 0, 0, 1, 1), at, path)
                elif name == b"sh":
                    yield Ink(None, at, path)
                points = []
            elif name == b"n":
                points = []
            elif name == b"Do":
                form = op.operands[0].value.decode("latin-1")
                if form not in forms:
                    yield Ink(box_of(state.ctm, 0, 0, 1, 1), at, path)
                    continue
                drawn[0] += 1
                if form in path:
                    raise SyntaxRefusal("form-cycle")
                if len(path) >= MOST_FORMS_DEEP or drawn[0] > MOST_FORMS:
                    raise SyntaxRefusal("forms-too-many", "Unsupported")
                matrix, content, *own = forms[form]
                inner = [*own, *(fonts, forms)[len(own) :]]
                yield from _walk(content, *inner, times(matrix, state.ctm), (*path, form), drawn)
        except (IndexError, ValueError) as wrong:
            if isinstance(wrong, SyntaxRefusal):
                raise
            raise SyntaxRefusal("too-few-operands") from wrong


def rgba(bgra: bytes, width: int, height: int, stride: int, alpha: bool = True) -> bytes:
    """BGRA rows of a given stride as packed RGBA, or RGB without alpha."""
    import numpy as np

    rows = np.frombuffer(bgra, np.uint8)[: stride * height].reshape(height, stride)[:, : 4 * width].reshape(height, width, 4)
    return rows[:, :, [2, 1, 0, 3] if alpha else [2, 1, 0]].tobytes()
