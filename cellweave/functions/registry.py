"""Registration of functions and the shapes of their arguments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from ..values import DIV0, NUM, VALUE, Error, Grid, Lambda, corner, finite, is_num, number


@dataclass(frozen=True)
class Function:
    """kind: "each" works on single values and is applied to every cell of arrays; "whole" gets grids
    as they are; "lazy" gets the interpreter, its frame and unevaluated arguments."""

    name: str
    call: Callable[..., object]
    least: int
    most: int
    kind: str
    volatile: bool = False
    errors: bool = False  # takes error values instead of passing them on


REGISTRY: dict[str, Function] = {}


def define(names: str, least: int, most: int | None, kind: str, call: Callable[..., object], **more: bool) -> Callable[..., object]:
    for name in names.split():
        REGISTRY[name] = Function(name, call, least, 255 if most is None else most, kind, **more)
    return call


def each(names: str, least: int, most: int | None = -1, **more: bool):
    """A function of single values."""
    return lambda call: define(names, least, least if most == -1 else most, "each", call, **more)


def whole(names: str, least: int, most: int | None = -1, **more: bool):
    """A function of ranges."""
    return lambda call: define(names, least, least if most == -1 else most, "whole", call, **more)


def lazy(names: str, least: int, most: int | None = -1, **more: bool):
    return lambda call: define(names, least, least if most == -1 else most, "lazy", call, **more)


def register_custom(name: str, call: Callable[..., object], least: int = 0, most: int | None = None, volatile: bool = False, override: bool = False) -> None:
    """A function of the user's: ranges arrive as lists of rows; a list of rows may be returned."""
    name = name.upper()
    if name in REGISTRY and REGISTRY[name].kind != "custom" and not override:
        raise ValueError(f"{name} is a built-in function")

    def wrapped(*args: object) -> object:
        got = call(*[a.rows if isinstance(a, Grid) else a for a in args])
        if isinstance(got, list):
            return Grid(got if got and isinstance(got[0], list) else [got])
        return got

    REGISTRY[name] = Function(name, wrapped, least, 255 if most is None else most, "custom", volatile)


def unregister_custom(name: str) -> None:
    if REGISTRY.get(name.upper()) is None or REGISTRY[name.upper()].kind != "custom":
        raise KeyError(name)
    del REGISTRY[name.upper()]


def broadcast(call: Callable[..., object], args: list[object], errors: bool = False) -> object:
    """Applies a function of single values to every cell; sides of one cell stretch."""
    grids = [a for a in args if isinstance(a, Grid)]
    if not grids:
        return guarded(call, args, errors)
    height, width = max(g.height for g in grids), max(g.width for g in grids)

    def cell(a: object, r: int, c: int) -> object:
        if not isinstance(a, Grid):
            return a
        if a.height not in (1, height) or a.width not in (1, width):
            raise Error(VALUE)
        return a.rows[r if a.height > 1 else 0][c if a.width > 1 else 0]

    if height == width == 1:
        return guarded(call, [cell(a, 0, 0) for a in args], errors)
    return Grid([[guarded(call, [cell(a, r, c) for a in args], errors) for c in range(width)] for r in range(height)])


def guarded(call: Callable[..., object], args: Iterable[object], errors: bool = False) -> object:
    try:
        if not errors:
            for a in args:
                if isinstance(a, Error):
                    return a
        got = call(*args)
        return finite(got) if isinstance(got, (float, complex)) else got
    except Error as e:
        return e
    except OverflowError:
        return Error(NUM)
    except ZeroDivisionError:
        return Error(DIV0)
    except ValueError:
        return Error(NUM)


def cells(args: Iterable[object]) -> Iterator[tuple[object, bool]]:
    """Every value with whether it stood in a range or array."""
    for a in args:
        if isinstance(a, Grid):
            for v in a.flat():
                yield v, True
        else:
            yield a, False


def numbers(args: Iterable[object]) -> list[float]:
    """The rule of reductions: in ranges only numbers count; single values are coerced; first error wins."""
    out = []
    for v, inside in cells(args):
        if isinstance(v, Error):
            raise v
        if isinstance(v, Lambda):
            raise Error("#CALC!")
        if inside:
            if is_num(v):
                out.append(v)
        else:
            out.append(number(v))
    return out


def numbers_a(args: Iterable[object]) -> list[float]:
    """The rule of the A variants: logical values are 1 and 0, text is 0, blanks do not count."""
    out = []
    for v, _ in cells(args):
        if isinstance(v, Error):
            raise v
        if v is not None:
            out.append(float(v) if isinstance(v, bool) else v if is_num(v) else 0.0)
    return out


def pairs(a: object, b: object, short: str = "#N/A") -> tuple[list[float], list[float]]:
    """Numeric pairs of two ranges of one size."""
    x, y = list(a.flat()) if isinstance(a, Grid) else [a], list(b.flat()) if isinstance(b, Grid) else [b]
    if len(x) != len(y):
        raise Error(short)
    for v in (*x, *y):
        if isinstance(v, Error):
            raise v
    both = [(p, q) for p, q in zip(x, y, strict=True) if is_num(p) and is_num(q)]
    return [p for p, _ in both], [q for _, q in both]


def fsum(values: Iterable[float]) -> float:
    total = 0.0
    for v in values:
        total += v
    return finite(total)


def integer(v: object) -> int:
    return math.trunc(finite(number(v)))


def given(v: object, default: object) -> object:
    return default if v is None else v


def single(v: object) -> object:
    v = corner(v)
    if isinstance(v, Error):
        raise v
    return v
