"""Logical functions, LET and LAMBDA."""

from __future__ import annotations

from ..formula.nodes import NameRef
from ..values import NA, VALUE, Error, Grid, Lambda, corner, is_num, logical, same
from .registry import each, lazy

each("TRUE", 0)(lambda: True)
each("FALSE", 0)(lambda: False)


def condition(value: object) -> bool:
    """Numbers and logical values; text and errors are #VALUE!."""
    value = corner(value)
    if isinstance(value, bool):
        return value
    if is_num(value):
        return value != 0
    if value is None:
        return False
    raise Error(VALUE)


def truths(interp, frame, args) -> list[object]:
    """Logical values of all arguments, in order; blanks do not count."""
    out: list[object] = []
    for a in args:
        v = interp.value(a, frame)
        for x in v.flat() if isinstance(v, Grid) else [v]:
            if isinstance(x, Error):
                out.append(x)
            elif x is None or isinstance(x, str) and isinstance(v, Grid):
                continue
            else:
                try:
                    out.append(logical(x) if not isinstance(x, str) or x.lower() in ("true", "false") else Error(VALUE))
                except Error as e:
                    out.append(e)
    return out


def decided(found: list[object], stop: bool) -> bool:
    first = None
    for x in found:
        if isinstance(x, Error):
            first = first or x
        elif x is stop:
            return stop
    if first is not None:
        raise first
    return not stop


@lazy("AND", 1, None)
def and_(interp, frame, args):
    return decided(truths(interp, frame, args), False)


@lazy("OR", 1, None)
def or_(interp, frame, args):
    return decided(truths(interp, frame, args), True)


@lazy("XOR", 1, None)
def xor(interp, frame, args):
    found = truths(interp, frame, args)
    for x in found:
        if isinstance(x, Error):
            raise x
    return sum(x is True for x in found) % 2 == 1


@each("NOT", 1)
def not_(x):
    return not logical(x)


@lazy("IF", 2, 3)
def if_(interp, frame, args):
    test = interp.value(args[0], frame)
    if isinstance(test, Grid) and (test.height > 1 or test.width > 1):
        yes = interp.value(args[1], frame)
        no = interp.value(args[2], frame) if len(args) > 2 else False
        return interp.each(lambda c, a, b: a if condition(c) else b, [test, yes, no], errors=True)
    if condition(test):
        return interp.value(args[1], frame)
    return interp.value(args[2], frame) if len(args) > 2 else False


def fallback(name, is_bad):
    @lazy(name, 2)
    def run(interp, frame, args):
        v = interp.value(args[0], frame)
        if isinstance(v, Grid):
            if any(is_bad(x) for x in v.flat()):
                other = interp.value(args[1], frame)
                return interp.each(lambda x, o: o if is_bad(x) else x, [v, other], errors=True)
            return v
        return interp.value(args[1], frame) if is_bad(v) else v


fallback("IFERROR", lambda v: isinstance(v, Error))
fallback("IFNA", lambda v: v == Error(NA) if isinstance(v, Error) else False)


@lazy("IFS", 2, None)
def ifs(interp, frame, args):
    if len(args) % 2:
        raise Error(VALUE)
    for test, value in zip(args[::2], args[1::2], strict=True):
        got = corner(interp.value(test, frame))
        if isinstance(got, Error):
            raise got
        if condition(got):
            return interp.value(value, frame)
    raise Error(NA)


@lazy("SWITCH", 3, None)
def switch(interp, frame, args):
    key = corner(interp.value(args[0], frame))
    if isinstance(key, Error):
        raise key
    rest = args[1:]
    for i in range(0, len(rest) - 1, 2):
        got = corner(interp.value(rest[i], frame))
        if isinstance(got, Error):
            raise got
        if same(key, got):
            return interp.value(rest[i + 1], frame)
    if len(rest) % 2:
        return interp.value(rest[-1], frame)
    raise Error(NA)


@lazy("CHOOSE", 2, None)
def choose(interp, frame, args):
    index = interp.single(args[0], frame)
    n = int(interp.number(index))
    if not 1 <= n < len(args):
        raise Error(VALUE)
    return interp.value(args[n], frame)


@lazy("LET", 3, None)
def let(interp, frame, args):
    if len(args) % 2 == 0:
        raise Error(VALUE)
    inner = frame.inner()
    for name, value in zip(args[:-1:2], args[1:-1:2], strict=True):
        if not isinstance(name, NameRef):
            raise Error(VALUE)
        inner.names[name.name.lower()] = interp.value(value, inner)
    return interp.value(args[-1], inner)


@lazy("LAMBDA", 1, None)
def lambda_(interp, frame, args):
    params = []
    for a in args[:-1]:
        if not isinstance(a, NameRef):
            raise Error(VALUE)
        params.append(a.name.lower())
    if len(set(params)) != len(params):
        raise Error(VALUE)

    def call(*given: object) -> object:
        if len(given) != len(params):
            raise Error(VALUE)
        inner = frame.inner()
        inner.names.update(zip(params, given, strict=True))
        return interp.value(args[-1], inner)

    return Lambda(params, call)


