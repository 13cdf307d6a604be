"""Elementwise operations as Spark columns that follow NumPy, whatever the session's
ANSI setting: floor modulo, half-even rounding, IEEE infinities and NaN, wrapping
small integers, and truth values. A NULL is a masked cell and stays masked.

``masked`` says that the result belongs to an array with a mask; NumPy then masks
what lies outside an operation's domain where it otherwise gives NaN or infinity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.dtypes import spark_type, to_type

ARITHMETIC = ("add", "subtract", "multiply", "divide", "remainder", "floor_divide", "power")
COMPARISON = ("equal", "not_equal", "greater_equal", "greater", "less_equal", "less")
LOGICAL = ("logical_and", "logical_or", "logical_xor")
BINARY = ARITHMETIC + COMPARISON + LOGICAL
UNARY = ("log", "log1p", "log2", "log10", "exp", "expm1", "sqrt", "abs", "sin", "cos", "tan", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan", "arcsinh", "arccosh", "arctanh", "ceil", "floor", "trunc", "sign", "logical_not", "isnan")

INF, NAN = float("inf"), float("nan")
_PLAIN = {"exp": F.exp, "expm1": F.expm1, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh}
_LOGS = {"log": (F.ln, 0.0), "log2": (F.log2, 0.0), "log10": (F.log10, 0.0), "log1p": (F.log1p, -1.0)}


def numpy_function(operation: str):
    return getattr(np, operation)


def outside(operation: str, x: Column) -> Column | None:
    """Where a masked array has its cells masked by ``operation``."""
    if operation in ("log", "log2", "log10"):
        return x <= 0
    if operation == "sqrt":
        return x < 0
    if operation in ("arcsin", "arccos"):
        return F.abs(x) > 1
    if operation == "arccosh":
        return x < 1
    if operation == "arctanh":
        return F.abs(x) >= 1
    return None


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _is_nan(x: Column) -> Column:
    return F.isnan(x)  # false for NULL


def _floor(x: Column, up: bool = False) -> Column:
    """Floor or ceiling as a double; numbers too large to have a fraction pass as they are."""
    return F.when(_is_nan(x) | (F.abs(x) >= 2.0**52), x).otherwise((F.ceil if up else F.floor)(x).cast("double"))


def wrap(x: Column, dtype) -> Column:
    """A bigint brought into the range of a narrower integer type as NumPy does, by
    dropping high bits. 64-bit results that overflow are an error under ANSI."""
    dtype = np.dtype(dtype)
    bits = dtype.itemsize * 8
    if bits >= 64:
        return to_type(x, dtype)
    mask = F.lit((1 << bits) - 1).cast("bigint")
    if dtype.kind == "u":
        return to_type(x.bitwiseAND(mask), dtype)
    half = F.lit(1 << (bits - 1)).cast("bigint")
    return to_type((x + half).bitwiseAND(mask) - half, dtype)


def truth(x: Column, dtype) -> Column:
    return x if np.dtype(dtype).kind == "b" else x != 0


def cast(x: Column, old, new) -> Column:
    """``astype``: floats are truncated to integers; NaN and what does not fit become NULL,
    where NumPy's result is undefined."""
    old, new = np.dtype(old), np.dtype(new)
    if old == new:
        return x
    if new.kind == "b":
        return truth(x, old)
    if old.kind == "b":
        return x.cast("int").cast(spark_type(new))
    if new.kind == "f":
        return x.cast(spark_type(new))
    if old.kind == "f":
        number = x.cast("double")
        safe = F.when(~_is_nan(number) & (F.abs(number) < 2.0**63), number)
        return wrap(safe.cast("bigint"), new)
    return wrap(x.cast("bigint"), new)


def round_to(x: Column, dtype, decimals: int) -> Column:
    """Half-even rounding; the type stays."""
    dtype = np.dtype(dtype)
    if dtype.kind == "b":
        return x
    if dtype.kind in "iu":
        return x if decimals >= 0 else to_type(F.bround(x, decimals), dtype)
    number = x.cast("double")
    scale = 10.0 ** abs(decimals)
    return to_type(F.rint(number * scale) / scale if decimals >= 0 else F.rint(number / scale) * scale, dtype)


def unary(operation: str, x: Column, dtype, result, masked: bool) -> Column:
    """``operation`` of a column of ``dtype`` as a column of ``result``."""
    dtype, result = np.dtype(dtype), np.dtype(result)
    if operation == "logical_not":
        return ~truth(x, dtype)
    if operation == "isnan":
        return F.when(x.isNotNull(), _is_nan(x) if dtype.kind == "f" else F.lit(False))
    if operation == "abs":
        return x if dtype.kind in "bu" else to_type(F.abs(x), result)
    if operation in ("ceil", "floor", "trunc") and result.kind in "biu":
        return x
    if operation == "sign" and dtype.kind in "iu":
        return to_type(F.signum(x.cast("double")).cast("int"), result)
    number = (x.cast("int") if dtype.kind == "b" else x).cast("double")
    if operation in _LOGS:
        function, pole = _LOGS[operation]
        if masked and operation != "log1p":
            out = function(F.when(number > pole, number))
        else:
            out = F.when(number.isNull(), None).when(_is_nan(number), NAN).when(number == pole, -INF).when(number < pole, NAN).otherwise(function(F.when(number > pole, number)))
        return to_type(out, result)
    if operation == "sign":
        return to_type(F.when(_is_nan(number), NAN).otherwise(F.signum(number)), result)
    if operation in ("ceil", "floor"):
        return to_type(_floor(number, operation == "ceil"), result)
    if operation == "trunc":
        return to_type(F.when(number < 0, _floor(number, True)).otherwise(_floor(number)), result)
    bad = outside(operation, number) if masked else None
    if bad is not None:
        number = F.when(~bad | _is_nan(number), number)
    return to_type(_PLAIN[operation](number), result)


def _float_divide(a: Column, b: Column, masked: bool) -> Column:
    # a signed zero, number or NaN times infinity is what division by zero gives
    return F.when(b == 0, F.lit(None) if masked else F.signum(a) * INF).otherwise(a / F.when(b != 0, b))


def _float_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """Floor modulo of doubles (NaN for a zero divisor), and the quotient before rounding."""
    rest = F.when(b == 0, a * NAN).otherwise(a % F.when(b != 0, b))
    shift = rest * F.signum(b) < 0  # signs differ; not so for NaN, which compares as the largest
    return F.when(shift, rest + b).otherwise(rest), (a - rest) / F.when(b != 0, b) - F.when(shift, 1.0).otherwise(0.0)


def _compare(operation: str, a: Column, b: Column, floats: bool) -> Column:
    made = {"equal": lambda: a == b, "not_equal": lambda: a != b, "greater_equal": lambda: a >= b, "greater": lambda: a > b, "less_equal": lambda: a <= b, "less": lambda: a < b}[operation]()
    if not floats:
        return made
    either = _is_nan(a) | _is_nan(b)
    return F.when(a.isNull() | b.isNull(), None).when(either, operation == "not_equal").otherwise(made)


def _int_power(a: Column, b: Column, result) -> Column:
    """Repeated squaring of bigints, wrapped to ``result`` at each step: exact, and what does
    not fit in 64 bits is an error. So is a negative exponent, as in NumPy."""
    state = lambda out, square, left: F.struct(out.alias("out"), square.alias("square"), left.alias("left"))
    fit = lambda x: wrap(x, result).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        out, square, left = s["out"], s["square"], s["left"]
        return state(fit(F.when(left % 2 == 1, out * square).otherwise(out)), fit(F.when(left > 1, square * square).otherwise(square)), F.shiftright(left, 1))

    bits = F.length(F.bin(F.greatest(b, F.lit(1).cast("bigint")))).cast("int")
    made = F.aggregate(F.sequence(F.lit(1), bits), state(F.lit(1).cast("bigint"), a, b), step, lambda s: s["out"])
    return F.when(a.isNull() | b.isNull(), None).when(b < 0, F.raise_error(F.lit("integers to negative integer powers are not allowed")).cast("bigint")).otherwise(made)


def binary(operation: str, a: Column, a_type, b: Column, b_type, result, masked: bool) -> Column:
    """``a operation b`` as a column of ``result``."""
    a_type, b_type, result = np.dtype(a_type), np.dtype(b_type), np.dtype(result)
    if operation in LOGICAL:
        x, y = truth(a, a_type), truth(b, b_type)
        made = {"logical_and": x & y, "logical_or": x | y, "logical_xor": x != y}[operation]
        return F.when(a.isNotNull() & b.isNotNull(), made)  # masked if either is, unlike SQL
    number = lambda x, t: x.cast("int") if t.kind == "b" else x
    a, b = number(a, a_type), number(b, b_type)
    if operation in COMPARISON:
        if "f" in a_type.kind + b_type.kind:
            return _compare(operation, a.cast("double"), b.cast("double"), True)
        wide = "decimal(20,0)" if np.dtype("uint64") in (a_type, b_type) else "bigint"
        return _compare(operation, a.cast(wide), b.cast(wide), False)
    if result.kind == "b":  # sums and products of truth values
        return (a + b > 0) if operation == "add" else (a * b > 0)
    if result.kind in "iu":
        wide = "decimal(38,0)" if result == np.dtype("uint64") else "bigint"
        a, b = a.cast(wide), b.cast(wide)
        if operation in ("remainder", "floor_divide"):
            divisor = F.when(b != 0, b)
            rest = a % divisor
            floor_rest = F.when(_sure((rest != 0) & ((rest < 0) != (b < 0))), rest + b).otherwise(rest)
            made = floor_rest if operation == "remainder" else F.call_function("div", a - floor_rest, divisor) if wide == "bigint" else F.floor((a - floor_rest) / divisor)
            zero = F.lit(None) if masked else F.lit(0)
            made = F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(made)
        elif operation == "power":
            made = _int_power(a, b, result) if wide == "bigint" else F.round(F.pow(a.cast("double"), b.cast("double"))).cast(wide)
        else:
            made = {"add": a + b, "subtract": a - b, "multiply": a * b}[operation]
        return wrap(made, result) if wide == "bigint" else to_type(made, result)
    a, b = a.cast("double"), b.cast("double")
    if operation == "divide":
        made = _float_divide(a, b, masked)
    elif operation == "remainder":
        made = _float_parts(a, b)[0]
        made = F.when(b != 0, made) if masked else made
    elif operation == "floor_divide":
        made = F.when(b == 0, F.lit(None) if masked else F.signum(a) * INF).otherwise(F.rint(_float_parts(a, b)[1]))
    elif operation == "power":
        made = F.when(a.isNull() | b.isNull(), None).when((a == 1) | ((a == -1) & (F.abs(b) == INF)), 1.0).otherwise(F.pow(a, b))
        made = F.when(~(_is_nan(made) | (F.abs(made) == INF)), made) if masked else made
    else:
        made = {"add": a + b, "subtract": a - b, "multiply": a * b}[operation]
    return to_type(made, result)
