"""Numbers and nested values as the published programs write them: rounding on the exact binary value,
the shortest text of a double, and canonical JSON, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _halves(x: Column) -> tuple[Column, Column]:
    """Two doubles of at most 26 bits that add up to ``x``."""
    high = _let(x * 134217729.0, lambda c: c - (c - x))
    return high, x - high


def round_half_even(x: Column, digits: int) -> Column:
    """``x`` to so many decimals by its exact binary value, ties to even: 2.675 is a little less than it
    seems and gives 2.67. The product with the power of ten is kept as a sum of two doubles, so nothing
    is rounded before it is known on which side of the half it lies; the quotient of whole numbers is then
    the nearest double to the decimal."""
    if not 0 <= digits <= 15:
        raise ValueError("0 to 15 digits")
    scale = float(10**digits)

    def exact(a: Column) -> Column:
        """struct(p, err): the product rounded, and what it lacks."""
        (ah, al), (bh, bl) = _halves(a), _halves(F.lit(scale))
        return _let(a * scale, lambda p: F.struct(p.alias("p"), (((ah * bh - p) + ah * bl + al * bh) + al * bl).alias("err")))

    def nearest(s: Column) -> Column:
        whole = F.floor(s["p"]).cast("double")
        gap = s["p"] - whole - 0.5
        up = (gap > 0) | ((gap == 0) & (s["err"] > 0)) | ((gap == 0) & (s["err"] == 0) & (whole % 2 == 1))
        return (whole + F.when(up, 1.0).otherwise(0.0)) / scale

    a = F.abs(x.cast("double"))
    sign = F.when(x.cast("string").startswith("-"), -1.0).otherwise(1.0)
    fine = F.isnan(x.cast("double")) | (a * scale >= 2.0**53)  # its neighbours are further off than decimals
    return F.when(fine, x.cast("double")).otherwise(_let(exact(a), nearest) * sign)


def shortest(x: Column) -> Column:
    """The shortest decimal text that reads back as the double ``x``, with an exponent below 1e-4 and from
    1e16 on, as JSON writers of the published programs give it."""

    def parsed(text: Column) -> Column:
        """struct(all, point): digits with the decimal point before the first times ten to ``point``."""
        mantissa = F.substring_index(text, "E", 1)
        exponent = F.coalesce(F.nullif(F.regexp_extract(text, "E(-?[0-9]+)", 1), F.lit("")), F.lit("0")).cast("int")
        whole = F.substring_index(mantissa, ".", 1)
        digits = F.concat(whole, F.substring_index(mantissa, ".", -1))
        bare = F.regexp_replace(digits, "^0+", "")
        return F.struct(F.regexp_replace(bare, "0+$", "").alias("d"), (F.length(whole) + exponent - (F.length(digits) - F.length(bare))).alias("point"))

    def shortened(s: Column, value: Column) -> Column:
        """Runtimes before 19 give more digits than needed now and then, of numbers of the usual size only
        where there are over 15."""

        def cut(p: Column) -> Column:
            rest = F.length(s["d"]) - p
            unit = F.pow(F.lit(10.0), rest.cast("double")).cast("long")
            kept = F.call_function("div", s["d"].cast("long") + F.call_function("div", unit, F.lit(2)), unit).cast("string")
            more = F.length(kept) - p  # 99 becomes 100
            return F.struct(F.regexp_replace(kept, "0+$", "").alias("d"), (s["point"] + more).alias("point"))

        reads = lambda c: F.concat(F.lit("0."), c["d"], F.lit("E"), c["point"].cast("string")).cast("double") == value
        tried = F.filter(F.transform(F.sequence(F.lit(1), F.length(s["d"]) - 1), cut), reads)
        return F.when((s["d"] != "") & ((F.length(s["d"]) > 15) | (value < 1e-300)), F.coalesce(F.get(tried, F.lit(0)), s)).otherwise(s)

    def written(s: Column) -> Column:
        d, point, n = s["d"], s["point"], F.length(s["d"])
        zeros = lambda k: F.repeat(F.lit("0"), k)
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), d))
            .when(n <= point, F.concat(d, zeros(point - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), point), F.lit("."), F.substr(d, point + 1)))
        )
        e = point - 1
        size = F.abs(e).cast("string")
        rest = F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        far = F.concat(F.substring(d, 1, 1), rest, F.when(e < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
        return F.when(d == "", "0.0").when((e >= -4) & (e < 16), plain).otherwise(far)

    v = x.cast("double")
    text = F.regexp_replace(v.cast("string"), "^-", "")
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    number = _let(parsed(text), lambda s: _let(shortened(s, F.abs(v)), written))
    return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, number))


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}


def json_text(value: Column) -> Column:
    """A string as JSON text: quotes, backslashes and control characters escaped, all else as it is."""
    escaped = value
    for c, to in _ESCAPES.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(to))
    return F.concat(F.lit('"'), F.when(value.rlike('[\\x00-\\x1f"\\\\\\\\]'), escaped).otherwise(value), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType, absent: bool = False) -> Column:
    """``value`` of type ``kind`` as JSON with sorted keys at every depth, a blank after commas and colons,
    and numbers and strings as the published programs write them, so that equal values have equal text
    and hashes are comparable. A null is ``null``; with ``absent`` null fields of structs are left out."""
    join = lambda parts: F.array_join(parts, ", ")
    if isinstance(kind, T.StructType):
        fields = [(f.name, canonical_json(value[f.name], f.dataType, absent), value[f.name]) for f in sorted(kind.fields, key=lambda f: f.name)]
        pairs = [F.when(own.isNotNull() | F.lit(not absent), F.concat(json_text(F.lit(name)), F.lit(": "), text)) for name, text, own in fields]
        body = F.concat(F.lit("{"), join(F.filter(F.array(*pairs).cast("array<string>"), lambda p: p.isNotNull())), F.lit("}"))
    elif isinstance(kind, T.MapType):
        key = lambda k: json_text(k.cast("string"))
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(key(k), F.lit(": "), canonical_json(F.element_at(value, k), kind.valueType, absent)))
        body = F.concat(F.lit("{"), join(pairs), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), join(F.transform(value, lambda x: canonical_json(x, kind.elementType, absent))), F.lit("]"))
    elif isinstance(kind, T.StringType):
        body = json_text(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = shortest(value)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        body = value.cast("string")
    else:
        raise TypeError(f"no JSON form of {kind.simpleString()}")
    return F.coalesce(F.when(value.isNotNull(), body), F.lit("null"))
