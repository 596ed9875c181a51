"""Column functions over JSON documents, bounded texts and numbers as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of a bounded text, what ends one that was cut, and what stands for a blank one (in `bounded`).
TEXT_LIMIT, CUT = 1024, "...[truncated]"


# JSON's strings and numbers. Possessive, so that long texts neither backtrack nor recurse.
_STRING, _NUMBER = r'"[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+"', r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_BARE = r"-?[1-9][0-9]{0,39}|0"  # numbers that are written as they stay


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: the optimizer writes a column out at each use, and within a
    condition it computes it at each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_number(token: Column) -> Column:
    """The one text of a JSON number's value: its digits without zeros at either end, and a power of ten; whole numbers of up to 40
    digits are written out. 100, 1e2 and 100.0 are one number, so are 0 and -0; digits are never rounded. Null if the power has over
    18 digits."""
    parts = F.split(F.regexp_replace(token, "^-", ""), "[eE]")
    power = F.coalesce(F.nullif(F.regexp_extract(token, r"[eE]\+?(-?[0-9]+)$", 1), F.lit("")), F.lit("0")).try_cast("long")

    def of_mantissa(mantissa: Column) -> Column:
        fraction = F.when(F.contains(mantissa, F.lit(".")), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
        return let(F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0")), lambda digits: let(F.rtrim(digits, F.lit("0")), lambda short: F.when(short == "", "0").otherwise(
            let(power - fraction + F.length(digits) - F.length(short), lambda p: F.concat(F.when(token.startswith("-"), "-").otherwise(""), written(short, p))))))

    def written(short: Column, p: Column) -> Column:
        return F.when(p == 0, short).when((p > 0) & (F.length(short) + p <= 40), F.concat(short, F.repeat(F.lit("0"), p.cast("int")))).otherwise(F.concat(short, F.lit("e"), p.cast("string")))

    return let(F.get(parts, F.lit(0)), of_mantissa)


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for what isn't JSON, to the letter of its grammar (NaN, infinities, leading zeros and keys
    that repeat in an object aren't). Numbers of equal value have equal texts (`exact_number`), whatever their size.

    The parser would round large numbers, so each goes through it as a marked string. Each step is computed once.
    """
    strings = F.regexp_replace(json, _STRING[:1] + "(" + _STRING[1:-1] + ")" + _STRING[-1:], '"s$1"')
    # What lies between two numbers: strings, and all that begins neither.
    numbers = F.regexp_replace(strings, rf'\G((?:[^"0-9-]++|{_STRING})*+)({_NUMBER})', '$1["n$2"]')
    exact = lambda x: F.concat(let(F.substring_index(x, '"', 1), lambda n: F.when(n.rlike(f"^(?:{_BARE})$"), n).otherwise(exact_number(n))), F.substring(x, F.length(F.substring_index(x, '"', 1)) + 1, F.lit(2**31 - 1)))
    spelt = lambda m: let(F.split(m, r'\["n'), lambda parts: let(F.transform(F.slice(parts, F.lit(2), F.size(parts)), exact), lambda own: F.when(~F.exists(own, lambda x: x.isNull()), F.concat_ws('["n', F.slice(parts, 1, 1), own))))
    marked = let(numbers, lambda m: F.when(m.rlike(rf'\["n(?!(?:{_BARE})")'), spelt(m)).otherwise(m))
    # The parser stops after one value, so it gets an object that has to end as it does here; keys of the text start with s, before t.
    first, last = '{"t":', ',"u":"end"}'
    inside = lambda p: F.when(p.startswith(first) & p.endswith(last), F.nullif(F.substring(p, F.lit(len(first) + 1), F.length(p) - len(first) - len(last)), F.lit("")))
    value = let(F.to_json(F.try_parse_json(F.concat(F.lit(first), marked, F.lit(last)))), inside)
    return F.regexp_replace(F.regexp_replace(value, r'\["n([^"]*+)"\]', "$1"), r'"s([^"\\]*+(?:\\.[^"\\]*+)*+)"', '"$1"')


def json_problem(json: Column) -> Column:
    """Why a text can't be a record: null, not JSON, or not an object; null if it can."""
    return let(canonical(json), lambda c: canonical_problem(json, c))


def canonical_problem(json: Column, c: Column) -> Column:
    """`json_problem` of a text whose canonical form is known."""
    return F.when(json.isNull(), "null").when(c.isNull(), "not JSON").when(~c.startswith("{"), "not an object")


def bounded(text: Column, field: str) -> Column:
    """Text without NUL characters, cut to TEXT_LIMIT code points with a mark, and a stand-in for blank text."""
    clean = F.replace(text, F.lit("\u0000"), F.lit(""))
    cut = F.when(F.length(clean) > TEXT_LIMIT, F.concat(F.substring(clean, 1, TEXT_LIMIT - len(CUT)), F.lit(CUT))).otherwise(clean)
    return F.when(F.length(F.regexp_replace(cut, r"\s", "")) == 0, f"<unprintable {field}>").otherwise(cut)


def escaped(text: Column) -> Column:
    """Text in printable ASCII: backslashes doubled, others than printable ASCII as \\n, \\r, \\t, \\xNN, \\uNNNN or \\UNNNNNNNN."""
    def one(c: Column) -> Column:
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")
        hexed = lambda mark, n: F.concat(F.lit(mark), F.lower(F.lpad(F.hex(code), n, "0")))
        return (
            F.when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when((code >= 32) & (code < 127), c)
            .when(code < 256, hexed("\\x", 2)).when(code < 65536, hexed("\\u", 4)).otherwise(hexed("\\U", 8))
        )

    return F.when(text.rlike(r"[^\x20-\x5b\x5d-\x7e]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def unescaped(text: Column) -> Column:
    """What `escaped` was made of."""
    parts = F.regexp_extract_all(text, F.lit(r"(\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\U[0-9a-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def one(p: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[xuU]"), wide).when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\t", "\t").when(p == "\\\\", "\\").otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def float_token(x: Column) -> Column:
    """The shortest decimal text of a number from 0 to 1: 0.0 for zero, an exponent of two digits below 0.0001."""
    t = x.cast("string")
    mantissa, exponent = F.regexp_replace(F.substring_index(t, "E", 1), r"\.0$", ""), F.lpad(F.substring_index(t, "E-", -1), 2, "0")
    small = F.concat(mantissa, F.lit("e-"), exponent)
    middle = F.concat(F.lit("0.000"), F.replace(mantissa, F.lit("."), F.lit("")))
    return F.when(x == 0, "0.0").when(~F.contains(t, F.lit("E")), t).when(x >= 0.0001, middle).otherwise(small)


def first_classified(position: Column, failure: Column) -> Column:
    """Aggregate: the failure class of the first link of a chain that has one; null if none has."""
    return F.min_by(failure, F.when(failure.isNotNull(), position))
