"""Text functions with template semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def placeholders(template: Column) -> Column:
    """Names of the {fields} of a template in order, repeats included; doubled braces are literal."""
    bare = F.replace(F.replace(template, F.lit("{{"), F.lit("")), F.lit("}}"), F.lit(""))
    return F.regexp_extract_all(bare, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1))


def malformed(template: Column) -> Column:
    """Whether a brace is left over once doubled braces and whole fields are taken away."""
    bare = F.replace(F.replace(template, F.lit("{{"), F.lit("")), F.lit("}}"), F.lit(""))
    return F.regexp_replace(bare, r"\{[A-Za-z_][A-Za-z0-9_]*\}", "").rlike(r"[{}]")


def render(template: Column, values: dict[str, Column]) -> Column:
    """The template with its fields replaced and doubled braces undone; fields are replaced in one order, their values are literal."""
    left, right = "\u0001", "\u0002"
    out = F.replace(F.replace(template, F.lit("{{"), F.lit(left)), F.lit("}}"), F.lit(right))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.replace(F.replace(out, F.lit(left), F.lit("{")), F.lit(right), F.lit("}"))


def escape_braces(text: Column) -> Column:
    """Text that renders to itself."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def strip_prefix(text: Column) -> Column:
    """Text without a leading label of up to five words and a colon, and without quotes around it; applied twice."""
    once = lambda t: F.trim(F.regexp_replace(t, r"^[\*\s]*(([A-Za-z0-9_]+ ){0,4}[A-Za-z0-9_]+):\s*", ""), F.lit('"'))
    return once(once(text))
