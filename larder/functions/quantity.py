"""Kitchen quantities: text in, text out, numbers only in between.

Quantities are never coerced at ingest. What does not parse is left as written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import WS, collapse, js_round, let, trim

# Vulgar fraction glyphs and the decimal each stands for.
VULGAR = {
    "½": "0.5", "⅓": "0.3333333333333333", "⅔": "0.6666666666666666", "¼": "0.25",
    "¾": "0.75", "⅕": "0.2", "⅖": "0.4", "⅗": "0.6", "⅘": "0.8",
    "⅙": "0.16666666666666666", "⅚": "0.8333333333333334", "⅛": "0.125",
    "⅜": "0.375", "⅝": "0.625", "⅞": "0.875",
}
GLYPHS = "".join(VULGAR)
# Denominators tried in this order, and the tolerance for each.
DENOMINATORS = (2, 3, 4, 6, 8)
TOLERANCE = 0.02

_MIXED = rf"^(\d+){WS}+(\d+){WS}*/{WS}*(\d+)\z"
_FRACTION = rf"^(\d+(?:\.\d+)?){WS}*/{WS}*(\d+(?:\.\d+)?)\z"
_DECIMAL = r"^(\d+)(?:[.,](\d+))?\z"
# A line that opens with a quantity the parser understands, then the rest.
LEADING = (
    rf"(?s)^((?:\d+{WS}+\d+{WS}*/{WS}*\d+)|(?:\d+{WS}*/{WS}*\d+)|(?:\d+(?:[.,]\d+)?)"
    rf"|[{GLYPHS}]){WS}+([^\n]+)\z"
)


def parse_quantity(raw: Column) -> Column:
    """DOUBLE value of a confidently numeric quantity, else NULL."""

    def decoded(s: Column) -> Column:
        # A repeated glyph is no number in any of the accepted shapes.
        plain = F.when(~F.regexp_like(s, F.lit(rf"([{GLYPHS}]).*\1")), s)
        for glyph, value in VULGAR.items():
            plain = F.replace(plain, F.lit(glyph), F.lit(f" {value} "))
        return F.when(F.regexp_like(s, F.lit(f"[{GLYPHS}]")), plain).otherwise(s)

    def valued(s: Column) -> Column:
        def num(pattern: str, i: int) -> Column:
            return F.regexp_extract(s, pattern, i).try_cast("double")

        mixed = num(_MIXED, 1) + num(_MIXED, 2) / F.nullif(num(_MIXED, 3), F.lit(0.0))
        fraction = num(_FRACTION, 1) / F.nullif(num(_FRACTION, 2), F.lit(0.0))
        decimal = F.replace(s, F.lit(","), F.lit(".")).try_cast("double")
        return (
            F.when(F.regexp_like(s, F.lit(_DECIMAL)), decimal)
            .when(F.regexp_like(s, F.lit(_FRACTION)), fraction)
            .when(F.regexp_like(s, F.lit(_MIXED)), mixed))

    return let(trim(collapse(let(trim(raw), decoded))), valued)


def _thousandths(n: Column) -> Column:
    return js_round(n * 1000) / 1000


def _numerator(frac: Column, d: int) -> Column:
    """Numerator over ``d`` when the fraction is close enough, else NULL."""
    num = js_round(frac * d)
    near = (num > 0) & (num < d) & (F.abs(frac - num / F.lit(float(d))) < TOLERANCE)
    return F.when(near, num.cast("double"))


def format_quantity(n: Column) -> Column:
    """Nearest kitchen spelling: integer, simple fraction, else one decimal."""

    def tenths_text(tenths: Column) -> Column:
        units = F.floor(tenths / F.lit(10)).cast("string")
        digit = F.pmod(tenths, F.lit(10))
        return F.when(digit == 0, units).otherwise(
            F.concat(units, F.lit("."), digit.cast("string")))

    def spelled(rounded: Column) -> Column:
        return let(F.floor(rounded), lambda whole: let(
            rounded - whole, lambda frac: fraction_text(rounded, whole, frac)))

    def fraction_text(rounded: Column, whole: Column, frac: Column) -> Column:
        simple = F.coalesce(*[
            F.concat(_numerator(frac, d).cast("long").cast("string"), F.lit(f"/{d}"))
            for d in DENOMINATORS])
        prefix = F.when(whole > 0, F.concat(whole.cast("string"), F.lit(" "))).otherwise(F.lit(""))
        return F.when(frac == 0, whole.cast("string")).otherwise(F.coalesce(
            F.concat(prefix, simple), let(js_round(rounded * 10).cast("long"), tenths_text)))

    def text(v: Column) -> Column:
        usable = v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < F.lit(float("inf")))
        return (
            F.when(~usable, F.lit(""))
            .when(v >= F.lit(1e15), v.cast("string"))
            .otherwise(let(_thousandths(v), spelled)))

    return let(n, text)


def spelled_value(n: Column) -> Column:
    """The value :func:`format_quantity` stands for, i.e. parse after format."""

    def value(rounded: Column) -> Column:
        return let(F.floor(rounded), lambda whole: let(
            rounded - whole, lambda frac: F.when(frac == 0, rounded).otherwise(F.coalesce(
                whole + F.coalesce(*[_numerator(frac, d) / F.lit(float(d)) for d in DENOMINATORS]),
                js_round(rounded * 10) / 10))))

    return let(_thousandths(n), value)


def scale_ingredients(ingredients: Column, factor: float) -> Column:
    """Multiply every parseable quantity; factor 1 leaves the text untouched."""
    if factor == 1:
        return ingredients

    def scaled(i: Column) -> Column:
        return i.withField("quantity", let(
            parse_quantity(i["quantity"]), lambda n: F.when(n.isNull(), i["quantity"]).otherwise(
                format_quantity(n * F.lit(float(factor))))))

    return F.transform(ingredients, scaled)


def ingredient_line(i: Column, with_note: bool = False) -> Column:
    """``quantity unit item`` with optional ``(note)``, blanks left out."""
    parts = [F.nullif(trim(i[f]), F.lit("")) for f in ("quantity", "unit", "item")]
    line = trim(collapse(F.concat_ws(" ", *parts)))
    if not with_note:
        return line
    note = F.nullif(trim(i["note"]), F.lit(""))
    return F.when(note.isNull(), line).otherwise(F.concat(line, F.lit(" ("), note, F.lit(")")))


def merge_key(text: Column) -> Column:
    """Key that makes two spellings of one item equal; also used on whole lines."""
    return collapse(F.regexp_replace(F.lower(trim(text)), r"[^a-z0-9 ]", ""))


def servings_count(text: Column) -> Column:
    """First number in the text when it is a plausible number of servings."""
    n = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((n > 0) & (n < 1000), js_round(n).cast("int"))


def leading_quantity(text: Column) -> Column:
    """Number at the start of a stored line, NULL when there is none."""
    return parse_quantity(F.nullif(F.regexp_extract(trim(text), LEADING, 1), F.lit("")))


def after_quantity(text: Column) -> Column:
    """What follows the leading quantity; the whole line when there is none."""
    def split(s: Column) -> Column:
        rest = F.regexp_extract(s, LEADING, 2)
        return F.when(rest == "", s).otherwise(trim(rest))

    return let(trim(text), split)
