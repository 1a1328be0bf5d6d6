"""Split an ingredient line into quantity, unit, item and note."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.html import decode_entities, strip_tags
from larder.functions.text import WORD_END, collapse, let, trim

# Measuring words.
UNITS = (
    "g", "gram", "grams", "kg", "kilogram", "kilograms", "ml", "l", "litre", "litres",
    "liter", "liters", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "cup", "cups",
    "tsp", "tsps", "teaspoon", "teaspoons", "tbsp", "tbsps", "tablespoon", "tablespoons",
    "clove", "cloves", "pinch", "pinches", "handful", "handfuls", "slice", "slices", "stick",
    "sticks", "can", "cans", "tin", "tins", "pint", "pints", "quart", "quarts", "gallon",
    "sprig", "sprigs", "bunch", "bunches", "dash", "packet", "packets", "package", "packages",
    "pkg", "jar", "jars", "bottle", "bottles", "piece", "pieces", "sheet", "sheets", "scoop",
    "scoops", "head", "heads", "stalk", "stalks", "knob", "knobs",
)
# The shapes a leading quantity takes.
_GLYPH = "[½⅓⅔¼¾⅛⅜⅝⅞]"
QUANTITY_HEAD = (
    r"^\s*(?:[-*•–—]\s*)?((?:\d+\s+\d+\s*/\s*\d+)|(?:\d+\s*/\s*\d+)"
    r"|(?:\d+(?:[.,]\d+)?\s*(?:-|–|to)\s*\d+(?:[.,]\d+)?)|(?:\d+(?:[.,]\d+)?)"
    rf"|{_GLYPH})\s*({_GLYPH})?\s*"
)
UNIT_WORD = rf"^([A-Za-z.]+(?:(?<=[A-Za-z]){WORD_END}|(?<=\.)(?=[A-Za-z0-9_])))\.?\s*"
NOTE_LIMIT = 60


def _after(s: Column, matched: Column) -> Column:
    return F.substring(s, F.char_length(matched) + 1, F.char_length(s))


def _drop_of(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)^of\s+", "")


def parse_ingredient_line(raw: Column) -> Column:
    """Ingredient struct of one line; NULL when no item is left.

    Kept conservative: what cannot be split confidently stays whole in ``item``.
    """
    line = trim(collapse(decode_entities(collapse(strip_tags(raw)))))
    return let(let(let(let(line, _take_quantity), _take_unit), _take_paren), _take_comma)


def _take_quantity(line: Column) -> Column:
    joined = F.concat_ws(
        " ", F.nullif(F.regexp_extract(line, QUANTITY_HEAD, 1), F.lit("")),
        F.nullif(F.regexp_extract(line, QUANTITY_HEAD, 2), F.lit("")))
    slashed = F.regexp_replace(joined, r"\s*/\s*", "/")
    # A head holds at most one range mark.
    quantity = F.nullif(F.regexp_replace(slashed, r"\s*(?:-|–|to)\s*", "-"), F.lit(""))
    rest = _after(line, F.regexp_extract(line, QUANTITY_HEAD, 0))
    return F.struct(quantity.alias("quantity"), rest.alias("rest"))


def _take_unit(s: Column) -> Column:
    rest = s["rest"]
    word = F.lower(F.regexp_replace(F.regexp_extract(rest, UNIT_WORD, 1), r"\.\z", ""))

    def split(unit: Column) -> Column:
        after = F.when(unit.isNull(), rest).otherwise(
            _drop_of(_after(rest, F.regexp_extract(rest, UNIT_WORD, 0))))
        return F.struct(s["quantity"].alias("quantity"), unit.alias("unit"), after.alias("rest"))

    return let(let(word, lambda w: F.when(w.isin(*UNITS), w)), split)


def _take_paren(s: Column) -> Column:
    rest = s["rest"]
    pattern = r"\(([^)]*)\)\s*\z"

    def split(found: Column) -> Column:
        note = F.when(found != "", trim(F.regexp_extract(rest, pattern, 1)))
        before = F.when(found == "", rest).otherwise(
            trim(F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(found))))
        return F.struct(s["quantity"].alias("quantity"), s["unit"].alias("unit"),
                        note.alias("note"), before.alias("rest"))

    return let(F.regexp_extract(rest, pattern, 0), split)


def _take_comma(s: Column) -> Column:
    rest, paren = s["rest"], s["note"]
    pattern = r"^(.*?),\s*(.+)\z"

    def split(tail: Column) -> Column:
        has_tail = (tail != "") & (F.char_length(tail) <= NOTE_LIMIT)
        item = F.when(has_tail, trim(F.regexp_extract(rest, pattern, 1))).otherwise(rest)
        note = F.when(has_tail, F.concat_ws(
            ", ", trim(tail), F.nullif(paren, F.lit("")))).otherwise(paren)
        return let(trim(_drop_of(item)), lambda i: F.when(i != "", F.struct(
            s["quantity"].alias("quantity"), s["unit"].alias("unit"), i.alias("item"),
            F.nullif(note, F.lit("")).alias("note"))))

    return let(F.regexp_extract(rest, pattern, 2), split)
