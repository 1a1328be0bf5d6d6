"""Expressions over untrusted JSON held as VARIANT."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.html import decode_entities, strip_tags
from larder.functions.text import collapse, js_round, let, trim

# Keys whose values hold further nodes, in the order they are walked.
NESTING_KEYS = ("@graph", "mainEntity", "mainEntityOfPage", "itemListElement", "hasPart")
MAX_DEPTH = 8
# Where an object keeps its text, and where it keeps an image address.
TEXT_KEYS = ("@value", "name", "text", "url")
IMAGE_KEYS = ("url", "contentUrl", "@id")
STEP_KEYS = ("text", "name", "description")
STEP_DEPTH = 4


# The expressions below are SQL text: they nest deeply, and text is parsed once as a whole.


def field(v: str, key: str) -> str:
    """Field of an object; NULL for a JSON null, a missing key or a non-object."""
    f = f"try_variant_get({v}, '$[\"{key}\"]', 'variant')"
    return f"CASE WHEN NOT is_variant_null({f}) THEN {f} END"


def first_of(v: str, keys: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(field(v, k) for k in keys) + ")"


def items(v: str) -> str:
    """Elements when the value is an array, else NULL."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def is_object(v: str) -> str:
    """Asked of a type without fields: what the object holds is not copied."""
    return f"try_variant_get({v}, '$', 'struct<>') IS NOT NULL"


def is_array(v: str) -> str:
    """Like ``items``, but the elements are not copied."""
    return f"try_variant_get({v}, '$', 'array<boolean>') IS NOT NULL"


def is_scalar(v: str) -> str:
    return f"(NOT ({is_array(v)}) AND NOT ({is_object(v)}))"


def is_number(v: str) -> str:
    """Numeric scalar. Containers are ruled out first: their schema is costly to print."""
    return (f"coalesce(CASE WHEN {is_scalar(v)} THEN schema_of_variant({v}) NOT IN "
            f"('STRING', 'BOOLEAN', 'VOID') END, false)")


def scalar_text(v: str) -> str:
    """String as it is, number as its shortest text, anything else NULL."""
    n = f"try_variant_get({v}, '$', 'double')"
    return (f"CASE schema_of_variant({v}) WHEN 'STRING' THEN try_variant_get({v}, '$', 'string') "
            f"WHEN 'BOOLEAN' THEN NULL WHEN 'VOID' THEN NULL ELSE CASE WHEN {n} = floor({n}) "
            f"AND abs({n}) < 1e15 THEN CAST(floor({n}) AS STRING) ELSE CAST({n} AS STRING) END END")


def _readers():
    """``read(text)``, ``within(value, keys)`` and ``lists(rows)`` of the Arrow functions below."""

    class Number(str):
        pass

    decode = json.JSONDecoder(parse_int=Number, parse_float=Number).raw_decode

    def read(text: str):
        return decode(text.lstrip(" \t\r\n"))[0]

    def within(value, keys: Sequence[str]) -> list[str]:
        """Scalars inside a value, left to right, numbers marked ``n`` and strings ``s``."""
        found, ahead = [], [value]
        while ahead:
            v = ahead.pop()
            if isinstance(v, str):
                found.append(("n" if isinstance(v, Number) else "s") + v)
            elif isinstance(v, list):
                ahead.extend(reversed(v))
            elif isinstance(v, dict):
                for k in keys:
                    if v.get(k) is not None:
                        ahead.append(v[k])
                        break
        return found

    def lists(rows: list) -> pa.Array:
        held = [one for row in rows for one in row or ()]
        texts = list(chain.from_iterable(held))
        try:
            flat = pa.array(texts, pa.string())
        except UnicodeEncodeError:
            # Half of a surrogate pair: a question mark, as in a VARIANT.
            flat = pa.array([re.sub("[\ud800-\udfff]", "?", s) for s in texts], pa.string())
        inner, outer = (pa.array(accumulate(map(len, x), initial=0), pa.int32()) for x in (held, [row or () for row in rows]))
        return pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, flat), mask=pa.array([row is None for row in rows], pa.bool_()))

    return read, within, lists


def _spelled(found: Column) -> Column:
    number = f"get(transform(array(try_parse_json(substring(s, 2))), n -> {scalar_text('n')}), 0)"
    return F.call_function("transform", found, F.expr(
        f"t -> transform(t, s -> CASE WHEN left(s, 1) = 's' THEN substring(s, 2) ELSE {number} END)"))


def unwrapped(values: Column, keys: Sequence[str]) -> Column:
    """Per value of an array the texts inside it, left to right, however deep they lie.

    Arrays give what their elements give; objects give what their first present key holds,
    nothing if they have none of the keys. A container is read once: taken level by level as
    a VARIANT, every step copies all that lies below.
    """
    keys = list(keys)

    def unwrap(rows: pa.Array) -> pa.Array:
        read, within, lists = _readers()
        return lists([None if row is None else [[] if t is None else within(read(t), keys) for t in row] for row in rows.to_pylist()])

    nested = F.call_function("transform", values, F.expr(f"v -> CASE WHEN NOT {is_scalar('v')} THEN to_json(v) END"))
    found = _spelled(F.arrow_udf(unwrap, "array<array<string>>")(nested))
    return F.call_function("zip_with", values, found, F.expr(
        f"(v, t) -> CASE WHEN {is_scalar('v')} THEN array_compact(array({scalar_text('v')})) ELSE t END"))


def node_texts(
    block: Column, path: Column, fields: Sequence[tuple[Sequence[str], Sequence[str]]], listed: Sequence[str],
) -> tuple[Column, Column]:
    """Texts inside the fields of one node of a JSON block, and inside the elements of a listed field.

    As ``unwrapped`` of ``first_of`` each field's names, under its text keys, and of the ``items`` of
    ``first_of`` the listed names. The block is read once as it was written, the node found by its path.
    """
    nesting, count = NESTING_KEYS, len(fields)

    def texts(blocks: pa.Array, paths: pa.Array) -> pa.Array:
        read, within, lists = _readers()

        def first(node: dict, names: Sequence[str]):
            return next((node[k] for k in names if node.get(k) is not None), None)

        def row(text: str, steps: list[int]) -> list[list[str]]:
            node = read(text)
            for i in steps[1:]:
                node = node[i] if isinstance(node, list) else node[nesting[i]]
            elements = first(node, listed)
            return [within(first(node, names), keys) for names, keys in fields] + [
                within(e, TEXT_KEYS) for e in (elements if isinstance(elements, list) else [])]

        return lists([row(*r) for r in zip(blocks.to_pylist(), paths.to_pylist())])

    found = _spelled(F.arrow_udf(texts, "array<array<string>>")(block, path))
    return F.slice(found, 1, count), F.slice(found, count + 1, F.greatest(F.size(found) - count, F.lit(0)))


def has_type(v: str, name: str) -> str:
    """Whether ``@type`` (or ``type``) is the name or lists it, ignoring case."""
    text = f"CASE WHEN {is_scalar('k')} THEN lower({scalar_text('k')}) END"
    return (f"coalesce(get(transform(array({first_of(v, ('@type', 'type'))}), t -> exists("
            f"coalesce({items('t')}, array(t)), k -> coalesce({text} = '{name.lower()}', false))), 0), false)")


def clean_texts(parts: Column) -> Column:
    """Readable texts of raw leaves: no tags, entities decoded, blanks dropped."""
    cleaned = F.transform(parts, lambda p: trim(decode_entities(collapse(strip_tags(p)))))
    return F.filter(cleaned, lambda t: t != "")


def _entry(path: str, node: str) -> str:
    return f"struct(concat(e.path, array({path})) AS path, {node} AS node)"


def nested_children(level: str) -> Column:
    """Array items or nested fields of every value walked at one level, with their paths."""
    fields = ", ".join(
        _entry(str(i), f"try_variant_get(e.node, '$[\"{k}\"]', 'variant')")
        for i, k in enumerate(NESTING_KEYS))
    return F.expr(f"""flatten(transform({level}, e -> coalesce(
        transform(try_variant_get(e.node, '$', 'array<variant>'), (v, i) -> {_entry("i", "v")}),
        filter(array({fields}), c -> c.node IS NOT NULL AND NOT is_variant_null(c.node)))))""")


def duration_minutes(text: Column) -> Column:
    """Whole minutes of an ISO-8601 duration; NULL when absent, zero or malformed."""
    pattern = (
        r"(?i)^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?"
        r"(?:(\d+(?:\.\d+)?)S)?)?\z")

    def minutes(s: Column) -> Column:
        parts = [F.coalesce(F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).try_cast("double"),
                            F.lit(0.0)) for i in (1, 2, 3, 4)]
        total = parts[0] * 1440 + parts[1] * 60 + parts[2] + parts[3] / 60
        return F.when(F.regexp_like(s, F.lit(pattern)), total)

    return let(let(trim(text), minutes), lambda m: F.when(m > 0, js_round(m).try_cast("int")))


def step_children(level: str) -> Column:
    """Parts of an instructions value that are themselves lists or sections."""
    inner = "try_variant_get(e.node, '$.itemListElement', 'variant')"
    return F.expr(f"""flatten(transform({level}, e -> coalesce(
        transform(try_variant_get(e.node, '$', 'array<variant>'), (v, i) -> {_entry("i", "v")}),
        filter(array({_entry("0", inner)}),
            c -> c.node IS NOT NULL AND NOT is_variant_null(c.node)))))""")


def step_leaves(entries: str) -> Column:
    """What each walked part of an instructions value says, as (path, text, said).

    A string says its text, a step the value ``said``. Sections and lists say nothing
    themselves; their parts are walked separately.
    """
    n = "e.node"
    is_text = f"({is_scalar(n)} AND schema_of_variant({n}) = 'STRING')"
    is_step = (f"({is_object(n)} AND NOT {has_type(n, 'HowToSection')} "
               f"AND {field(n, 'itemListElement')} IS NULL)")
    return F.expr(f"""filter(transform({entries}, e -> struct(e.path AS path,
        CASE WHEN {is_text} THEN try_variant_get({n}, '$', 'string') END AS text,
        CASE WHEN {is_step} THEN {first_of(n, STEP_KEYS)} END AS said)), s -> s.text IS NOT NULL OR s.said IS NOT NULL)""")


def step_texts(leaf: Column, texts: Column, legacy_collapse: bool = False) -> Column:
    """Steps one leaf stands for, with its path; ``texts`` are those inside its value ``said``.

    A plain string holds one step per line; lines of two characters or less are
    dropped. ``legacy_collapse`` reads the whole string as one step instead.
    """

    def from_string(raw: Column) -> Column:
        s = F.regexp_replace(raw, r"(?i)</(?:li|p|br)\s*>", "\n")
        s = decode_entities(F.regexp_replace(s, r"(?i)<br\s*/?>", "\n"))
        lines = F.array(s) if legacy_collapse else F.split(s, r"\n+")
        steps = F.transform(lines, lambda l: trim(F.regexp_replace(
            collapse(strip_tags(l)), r"^\s*(?:\d+[.)]|[-*•])\s*", "")))
        return F.filter(steps, lambda l: F.char_length(l) > 2)

    joined = F.array(F.array_join(clean_texts(texts), ", "))
    return F.struct(leaf["path"].alias("path"), F.when(
        leaf["text"].isNotNull(), from_string(leaf["text"]),
    ).otherwise(F.filter(joined, lambda t: t != "")).alias("steps"))
