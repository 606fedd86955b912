"""JSON out of free text, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a fenced block, with or without its language.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def whole_json(text: Column) -> Column:
    """The text as a VARIANT if it is one JSON value and nothing else, else null.

    Spark's parser stops after a value, so the text is also parsed with a mark of its own behind it: the mark must come next.
    """
    mark = F.md5(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_parse_json(text))


def extract_json(text: Column) -> Column:
    """The JSON value in a text as a VARIANT: the first fenced block or else the text as a whole, or its part from the first
    `{` to the last `}`, or else from the first `[` to the last `]`; null where none of these is JSON.

    Braces within strings and nested ones need no care: a part is JSON as a whole or not at all. Null and empty texts give
    null; the JSON value null gives a VARIANT of it. An object that repeats a key is no JSON here, nor is NaN.
    """
    white = r"^[\s\x1c-\x1f\u0085\u00a0\u3000]+|[\s\x1c-\x1f\u0085\u00a0\u3000]+$"
    trim = lambda c: F.regexp_replace(c, white, "")
    block = F.when(text.rlike(FENCE), trim(F.regexp_extract(text, FENCE, 1))).otherwise(trim(text))

    def parsed(block: Column) -> Column:
        def outer(opening: str, closing: str) -> Column:
            start, end = F.instr(block, opening), F.length(block) - F.instr(F.reverse(block), closing) + 1
            found = (start > 0) & F.contains(block, F.lit(closing)) & (end > start)
            return F.when(found, whole_json(F.substr(block, start, end - start + 1)))

        return F.coalesce(whole_json(block), outer("{", "}"), outer("[", "]"))

    # By way of a list of one, the block is worked out once instead of wherever it occurs.
    return F.when(F.coalesce(text, F.lit("")) != "", F.get(F.transform(F.array(block), parsed), F.lit(0)))
