"""Tool-call arguments: tolerant parsing, sanitising, search keyword.

Parsed arguments are ``MAP<STRING,STRING>`` whose values are JSON literal
texts (``"HIV"``, ``5``, ``true``, ``null``), so the type of each value
survives for the rules that need it (the keyword takes strings only).
``arg_text`` decodes a literal for display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.text import KEYWORD_LEN, collapse_ws, cut

# Fixed values that must equal the reference's recovery pattern and key order.
PAIR_PATTERN = r'"(\w+)"\s*:\s*("(?:[^"\\]|\\.)*"|\d+(?:\.\d+)?|true|false|null)'
KEYWORD_KEYS = ("search_term", "query", "name")


def _last_of_each(entries: Column) -> Column:
    """Entries (k, v) with only the last one of every key kept, in order of
    those last ones (``json.loads`` and ``dict`` keep the last, too)."""
    n = F.size(entries)
    keys = F.transform(entries, lambda e: e["k"])
    # an entry stays if its key does not occur behind it
    return F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(n, F.lit(1))), e["k"]))


def with_parsed_args(df: DataFrame, raw: str, name: str = "args") -> DataFrame:
    """``df`` plus the parsed arguments (F6) of the text column ``raw``.

    Valid JSON object (the whole text) → its members; otherwise the
    ``"key": scalar`` pairs found in the text; otherwise ``{"_raw": text}``.
    Of repeated keys the last one counts.

    The text is parsed once: the staging columns are used several times
    each, so Catalyst keeps them in a projection of their own."""
    text = F.col(raw)
    # from_json stops behind the first object; as the only member of an array the whole text must be one
    whole = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & F.ltrim(text).startswith("{")
    staged = df.withColumn("_obj", F.when(whole, F.from_json(text, "MAP<STRING,VARIANT>")))
    # the pairs of the texts that are not an object, both groups by one pass each
    broken = F.when(F.col("_obj").isNull(), text)
    pairs = F.arrays_zip(F.regexp_extract_all(broken, F.lit(PAIR_PATTERN), 1).alias("k"),
                         F.regexp_extract_all(broken, F.lit(PAIR_PATTERN), 2).alias("v"))
    members = F.transform(F.map_entries("_obj"), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    alone = F.array(F.struct(F.lit("_raw").alias("k"), json_string(text).alias("v")))
    staged = staged.withColumn("_pairs", F.coalesce(members, pairs))
    staged = staged.withColumn("_pairs", F.when((F.size("_pairs") == 0) & F.col("_obj").isNull(), alone).otherwise(F.col("_pairs")))
    args = F.when(text.isNotNull(), F.map_from_entries(_last_of_each(F.col("_pairs"))))
    return staged.withColumn(name, args).drop("_obj", "_pairs")


def json_string(s: Column) -> Column:
    """``s`` as a JSON string literal (quoted and escaped)."""
    wrapped = F.to_json(F.struct(s.alias("v")))  # {"v":"..."}
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def arg_text(literal: Column) -> Column:
    """Display text of a JSON literal: strings unquoted, ``null`` → NULL."""
    return F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")


def is_string(literal: Column) -> Column:
    return literal.startswith('"')


def search_keyword(args: Column) -> Column:
    """F8: first non-blank *string* among search_term, query, name; collapsed
    and cut at 80 characters + '…'; '' when none."""
    given = F.array(*[F.element_at(args, F.lit(key)) for key in KEYWORD_KEYS])
    texts = F.transform(F.filter(given, lambda v: v.isNotNull() & is_string(v)), lambda v: collapse_ws(arg_text(v)))
    first = F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))
    return F.coalesce(F.transform(F.array(first), lambda t: cut(t, KEYWORD_LEN))[0], F.lit(""))


def sanitize_args(args: Column, properties: Column, required: Column,
                  defaults: Column) -> Column:
    """sole ``_raw`` → the tool's only required parameter; fill defaults
    the tool declares; drop keys the schema lacks (an empty schema drops
    nothing).  ``defaults`` holds JSON literals for optional parameters."""
    only_raw = (F.size(args) == 1) & F.map_contains_key(args, "_raw") & (F.size(required) == 1)
    renamed = F.when(only_raw, F.create_map(F.element_at(required, 1),
                                            F.element_at(args, F.lit("_raw")))).otherwise(args)
    missing_defaults = F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(renamed), k)
                                    & F.array_contains(properties, k))
    filled = F.map_concat(renamed, missing_defaults)
    return F.when(F.size(properties) == 0, filled).otherwise(
        F.map_filter(filled, lambda k, v: F.array_contains(properties, k)))
