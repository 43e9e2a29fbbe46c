"""Column functions on the query text of a partition: where a model column comes from.

A query is a list of named steps, ``let a = …, b = … in b``. The steps that lead to the result are
followed back from the name behind ``in``: each step names the one that it starts from. On the way,
a navigation step tells the physical table, and each renaming tells the old names of columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'#"(?:[^"]|"")*+"'
_NAME = rf"(?:{_QUOTED}|[\p{{L}}_][\p{{L}}\p{{N}}_.]*+)"
_TEXT = r'"((?:[^"]|"")*+)"'
_PAIR = rf"\{{\s*+{_TEXT}\s*+,\s*+{_TEXT}\s*+\}}"

#: How deep brackets may lie in each other within a step.
DEPTH = 12


def _bracketed() -> str:
    """Pattern of a text in brackets, with brackets and text literals in it."""
    inside = rf'[^\[\]{{}}()"]++|{_TEXT.replace("(", "(?:", 1)}'
    group = r"(?!)"
    for _ in range(DEPTH):
        group = rf"[\[{{(](?:{inside}|{group})*+[\]}})]"
    return group


#: A step: its name and all up to the comma that ends it.
_STEP = rf'({_NAME})\s*+=(?![=>])\s*+((?:[^\[\]{{}}()",]++|"(?:[^"]|"")*+"|{_bracketed()})*+)'


def _text(value: Column) -> Column:
    """A text literal's content, null where it is not there."""
    return F.nullif(F.replace(value, F.lit('""'), F.lit('"')), F.lit(""))


def steps(query: Column) -> Column:
    """Array of ``name, body`` of the steps between ``let`` and the last ``in``."""
    inner = F.regexp_extract(query, r"(?s)^\s*let\b(.*)\bin\s+\S.*$", 1)
    return F.transform(
        F.regexp_extract_all(inner, F.lit(_STEP), F.lit(0)),
        lambda p: F.struct(
            F.regexp_extract(p, _STEP, 1).alias("name"), F.regexp_replace(F.regexp_extract(p, _STEP, 2), r"\s+$", "").alias("body")
        ),
    )


def _starts_from(body: Column) -> Column:
    """The name that a step starts from: alone, before a navigation, or as the first argument of a function."""
    argument = F.regexp_extract(body, rf"^(?:[\w.]+\(\s*)+({_NAME})", 1)
    return F.when(argument != "", argument).otherwise(F.regexp_extract(body, rf"^({_NAME})", 1))


def _renamed(body: Column) -> Column:
    """New name → old name of a renaming step; all pairs of one step hold at once."""
    pairs = F.transform(
        F.regexp_extract_all(body, F.lit(_PAIR), F.lit(0)),
        lambda p: F.struct(_text(F.regexp_extract(p, _PAIR, 2)).alias("key"), _text(F.regexp_extract(p, _PAIR, 1)).alias("value")),
    )
    usable = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    keys = F.transform(usable, lambda p: p["key"])
    # A repeated new name is an error of the query; the first one counts.
    first = F.filter(usable, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.when(body.startswith("Table.RenameColumns"), F.map_from_entries(first))


def source_of(query: Column) -> Column:
    """``schema_name``, ``source_table`` and ``renames`` (last step first) of a partition's query text."""
    last = F.regexp_extract(query, rf"(?s)\bin\s+({_NAME})\s*$", 1)

    def follow(all_steps: Column) -> Column:
        start = F.struct(
            last.alias("at"), F.lit(None).cast("string").alias("schema_name"), F.lit(None).cast("string").alias("source_table"),
            F.expr("cast(array() as array<map<string, string>>)").alias("renames"),
        )

        def back(state: Column, _: Column) -> Column:
            # Of steps with one name the last one counts; no step follows one that it starts from.
            step = F.try_element_at(F.filter(all_steps, lambda s: s["name"] == state["at"]), F.lit(-1))
            body = step["body"]
            place = F.regexp_extract(body, r"\{\[([^\]]*)\]\}", 1)
            schema = _text(F.regexp_extract(place, rf"Schema\s*=\s*{_TEXT}", 1))
            table = _text(F.regexp_extract(place, rf"(?:Item|Name)\s*=\s*{_TEXT}", 1))
            renames = _renamed(body)
            return F.when(body.isNull(), state).otherwise(
                F.struct(
                    _starts_from(body).alias("at"),
                    # The navigation nearest to the result names the table, an outer one the database or schema.
                    F.coalesce(state["schema_name"], schema).alias("schema_name"),
                    F.coalesce(state["source_table"], table).alias("source_table"),
                    F.when(renames.isNotNull(), F.array_append(state["renames"], renames)).otherwise(state["renames"]).alias("renames"),
                )
            )

        # Each turn takes one step back, so there are never more turns than steps.
        ended = F.aggregate(F.transform(all_steps, lambda s, i: i), start, back)
        return F.struct(ended["schema_name"].alias("schema_name"), ended["source_table"].alias("source_table"), ended["renames"].alias("renames"))

    return F.element_at(F.transform(F.array(steps(query)), follow), 1)


def physical_name(renames: Column, source_column: Column) -> Column:
    """Name of a column in the physical table: its renamings undone, the last one first."""
    return F.aggregate(renames, source_column, lambda name, renamed: F.coalesce(F.try_element_at(renamed, name), name))
