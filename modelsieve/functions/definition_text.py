"""Column functions on indented definition text.

A definition file is one cell. Blocks are cut out of that cell inside the row, so a file
never has to be spread over lines, shuffled and collected again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of blocks at the margin of a file and one step further in.
TOP_KINDS = ("table", "relationship")
MEMBER_KINDS = ("column", "measure", "partition", "hierarchy")
KINDS = TOP_KINDS + MEMBER_KINDS

_FENCE_NEWLINE = "\u0001"
_NAME = r"(?:'((?:[^']|'')+)'|\"([^\"]+)\"|([^'\"=\s]+))"

# Property lines that are not part of a measure expression.
_MEASURE_PROPERTY = (
    r"^\s*(?:(?:formatString|lineageTag|sourceLineageTag|displayFolder|dataCategory|description)\s*:"
    r"|(?:isHidden|annotation|changedProperty|extendedProperty)\b)"
)


def protect_fences(content: Column) -> Column:
    """Unix line ends, with the line breaks inside ``` fences hidden from line patterns."""
    parts = F.split(F.regexp_replace(content, "\r\n?", "\n"), "```")
    hidden = F.transform(
        parts, lambda s, i: F.when(i % 2 == 1, F.translate(s, "\n", _FENCE_NEWLINE)).otherwise(s)
    )
    return F.array_join(hidden, "```")


def levelled(content: Column) -> Column:
    """Text with protected fences and with blanks for the tabs before each line (stops of four)."""
    return F.regexp_replace(protect_fences(content), r"(?m)(?:^|\G)((?: {4})*+) {0,3}\t", "$1    ")


_HEADER = "\u0002"


def split_blocks(content: Column) -> Column:
    """Text pieces that each start at a block header (the first one may be a preamble).

    Which lines are headers follows from indentation alone, by a stack of the lines that a line lies
    below: a top kind opens a block where nothing is around it, a member kind where the innermost line
    around it is the header of a table. Such words further in are text of the block around them, and members
    of one table need not be equally far in. Blank lines and comments have no place in the stack.
    """
    top, member = "|".join(TOP_KINDS), "|".join(MEMBER_KINDS)

    def described(line: Column) -> Column:
        rest = F.ltrim(line)
        word = F.regexp_extract(rest, rf"^({top}|{member})[ \t]", 1)
        return F.struct(
            (F.length(line) - F.length(rest)).alias("indent"),
            F.when((F.trim(rest) == "") | rest.startswith("//"), F.lit(None)).otherwise(word).alias("word"),
        )

    def read(state: Column, line: Column) -> Column:
        around = F.filter(state["around"], lambda a: a["indent"] < line["indent"])
        parent = F.try_element_at(around, F.lit(-1))
        is_header = F.when(line["word"].isin(*TOP_KINDS), parent.isNull()).otherwise(
            line["word"].isin(*MEMBER_KINDS) & F.coalesce(parent["table"], F.lit(False))
        )
        here = F.struct(line["indent"].alias("indent"), (is_header & (line["word"] == "table")).alias("table"))
        placed = F.struct(
            F.array_append(around, here).alias("around"),
            F.concat(state["marks"], F.when(is_header, "h").otherwise(".")).alias("marks"),
        )
        return F.when(line["word"].isNull(), F.struct(state["around"].alias("around"), F.concat(state["marks"], F.lit(".")).alias("marks"))).otherwise(placed)

    start = F.struct(F.expr("cast(array() as array<struct<indent: int, table: boolean>>)").alias("around"), F.lit("").alias("marks"))

    def cut(lines: Column) -> Column:
        marks = F.split(F.aggregate(F.transform(lines, described), start, read)["marks"], "")
        marked = F.transform(F.arrays_zip(lines.alias("line"), marks.alias("mark")), lambda z: F.when(z["mark"] == "h", F.concat(F.lit(_HEADER), z["line"])).otherwise(z["line"]))
        return F.split(F.array_join(marked, "\n"), rf"\n?{_HEADER}")

    return F.element_at(F.transform(F.array(F.split(levelled(content), "\n")), cut), 1)


def block_kind(block: Column) -> Column:
    """Header keyword of a block piece, null for a preamble."""
    kind = F.regexp_extract(block, rf"^[ \t]*({'|'.join(KINDS)})[ \t]", 1)
    return F.nullif(kind, F.lit(""))


def block_header(block: Column) -> Column:
    """First line of a block."""
    return F.regexp_extract(block, r"^[^\n]*", 0)


def block_indent(block: Column) -> Column:
    """Number of blanks or tabs before the header."""
    return F.length(F.regexp_extract(block, r"^[ \t]*", 0))


def block_body(block: Column) -> Column:
    """Lines below the header that are indented deeper than it (blank lines included)."""
    return F.regexp_extract(
        block, r"^([ \t]*)[^\n]*+((?:\n(?:\1[ \t]++[^\n]*+|[ \t]*+(?=\n|\z)))*+)", 2
    )


def block_name(block: Column, kind: str) -> Column:
    """Object name in the header, without quotes."""
    header = block_header(block)
    pattern = rf"^\s*{kind}\s+{_NAME}"
    quoted = F.replace(F.regexp_extract(header, pattern, 1), F.lit("''"), F.lit("'"))
    return F.coalesce(
        F.nullif(quoted, F.lit("")),
        F.nullif(F.regexp_extract(header, pattern, 2), F.lit("")),
        F.nullif(F.regexp_extract(header, pattern, 3), F.lit("")),
    )


def unquote(value: Column) -> Column:
    """Strip one pair of quotes, but not from a ``'Table'.'Column'`` pair."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    pair = inner.contains("'.") | inner.contains(".'")
    double = value.startswith('"') & value.endswith('"') & (F.length(value) >= 2)
    single = value.startswith("'") & value.endswith("'") & (F.length(value) >= 2) & ~pair
    return F.when(double | single, inner).otherwise(value)


def property_text(text: Column, name: str) -> Column:
    """Raw value of the first ``name: value`` or ``name = value`` line, null when absent."""
    value = F.regexp_extract(text, rf"(?m)^[ \t]*{name}[ \t]*[:=][ \t]*(\S.*?)[ \t]*$", 1)
    return unquote(F.nullif(value, F.lit("")))


def property_flag(text: Column, name: str, default: bool = False) -> Column:
    """Boolean property; a bare line with only the name means true."""
    value = F.lower(property_text(text, name))
    bare = F.regexp_like(text, F.lit(rf"(?m)^[ \t]*{name}[ \t]*$"))
    return F.when(value == "true", True).when(value == "false", False).when(bare, True).otherwise(default)


def annotations(text: Column) -> Column:
    """Map of ``annotation <name> = <value>`` lines."""
    lines = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*annotation[ \t]+(.+)$"), F.lit(1))
    pairs = F.transform(
        F.filter(lines, lambda s: F.instr(s, "=") > 0),
        lambda s: F.struct(
            F.trim(F.substring_index(s, "=", 1)).alias("key"),
            unquote(F.trim(F.substring(s, F.instr(s, "=") + 1, F.length(s)))).alias("value"),
        ),
    )
    return F.map_from_entries(_last_per_key(pairs))


def object_entries(text: Column, name: str) -> Column:
    """Map of the properties nested below a line ``name``; a bare flag counts as true."""
    nested = F.regexp_extract(
        text, rf"(?m)^([ \t]*){name}[ \t]*[:{{]?[ \t]*((?:\n(?:\1[ \t]++[^\n]*+|[ \t]*+(?=\n|\z)))*+)", 2
    )
    lines = F.transform(F.split(nested, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda s: F.regexp_like(s, F.lit(r"^\w+")))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.regexp_extract(s, r"^(\w+)", 1).alias("key"),
            F.coalesce(
                unquote(F.nullif(F.regexp_extract(s, r"^\w+\s*[:=]\s*(.+)$", 1), F.lit(""))), F.lit("true")
            ).alias("value"),
        ),
    )
    return F.map_from_entries(_last_per_key(pairs))


def _last_per_key(pairs: Column) -> Column:
    """Keep the last entry of every key (``map_from_entries`` rejects repeated keys)."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.filter(
        pairs,
        lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p["key"]),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _unfence(line: Column) -> Column:
    """Open a protected fence: content lines keep their indentation, markers vanish."""
    inner = F.split(F.regexp_replace(F.replace(line, F.lit("```"), F.lit("")), r"^[ \t]+", ""), _FENCE_NEWLINE)
    text = F.array_join(F.transform(inner, lambda s: F.rtrim(F.regexp_replace(s, r"\s+$", ""))), "\n")
    return F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"\n+$", "")


def measure_expression(block: Column) -> Column:
    """Expression of a measure block: single line, indented lines or a fenced text."""
    first = F.regexp_extract(block_header(block), r"^\s*measure\s+(?:'(?:[^']|'')+'|\"[^\"]+\"|[^'\"=]+?)\s*=\s*(.*)$", 1)
    body = F.filter(_lines(block_body(block)), lambda s: ~F.regexp_like(s, F.lit(_MEASURE_PROPERTY)))
    lines = F.concat(F.array(first), body)
    texts = F.transform(
        lines,
        lambda s: F.when(F.instr(s, "```") > 0, _unfence(s)).otherwise(F.regexp_replace(s, r"^\s+|\s+$", "")),
    )
    return F.array_join(F.filter(texts, lambda s: s != ""), "\n")


def partition_source(block: Column) -> Column:
    """Source text of a partition block, one trimmed line per source line."""
    source = F.regexp_extract(block_body(block), r"(?s)(?:^|\n)[ \t]*source[ \t]*=[ \t]*(.*)$", 1)
    lines = F.transform(_lines(source), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    lines = F.filter(lines, lambda s: (s != "") & ~s.startswith("mode:"))
    text = F.array_join(F.transform(lines, _restore_fence), "\n")
    return F.nullif(text, F.lit(""))


def _restore_fence(line: Column) -> Column:
    return F.when(F.instr(line, "```") > 0, _unfence(line)).otherwise(line)


def endpoint_part(value: Column, part: int) -> Column:
    """Table (1) or column (2) of ``Table.Column``; null unless there are exactly two parts.

    A part is a run without dots, or lies in quotes, where a doubled quote stands for one.
    """
    text = F.trim(value)
    parts = F.regexp_extract_all(text, F.lit(r"(?:'(?:[^']|'')*+'|[^'.])++"), F.lit(0))
    readable = (F.size(parts) == 2) & (F.array_join(parts, ".") == text)
    raw = F.when(readable, F.get(parts, part - 1))
    quoted = raw.startswith("'") & raw.endswith("'") & (F.length(raw) > 2)
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit("''"), F.lit("'"))
    return F.when(quoted, inner).otherwise(raw)


def header_value(block: Column) -> Column:
    """Word behind the last ``=`` of a header, null without one."""
    header = block_header(block)
    value = F.trim(F.substring_index(header, "=", -1))
    return F.when(header.contains("=") & F.regexp_like(value, F.lit(r"^\w+$")), value)


def nullable_measure_name(block: Column) -> Column:
    """Name of a measure header; unquoted names run up to the ``=`` and may hold blanks."""
    header = block_header(block)
    pattern = r"^\s*measure\s+(?:'((?:[^']|'')+)'|\"([^\"]+)\"|([^'\"=]+?))\s*="
    return F.coalesce(
        F.nullif(F.replace(F.regexp_extract(header, pattern, 1), F.lit("''"), F.lit("'")), F.lit("")),
        F.nullif(F.regexp_extract(header, pattern, 2), F.lit("")),
        F.nullif(F.regexp_extract(header, pattern, 3), F.lit("")),
    )


def nested_blocks(body: Column, kind: str) -> Column:
    """Array of the blocks of one kind nested in a block body, each with its deeper lines."""
    pattern = rf"(?m)^([ \t]*){kind}[ \t][^\n]*+(?:\n(?:\1[ \t]++[^\n]*+|[ \t]*+(?=\n|\z)))*+"
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
