"""Column functions on report documents (JSON text), without Python workers.

Field nodes, the objects of ``Column`` and ``Measure`` keys, may lie at any depth. A typed parse cannot
name all places and a generic one ends at a thousand levels, so the nodes are found in the text: it is
cut at the keys of field nodes, each piece is parsed as far as its node goes, and one pass over the
braces tells for each node whether it lies in the visual's objects, in a filter, inside another node, or
elsewhere. Texts in quotes are skipped as a whole in that pass. Everything at fixed places
(aliases, projections, filters) comes from typed parses that skip what they do not name.

Documents that are not valid JSON objects give nothing here; :func:`is_readable` tells them apart.
Names that are not JSON strings count as their JSON text. Keys spelt with ``\\u`` escapes are not found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nesting is bounded by the length of a text only, as it is skipped and not built.
OPTIONS = {"maxNestingDepth": str(2**31 - 1), "allowSingleQuotes": "false"}

ALIASES = "ARRAY<STRUCT<Name: STRING, Entity: STRING>>"
_SOURCE = "Expression: STRUCT<SourceRef: STRUCT<Entity: STRING, Source: STRING>>"
_NODE = f"STRUCT<`Table`: STRING, Entity: STRING, Property: STRING, {_SOURCE}>"
_FIELD = f"STRUCT<`Column`: {_NODE}, Measure: {_NODE}>"
_PROJECTIONS = f"STRUCT<projections: ARRAY<STRUCT<field: {_FIELD}, queryRef: STRING>>>"
_FROM = f"STRUCT<`From`: {ALIASES}>"
_FILTER_FIELD = f"STRUCT<`Column`: {_NODE}, Measure: {_NODE}, Aggregation: STRUCT<Expression: STRUCT<`Column`: {_NODE}>>>"
_SOME = "STRUCT<`-`: STRING>"
_CONDITION = f"STRUCT<`Not`: {_SOME}, `In`: {_SOME}, Equals: {_SOME}, Comparison: STRUCT<ComparisonKind: STRING>>"
_FILTER = (
    f"STRUCT<name: STRING, field: {_FILTER_FIELD}, expression: {_FILTER_FIELD}, "
    f"filter: STRUCT<`From`: {ALIASES}, Where: ARRAY<STRUCT<Condition: {_CONDITION}>>>>"
)
_FILTERS = f"ARRAY<{_FILTER}>"
_VISUAL = (
    f"STRUCT<prototypeQuery: {_FROM}, singleVisual: STRUCT<prototypeQuery: {_FROM}>, "
    f"visual: STRUCT<query: STRUCT<queryState: MAP<STRING, {_PROJECTIONS}>, sortDefinition: STRUCT<sort: ARRAY<STRUCT<field: {_FIELD}>>>>>>"
)
_LOOSE_QUERY = "STRUCT<visual: STRUCT<query: STRUCT<queryState: MAP<STRING, STRING>>>>"


def parsed(text: Column, schema: str) -> Column:
    """Typed value of a JSON text; what the schema does not name is skipped at any depth."""
    return F.from_json(text, schema, OPTIONS)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_readable(text: Column) -> Column:
    """Whether a text is a JSON object (what follows its last brace is not looked at)."""
    return text.isNotNull() & (text != "") & parsed(text, "STRUCT<`-`: STRING, _corrupt_record: STRING>")["_corrupt_record"].isNull()


def alias_map(from_list: Column) -> Column:
    """Map alias → entity from a ``From`` list; the last entry of an alias wins."""
    usable = F.filter(
        F.coalesce(from_list, F.from_json(F.lit("[]"), ALIASES)),
        lambda e: e["Name"].isNotNull() & e["Entity"].isNotNull(),
    )
    names = F.transform(usable, lambda e: e["Name"])
    last = F.filter(
        usable,
        lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["Name"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["Name"], e["Entity"])))


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _resolved(name: Column, *maps: Column) -> Column:
    """A table name, or what the first map that has it as an alias says."""
    return F.coalesce(*(F.try_element_at(m, name) for m in maps), name)


def node_ref(node: Column, *aliases: Column) -> Column:
    """``Table.Property`` (only ``Property`` without a table) of a field node; null without a property."""
    source = node["Expression"]["SourceRef"]
    table = F.coalesce(_some(node["Table"]), _some(node["Entity"]), _some(source["Entity"]), _some(source["Source"]))
    prop = _some(node["Property"])
    return F.when(table.isNull(), prop).otherwise(F.concat(_resolved(table, *aliases), F.lit("."), prop))


_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_KEYS = r'(?:Column|Measure|visual|objects|filterConfig|filters)"\s*+:\s*+[{\[]'
#: What a text is reduced to: its braces, and keys of interest with the brace of their value.
_NOISE = rf'(?s)("{_KEYS})|"{_STRING}|[^"{{}}\[\]]++'
_BRACES = rf'"{_KEYS}|[{{}}\[\]]'
#: Braces around nothing, three deep, but not those of a key of interest.
_HOLLOW = r"(?<![:\s])[{\[](?:[{\[](?:[{\[][}\]])*+[}\]])*+[}\]]"
#: The key of a field node. Inside a text, its first quote would be escaped.
_NODE_KEY = r'"(?<!\\")(?:Column|Measure)"\s*+:\s*+(?=\{)'
_NONE = -1


def _node_places(text: Column, listed: bool, numbered: Column) -> Column:
    """For each field node, in order: a letter for its place, the first of its key, the number of its filter.

    ``o`` in the visual's objects, ``f`` in a filter, ``x`` elsewhere in the filter settings, ``n`` inside
    another node, ``r`` in the rest. With ``listed``, the text is a list of filters, not a document. Filters
    are counted right only where ``numbered`` holds.
    """
    # Depths at which something began that has not ended yet.
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(_NONE).alias("node"), F.lit(_NONE).alias("visual"), F.lit(_NONE).alias("objects"),
        F.lit(0 if listed else _NONE).alias("config"), F.lit(0 if listed else _NONE).alias("filters"),
        F.lit(0).alias("n"), F.lit("").alias("places"),
    )
    entry_depth = 1 if listed else 3

    def opened(s: Column, token: Column) -> Column:
        depth, brace = s["depth"], F.right(token, F.lit(1))
        is_node = (brace == "{") & (token.startswith('"Column') | token.startswith('"Measure'))
        begins = is_node & (s["node"] == _NONE)
        n = s["n"]
        place = (
            F.when(~begins, "n")
            .when((s["filters"] != _NONE) & (depth > entry_depth), "f")
            .when(s["config"] != _NONE, "x")
            .when(s["objects"] != _NONE, "o")
            .otherwise("r")
        )

        def at(key: str, level: int, kept: str, where: Column = F.lit(True)) -> Column:
            here = token.startswith(f'"{key}"') & (depth == level) & where
            return F.when(here, depth).otherwise(s[kept]).alias(kept)

        document = F.lit(not listed)
        return F.struct(
            (depth + 1).alias("depth"),
            F.when(begins, depth).otherwise(s["node"]).alias("node"),
            at("visual", 1, "visual", document),
            at("objects", 2, "objects", s["visual"] == 1),
            at("filterConfig", 1, "config", document),
            at("filters", 2, "filters", document & (s["config"] == 1) & (brace == "[")),
            n.alias("n"),
            F.when(is_node, F.concat(s["places"], place, F.substring(token, 2, 1), n.cast("string"), F.lit(","))).otherwise(s["places"]).alias("places"),
        )

    marks = ("node", "visual", "objects", "config", "filters")

    def moved(s: Column, by: int, **changed: Column) -> Column:
        names = ("depth", *marks, "n", "places")
        return F.struct(*(changed.get(c, s["depth"] + by if c == "depth" else s[c]).alias(c) for c in names))

    def plain(s: Column, token: Column) -> Column:
        entry = (s["filters"] != _NONE) & (s["depth"] == entry_depth) & (token == "{")
        return F.when(entry, moved(s, 1, n=s["n"] + 1)).otherwise(moved(s, 1))

    def closed(s: Column) -> Column:
        depth = s["depth"] - 1
        ended = {c: F.when(s[c] != depth, s[c]).otherwise(_NONE) for c in marks}
        # Below three braces, only a node can end that is not at one of these depths.
        return F.when((depth > 3) & (depth != s["node"]), moved(s, -1)).otherwise(moved(s, -1, **ended))

    braces = F.regexp_replace(text, _NOISE, "$1")
    # Most braces go before the pass over the rest, but not where empty filters have to be counted.
    few = bound(braces, lambda b: F.when(numbered, b).otherwise(F.regexp_replace(F.regexp_replace(b, _HOLLOW, ""), _HOLLOW, "")))
    tokens = F.regexp_extract_all(few, F.lit(_BRACES), F.lit(0))
    last = F.aggregate(tokens, start, lambda s, t: F.when(t.isin("}", "]"), closed(s)).when(t.isin("{", "["), plain(s, t)).otherwise(opened(s, t)))
    return F.split(F.rtrim(last["places"], F.lit(",")), ",")


_PLACED = f"ARRAY<STRUCT<kind: STRING, place: STRING, filter: INT, node: {_NODE}>>"


def field_nodes(text: Column, listed: bool = False, numbered: Column | None = None) -> Column:
    """Array of ``kind, place, filter, node`` of the outermost field nodes of a JSON text; see ``_node_places``."""
    counts = F.lit(True) if numbered is None else numbered

    def of_pieces(pieces: Column, places: Column) -> Column:
        def follows(i: Column) -> Column:
            return F.left(F.get(places, i), F.lit(1)) == "n"

        def key(i: Column) -> Column:
            return F.when(F.substring(F.get(places, i), 2, 1) == "C", '"Column":').otherwise('"Measure":')

        def body(i: Column) -> Column:
            """The text from a node to the next key of a node outside it."""
            # Nodes inside this one follow it without a gap.
            inside = F.filter(F.sequence(i + 1, F.size(places)), lambda j: F.coalesce(follows(j), F.lit(False)))
            run = F.filter(inside, lambda j, k: j == i + 1 + k)
            more = F.array_join(F.transform(run, lambda j: F.concat(key(j), F.get(pieces, j + 1))), "")
            return F.when(follows(i + 1), F.concat(F.get(pieces, i + 1), more)).otherwise(F.get(pieces, i + 1))

        each = F.transform(
            places,
            lambda p, i: F.struct(
                F.when(F.substring(p, 2, 1) == "C", "column").otherwise("measure").alias("kind"),
                F.left(p, F.lit(1)).alias("place"),
                F.substr(p, F.lit(3)).cast("int").alias("filter"),
                F.when(~p.startswith("n"), parsed(body(i), _NODE)).alias("node"),
            ),
        )
        return F.filter(each, lambda n: ~n["place"].isin("n", "x"))

    def of_any(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, bound(_node_places(text, listed, counts), lambda places: of_pieces(pieces, places)))

    return bound(F.split(text, _NODE_KEY), of_any)


_REF = "STRUCT<kind: STRING, ref: STRING>"


def _refs(nodes: Column, *aliases: Column) -> Column:
    return F.transform(nodes, lambda n: F.struct(n["kind"].alias("kind"), node_ref(n["node"], *aliases).alias("ref")))


def _shown_ref(field: Column, query_ref: Column, aliases: Column) -> Column:
    """Reference of a projected or sorted field; aggregations give none here."""
    column, measure = field["Column"], field["Measure"]
    query = _some(query_ref)
    rest = F.substr(query, F.instr(query, ".") + 1)
    named = F.when(
        F.contains(query, F.lit(".")), F.concat(_resolved(F.substring_index(query, ".", 1), aliases), F.lit("."), rest)
    ).otherwise(query)
    by_name = F.struct(F.when(measure.isNotNull(), "measure").otherwise("column").alias("kind"), named.alias("ref"))
    by_node = F.struct(
        F.when(column.isNotNull(), "column").otherwise("measure").alias("kind"),
        F.when(column.isNotNull(), node_ref(column, aliases)).otherwise(node_ref(measure, aliases)).alias("ref"),
    )
    return F.when(column.isNotNull() | measure.isNotNull(), F.when(query.isNotNull(), by_name).otherwise(by_node))


def _list(value: Column, schema: str) -> Column:
    """An array, empty where it is null."""
    return F.coalesce(value, F.from_json(F.lit("[]"), schema))


def query_aliases(visual: Column) -> Column:
    """Alias map of a parsed visual: its own query prototype, else that of ``singleVisual``."""
    return alias_map(F.coalesce(visual["prototypeQuery"]["From"], visual["singleVisual"]["prototypeQuery"]["From"]))


def listed_filters(filters: Column) -> Column:
    """Typed entries of a JSON list of filters; entries that are no objects are null."""
    return F.when(filters.startswith("["), F.coalesce(parsed(filters, _FILTERS), _each_filter(parsed(filters, "ARRAY<STRING>"))))


def _each_filter(entries: Column) -> Column:
    """Filters read one by one: an entry of another type voids a typed list, but only itself here."""
    return F.transform(entries, lambda e: parsed(F.when(e.startswith("{"), e), _FILTER))


_EMPTY_MAP = "cast(map() as map<string, string>)"


def _filter_refs(nodes: Column, entries: Column, aliases: Column) -> Column:
    """References of the field nodes in filters; the filter's own aliases come first."""
    # Filters are numbered as the objects among the entries.
    objects = F.filter(_list(entries, _FILTERS), lambda e: e.isNotNull())
    maps = F.transform(objects, lambda e: alias_map(e["filter"]["From"]))
    inside = F.filter(nodes, lambda n: n["place"] == "f")

    def ref(n: Column) -> Column:
        own = F.coalesce(F.get(maps, n["filter"] - 1), F.expr(_EMPTY_MAP))
        return F.struct(n["kind"].alias("kind"), node_ref(n["node"], own, aliases).alias("ref"))

    return F.transform(inside, ref)


def document_refs(doc: Column, filters: Column) -> Column:
    """Array of ``kind, ref`` of every occurrence of a field in a visual's document and its filters.

    A field counts for its projection, for each sort entry, for each place below ``objects`` and
    for each place in the whole document. ``filters`` is the list of the visual's filters if it is at
    hand; else the document's own are read.
    """

    def of_visual(text: Column, filters: Column, visual: Column, aliases: Column, nodes: Column) -> Column:
        loose = F.transform_values(
            parsed(text, _LOOSE_QUERY)["visual"]["query"]["queryState"], lambda _, role: parsed(role, _PROJECTIONS)
        )
        query = visual["visual"]["query"]
        roles = F.map_values(F.coalesce(query["queryState"], loose))
        projected = F.flatten(F.transform(roles, lambda r: _list(r["projections"], f"ARRAY<STRUCT<field: {_FIELD}, queryRef: STRING>>")))
        shown = F.transform(projected, lambda p: _shown_ref(p["field"], p["queryRef"], aliases))
        none = F.lit(None).cast("string")
        sorted_by = F.transform(query["sortDefinition"]["sort"], lambda s: _shown_ref(s["field"], none, aliases))
        in_objects = F.filter(nodes, lambda n: n["place"] == "o")
        in_rest = F.filter(nodes, lambda n: n["place"] != "f")
        of_own = _filter_refs(nodes, own_filters(text), aliases)
        of_given = _filter_refs(_list(field_nodes(filters, listed=True), _PLACED), listed_filters(filters), aliases)
        in_filters = F.when(filters.isNull(), of_own).otherwise(of_given)
        parts = (shown, sorted_by, _refs(in_objects, aliases), _refs(in_rest, aliases), in_filters)
        return F.filter(F.concat(*(_list(p, f"ARRAY<{_REF}>") for p in parts)), lambda r: r["ref"].isNotNull())

    def of_text(text: Column, filters: Column) -> Column:
        return bound(
            parsed(text, _VISUAL),
            lambda visual: bound(
                F.struct(query_aliases(visual).alias("aliases"), _list(field_nodes(text, numbered=filters.isNull()), _PLACED).alias("nodes")),
                lambda found: of_visual(text, filters, visual, found["aliases"], found["nodes"]),
            ),
        )

    given = F.struct(doc.alias("doc"), filters.alias("filters"))
    readable = bound(given, lambda g: F.struct(F.when(is_readable(g["doc"]), g["doc"]).alias("text"), g["filters"].alias("filters")))
    return bound(readable, lambda g: of_text(g["text"], g["filters"]))


def literal_text(value: Column) -> Column:
    """Literal without its single quotes."""
    return F.regexp_replace(value, r"^'+|'+$", "")


# Texts of the condition kinds, by position of the comparison code.
COMPARISON_TEXT = (
    "igual a",
    "mayor que",
    "menor que",
    "mayor o igual que",
    "menor o igual que",
    "no igual a",
)
UNKNOWN_COMPARISON = "comparación desconocida"
EXCLUDED = "Se excluyen valores en "
INCLUDED = "Se incluyen valores en "
EQUALS = "Es igual a en "
UNKNOWN_CONDITION = "Condición desconocida en "
UNKNOWN = {"column": "UnknownColumn", "measure": "UnknownMeasure", "aggregation": "UnknownAggregation"}


def condition_text(condition: Column, table: Column, field: Column, kind: Column) -> Column:
    """Readable text for one condition."""
    place = F.concat(F.lit("'"), table, F.lit("'.'"), field, F.lit("'"))
    comparison = condition["Comparison"]
    texts = F.array(*map(F.lit, COMPARISON_TEXT))
    code = comparison["ComparisonKind"].try_cast("int")
    known = F.coalesce(F.when(code >= 0, F.get(texts, code)), F.lit(UNKNOWN_COMPARISON))
    compared = F.concat(F.lit("Filtro de "), kind, F.lit(" where '"), field, F.lit("' es "), known)
    return (
        F.when(condition["Not"].isNotNull(), F.concat(F.lit(EXCLUDED), place))
        .when(condition["In"].isNotNull(), F.concat(F.lit(INCLUDED), place))
        .when(condition["Equals"].isNotNull(), F.concat(F.lit(EQUALS), place))
        .when(comparison.isNotNull(), compared)
        .otherwise(F.concat(F.lit(UNKNOWN_CONDITION), place))
    )


def filter_parts(filters: Column, entries: Column | None = None) -> Column:
    """Array of ``filter_name, table_name, column_name, filter_description`` of a list of filters.

    ``entries`` stands in for the typed entries where the text of the list is null.
    """

    def of_entry(entry: Column) -> Column:
        field = F.coalesce(entry["field"], entry["expression"])
        column, measure, aggregation = field["Column"], field["Measure"], field["Aggregation"]
        kind = (
            F.when(column.isNotNull(), "column").when(measure.isNotNull(), "measure").when(aggregation.isNotNull(), "aggregation").otherwise("field")
        )
        node = F.coalesce(column, measure, aggregation["Expression"]["Column"])
        source = node["Expression"]["SourceRef"]
        named = _resolved(_some(source["Source"]), alias_map(entry["filter"]["From"]))
        table = F.coalesce(_some(source["Entity"]), named, F.lit("UnknownTable"))
        unknown = F.coalesce(*(F.when(kind == k, v) for k, v in UNKNOWN.items()), F.lit("UnknownField"))
        name = F.coalesce(node["Property"], unknown)

        def described(part: Column) -> Column:
            texts = F.transform(entry["filter"]["Where"], lambda w: condition_text(w["Condition"], part["table"], part["name"], part["kind"]))
            return F.struct(
                F.coalesce(_some(entry["name"]), F.lit("Unnamed Filter")).alias("filter_name"),
                part["table"].alias("table_name"),
                part["name"].alias("column_name"),
                F.when(F.size(texts) > 0, F.array_join(texts, "; ")).alias("filter_description"),
            )

        part = F.struct(table.alias("table"), name.alias("name"), kind.alias("kind"))
        known = entry.isNotNull() & ~((table == "UnknownTable") & (name == "UnknownField"))
        return F.when(known, bound(part, described))

    typed = listed_filters(filters) if entries is None else F.coalesce(listed_filters(filters), F.when(filters.isNull(), entries))
    return F.filter(F.transform(typed, of_entry), lambda f: f.isNotNull())


def own_filters(doc: Column) -> Column:
    """Typed entries of the filter list inside a visual's document."""
    typed = parsed(doc, f"STRUCT<filterConfig: STRUCT<filters: {_FILTERS}>>")
    loose = parsed(doc, "STRUCT<filterConfig: STRUCT<filters: ARRAY<STRING>>>")
    return F.coalesce(typed["filterConfig"]["filters"], _each_filter(loose["filterConfig"]["filters"]))
