"""Plain evaluation of report documents, one parsed document at a time."""

import json
from collections.abc import Iterator


def parsed(text: str | None) -> object:
    """Value of a JSON text, None if it is damaged."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def at(value: object, *path: str) -> object:
    """Value below keys, None where one is missing."""
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def items(value: object) -> list:
    return value if isinstance(value, list) else []


def name_of(value: object) -> str | None:
    """Non-empty text, else None."""
    return value if isinstance(value, str) and value else None


def aliases_of(sources: object) -> dict[str, str]:
    """Alias → entity of a ``From`` list; the last entry of an alias wins."""
    pairs = ((at(s, "Name"), at(s, "Entity")) for s in items(sources))
    return {a: e for a, e in pairs if isinstance(a, str) and isinstance(e, str)}


def table_of(node: dict, aliases: dict[str, str]) -> str | None:
    ref = at(node, "Expression", "SourceRef")
    named = (node.get("Table"), node.get("Entity"), at(ref, "Entity"), at(ref, "Source"))
    table = next(filter(None, map(name_of, named)), None)
    return aliases.get(table, table) if table else None


def node_ref(node: dict, aliases: dict[str, str]) -> str | None:
    """``Table.Property`` (only ``Property`` without a table) of a node."""
    table, prop = table_of(node, aliases), name_of(node.get("Property"))
    return f"{table}.{prop}" if table and prop else prop if not table else None


def field_nodes(value: object) -> Iterator[tuple[str, dict]]:
    """Every ``Column`` and ``Measure`` object, at any depth; what lies inside one is part of it."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            for key, below in value.items():
                if key in ("Column", "Measure") and isinstance(below, dict):
                    yield key.lower(), below
                elif isinstance(below, dict | list):
                    todo.append(below)
        elif isinstance(value, list):
            todo.extend(value)


def refs_below(value: object, aliases: dict[str, str]) -> Iterator[tuple[str, str | None]]:
    return ((kind, node_ref(node, aliases)) for kind, node in field_nodes(value))


def shown_ref(field: object, query_ref: object, aliases: dict[str, str]) -> tuple[str, str | None] | None:
    """Reference of a projected or sorted field; aggregations give none here."""
    column, measure = at(field, "Column"), at(field, "Measure")
    nodes = [(k, n) for k, n in (("column", column), ("measure", measure)) if isinstance(n, dict)]
    if not nodes:
        return None
    query = name_of(query_ref)
    if query is None:
        kind, node = nodes[0]
        return kind, node_ref(node, aliases)
    alias, dot, rest = query.partition(".")
    return nodes[-1][0], aliases.get(alias, alias) + dot + rest if dot else query


def document_refs(doc: object, filters: object) -> Iterator[tuple[str, str]]:
    """``(kind, reference)`` of every occurrence in a visual's document.

    A field counts for its projection, for each sort entry, for each place below ``objects`` and
    for each place in the whole document. Inside a filter the filter's own aliases come first.
    """
    own = at(doc, "prototypeQuery", "From")
    aliases = aliases_of(at(doc, "singleVisual", "prototypeQuery", "From") if own is None else own)
    query = at(doc, "visual", "query")
    roles = at(query, "queryState")
    shown = [
        (at(p, "field"), at(p, "queryRef"))
        for role in (roles.values() if isinstance(roles, dict) else ())
        for p in items(at(role, "projections"))
    ]
    shown += [(at(s, "field"), None) for s in items(at(query, "sortDefinition", "sort"))]
    found = [r for field, query_ref in shown if (r := shown_ref(field, query_ref, aliases))]
    found += refs_below(at(doc, "visual", "objects"), aliases)
    if isinstance(doc, dict):
        found += refs_below({key: value for key, value in doc.items() if key != "filterConfig"}, aliases)
    for entry in items(filters):
        found += refs_below(entry, {**aliases, **aliases_of(at(entry, "filter", "From"))})
    return ((kind, ref) for kind, ref in found if ref is not None)


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


def condition_text(condition: object, table: str, field: str, kind: str) -> str:
    """Readable text for one condition."""
    condition = condition if isinstance(condition, dict) else {}
    place = f"'{table}'.'{field}'"
    for name, text in (("Not", EXCLUDED), ("In", INCLUDED), ("Equals", EQUALS)):
        if name in condition:
            return text + place
    if "Comparison" not in condition:
        return UNKNOWN_CONDITION + place
    code = at(condition, "Comparison", "ComparisonKind")
    known = isinstance(code, int) and 0 <= code < len(COMPARISON_TEXT)
    return f"Filtro de {kind} where '{field}' es {COMPARISON_TEXT[code] if known else UNKNOWN_COMPARISON}"


def filter_parts(filters: object) -> Iterator[tuple[str, str, str, str | None]]:
    """``(filter name, table, column, description)`` of the filters in a list."""
    for entry in items(filters):
        if not isinstance(entry, dict):
            continue
        field = entry.get("field") if isinstance(entry.get("field"), dict) else entry.get("expression")
        column, measure, aggregation = (at(field, k) for k in ("Column", "Measure", "Aggregation"))
        choices = (("column", column, column), ("measure", measure, measure))
        choices += (("aggregation", aggregation, at(aggregation, "Expression", "Column")),)
        kind, node = next(((k, n) for k, there, n in choices if isinstance(there, dict)), ("field", None))
        ref = at(node, "Expression", "SourceRef")
        alias = name_of(at(ref, "Source"))
        aliases = aliases_of(at(entry, "filter", "From"))
        table = name_of(at(ref, "Entity")) or (aliases.get(alias, alias) if alias else "UnknownTable")
        prop = at(node, "Property")
        name = prop if isinstance(prop, str) else UNKNOWN.get(kind, "UnknownField")
        if (table, name) == ("UnknownTable", "UnknownField"):
            continue
        texts = [condition_text(at(w, "Condition"), table, name, kind) for w in items(at(entry, "filter", "Where"))]
        yield name_of(entry.get("name")) or "Unnamed Filter", table, name, "; ".join(texts) if texts else None
