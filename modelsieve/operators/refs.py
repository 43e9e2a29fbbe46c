"""Reference extraction from expressions, for all models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions import expressions as X
from modelsieve.schemas import conform

MODEL = "semantic_model_id"
_TEXT = "__text"


def _canonical(names: DataFrame, column: str, alias: str) -> DataFrame:
    """One spelling per (model, lower-case name)."""
    return names.groupBy(MODEL, F.lower(column).alias("__key")).agg(F.max(column).alias(alias))


def with_clean_text(df: DataFrame, text: str) -> DataFrame:
    """Add the cleaned expression; rows without text are dropped."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).withColumn(
        _TEXT, X.clean_expression(F.col(text))
    )


def reference_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Reference tokens of each expression: ``raw_table`` (may be empty) and ``raw_field``.

    ``raw_table`` has keyword prefixes removed; ``raw_word`` keeps the last word before the
    bracket, so that a table whose name is a keyword can still be recognised.
    """
    tokens = (
        with_clean_text(df, text)
        .select(*keep, F.explode(F.array_distinct(X.reference_tokens(F.col(_TEXT)))).alias("__token"))
        .select(*keep, "__token", X.token_table(F.col("__token")).alias("__before"))
    )
    quoted = F.col("__token").startswith("'")
    return tokens.select(
        *keep,
        F.when(quoted, F.col("__before")).otherwise(X.drop_keyword_prefix(F.col("__before"))).alias("raw_table"),
        F.regexp_extract("__before", r"(\S*)$", 1).alias("raw_word"),
        X.token_field(F.col("__token")).alias("raw_field"),
    )


def resolved_refs(df: DataFrame, text: str, keep: Sequence[str], tables: DataFrame, measures: DataFrame) -> DataFrame:
    """References of each expression, each once; see :func:`reference_occurrences`."""
    return reference_occurrences(df, text, keep, tables, measures).distinct()


def reference_occurrences(df: DataFrame, text: str, keep: Sequence[str], tables: DataFrame, measures: DataFrame) -> DataFrame:
    """References of each expression in long form, spelled as in the model.

    Output: ``keep``, ``dependency_type`` (``column`` or ``measure``), ``referenced_name``,
    ``referenced_table`` (column rows: the table; measure rows: home table or empty) and
    ``is_known``. Names compare without case; unknown names stay as written.
    """
    known = _canonical(tables.select(MODEL, "table_name"), "table_name", "__table")
    homes = measures.groupBy(MODEL, F.lower("measure_name").alias("__name")).agg(
        F.max(F.struct("measure_name", "table_name")).alias("__home")
    )
    # Text before the bracket that holds only keywords may still be a table of that name.
    lookup = F.lower(F.when(F.col("raw_table") != "", F.col("raw_table")).otherwise(F.col("raw_word")))
    # Both look-ups run over one scan of the texts. Every row has keys of its own, so rows
    # that need only one of the two do not pile up under a null key.
    rows = (
        reference_rows(df, text, keep)
        .withColumn("__key", lookup)
        .withColumn("__name", F.lower("raw_field"))
        .join(known, [MODEL, "__key"], "left")
        .join(homes, [MODEL, "__name"], "left")
    )
    is_column = (F.col("raw_table") != "") | F.col("__table").isNotNull()
    return rows.select(
        *keep,
        F.when(is_column, "column").otherwise("measure").alias("dependency_type"),
        F.when(is_column, F.col("raw_field"))
        .otherwise(F.coalesce("__home.measure_name", "raw_field"))
        .alias("referenced_name"),
        F.when(is_column, F.coalesce("__table", "raw_table"))
        .otherwise(F.coalesce("__home.table_name", F.lit("")))
        .alias("referenced_table"),
        F.when(is_column, F.col("__table").isNotNull()).otherwise(F.col("__home").isNotNull()).alias("is_known"),
    )


_MEASURE_KEYS = (MODEL, "table_name", "measure_name")


def qualified_refs(measures: DataFrame, tables: DataFrame) -> DataFrame:
    """``'Table'[Column]`` and ``Table[Column]`` references of measures."""
    refs = resolved_refs(measures, "expression", _MEASURE_KEYS, tables, measures)
    return refs.where(F.col("dependency_type") == "column").select(
        *_MEASURE_KEYS,
        F.col("referenced_table").alias("ref_table"),
        F.col("referenced_name").alias("ref_column"),
        "is_known",
    )


def measure_refs(measures: DataFrame, tables: DataFrame) -> DataFrame:
    """Bare ``[X]`` references of measures; unknown names are kept and flagged."""
    refs = resolved_refs(measures, "expression", _MEASURE_KEYS, tables, measures)
    return refs.where(F.col("dependency_type") == "measure").select(
        *_MEASURE_KEYS, F.col("referenced_name").alias("ref_measure"), "is_known"
    )


def functions_used(measures: DataFrame, known_functions: DataFrame | None = None) -> DataFrame:
    """Functions a measure calls.

    ``known_functions`` is a one-column frame with the function catalogue of the expression
    language. Without it every called name counts.
    """
    calls = with_clean_text(measures, "expression").select(
        *_MEASURE_KEYS, F.explode(X.called_names(F.col(_TEXT))).alias("function_name")
    )
    if known_functions is None:
        return calls
    names = known_functions.select(F.upper(known_functions.columns[0]).alias("function_name"))
    return calls.join(names, "function_name", "left_semi").select(*_MEASURE_KEYS, "function_name")


def variables_used(measures: DataFrame) -> DataFrame:
    """Variables a measure declares."""
    return with_clean_text(measures, "expression").select(
        *_MEASURE_KEYS, F.explode(X.declared_variables(F.col(_TEXT))).alias("variable_name")
    )


def variable_scopes(pieces: Column) -> Column:
    """Where variables hide tables of their name: ``{name, first, last}`` (places from 1, both exclusive).

    ``pieces`` holds ``{text, cls}``, in lower case. A variable is visible from its declaration to the
    end of the block that declares it: the parenthesis that closes around the block, or the comma
    behind it among the arguments of a call. Blocks further in see it, those beside it do not.
    """
    places = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)))

    def declares(i: Column) -> Column:
        name = F.get(pieces, i + 1)
        return F.coalesce((F.get(pieces, i - 1)["text"] == "var") & (F.get(pieces, i)["cls"] == "s") & (name["cls"] == "w"), F.lit(False))

    def end_of_block(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), (i + 2).alias("at"), F.lit(0).alias("end"))

        def step(state: Column, piece: Column) -> Column:
            at, depth = state["at"] + 1, state["depth"]
            ends = (depth == 0) & piece["text"].isin(")", ",")
            deeper = F.when(piece["text"] == "(", depth + 1).when(piece["text"] == ")", depth - 1).otherwise(depth)
            moved = F.struct(deeper.alias("depth"), at.alias("at"), F.when(ends, at).otherwise(F.lit(0)).alias("end"))
            return F.when(state["end"] > 0, state).otherwise(moved)

        found = F.aggregate(F.slice(pieces, i + 3, F.size(pieces)), start, step)["end"]
        return F.when(found > 0, found).otherwise(F.size(pieces) + 1)

    return F.transform(
        F.filter(places, declares),
        lambda i: F.struct(F.get(pieces, i + 1)["text"].alias("name"), i.alias("first"), end_of_block(i).alias("last")),
    )


def _name_candidates(scoped: bool) -> Column:
    """Runs of ``__pieces`` that may be a table name: ``{start, length, key}`` per run.

    ``__pieces`` holds ``{text, cls}``; ``__shapes`` holds the (class of the first piece,
    number of pieces) that names of the model have. Marks and numbers, which fill most of a
    formula, are candidates only in models with names that start so.
    """
    pieces, variables = F.col("__pieces"), F.col("__variables")
    size = F.size(pieces)

    def text(i: Column) -> Column:
        return F.coalesce(F.get(pieces, i - 1)["text"], F.lit(""))

    def cls(i: Column) -> Column:
        return F.coalesce(F.get(pieces, i - 1)["cls"], F.lit("s"))

    def may_start(i: Column) -> Column:
        joins_word = (cls(i) == "m") & cls(i - 1).isin("w", "d")
        return (cls(i) != "s") & ~text(i - 1).isin("'", ".") & ~joins_word

    def run_text(i: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(pieces, i, n), lambda p: p["text"]), "")

    starts = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), may_start)
    runs = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.filter("__shapes", lambda s: (s["cls"] == cls(i)) & (i + s["n"] - 1 <= size)),
                lambda s: F.struct(i.alias("start"), s["n"].alias("length"), run_text(i, s["n"]).alias("key")),
            ),
        )
    )

    def is_call(run: Column) -> Column:
        after = run["start"] + run["length"]
        return F.when(cls(after) == "s", text(after + 1)).otherwise(text(after)) == "("

    def is_variable(run: Column) -> Column:
        if not scoped:
            return F.array_contains(variables, run["key"])
        return F.exists("__scopes", lambda v: (v["name"] == run["key"]) & (v["first"] < run["start"]) & (run["start"] < v["last"]))

    return F.filter(runs, lambda run: ~is_call(run) & ~is_variable(run))


def bare_table_refs(
    df: DataFrame,
    tables: DataFrame,
    text: str = "expression",
    keep: Sequence[str] = _MEASURE_KEYS,
    include_quoted: bool = False,
    scoped_variables: bool = False,
) -> DataFrame:
    """Known tables named in an expression without a ``[column]`` after the name.

    A name may hold several words. Each expression is cut into words and marks, and every
    run of pieces that is as long as some table name of the model becomes one candidate;
    candidates meet the names by an equi-join on (model, lower-case text). The longest name
    wins at each place, and names declared as variables do not count: nowhere in the expression, or
    with ``scoped_variables`` only where the variable is visible (see :func:`variable_scopes`). Names
    inside single quotes count only with ``include_quoted``.
    """
    named = tables.where(F.col("table_name") != "").select(MODEL, "table_name").distinct()
    name_pieces = X.pieces(F.col("table_name"))
    # Bounded per model: one entry per shape that some name has, not per table.
    shapes = (
        named.select(MODEL, X.piece_class(F.get(name_pieces, 0)).alias("cls"), F.size(name_pieces).alias("n"))
        .groupBy(MODEL)
        .agg(F.sort_array(F.collect_set(F.struct("cls", "n"))).alias("__shapes"))
    )

    cleaned = with_clean_text(df, text)
    if include_quoted:
        quoted = r"(\[[^\]]*+\]|\"(?:[^\"]|\"\")*+\")|'((?:[^'\n]|'')++)'(?!\s*\[)"
        cleaned = cleaned.withColumn(_TEXT, F.regexp_replace(_TEXT, quoted, "$1 $2 "))
    words = cleaned.select(
        *keep,
        F.transform(X.declared_variables(F.col(_TEXT)), F.lower).alias("__variables"),
        F.transform(
            X.pieces(F.lower(X.without_references(F.col(_TEXT)))),
            lambda p: F.struct(p.alias("text"), X.piece_class(p).alias("cls")),
        ).alias("__pieces"),
    ).join(shapes, MODEL)
    if scoped_variables:
        words = words.withColumn("__scopes", variable_scopes(F.col("__pieces")))
    # Candidates are built inside the row, so the pieces of a long text are not copied to
    # every start position.
    candidates = words.select(*keep, F.explode(_name_candidates(scoped_variables)).alias("__c")).select(
        *keep, F.col("__c.start").alias("__start"), F.col("__c.length").alias("__length"), F.col("__c.key").alias("__key")
    )

    known = _canonical(named, "table_name", "ref_table")
    hits = candidates.join(known, [MODEL, "__key"]).select(
        *keep, F.struct("__start", F.negative("__length").alias("__neg"), "ref_table").alias("__hit")
    )
    # The hits of one expression are bounded by the length of its text. Walk them left to
    # right, longest first, and skip a hit that starts inside the one taken before it.
    taken = F.aggregate(
        F.array_sort(F.collect_list("__hit")),
        F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names")),
        lambda acc, hit: F.when(
            hit["__start"] > acc["end"],
            F.struct(
                (hit["__start"] - hit["__neg"] - 1).alias("end"),
                F.concat(acc["names"], F.array(hit["ref_table"])).alias("names"),
            ),
        ).otherwise(acc),
    )
    return (
        hits.groupBy(*keep)
        .agg(taken["names"].alias("__names"))
        .select(*keep, F.explode(F.array_distinct("__names")).alias("ref_table"))
    )


def _dependencies(
    texts: DataFrame,
    text: str,
    keep: Sequence[str],
    cat: dict[str, DataFrame],
    include_quoted: bool,
    spell_columns: bool,
    dash_comments: bool,
    scoped_variables: bool,
) -> DataFrame:
    """Table, column and measure rows of expressions: ``keep`` and the three dependency columns.

    A column reference names its table too, the home table of a measure included: it gives a row of
    each kind.
    """
    tables = cat["semantic_model_table"]
    if dash_comments:
        texts = texts.withColumn(text, X.clean_expression(F.col(text), dash_comments=True))
    refs = reference_occurrences(texts, text, keep, tables, cat["semantic_model_measure"]).drop("is_known")
    is_column = F.col("dependency_type") == "column"
    if spell_columns:
        columns = cat["semantic_model_column"]
        spelled = columns.groupBy(
            MODEL, F.col("table_name").alias("referenced_table"), F.lower("column_name").alias("__key")
        ).agg(F.max("column_name").alias("__spelled"))
        refs = (
            refs.withColumn("__key", F.lower("referenced_name"))
            .join(spelled, [MODEL, "referenced_table", "__key"], "left")
            .withColumn("referenced_name", F.when(is_column, F.coalesce("__spelled", "referenced_name")).otherwise(F.col("referenced_name")))
            .drop("__key", "__spelled")
        )
    names = ("dependency_type", "referenced_name", "referenced_table")
    as_read = F.struct(*names)
    of_table = F.struct(
        F.lit("table").alias(names[0]), F.col("referenced_table").alias(names[1]), F.lit(None).cast("string").alias(names[2])
    )
    # Both rows come out of the one scan of the texts.
    each = F.when(is_column, F.array(as_read, of_table)).otherwise(F.array(as_read))
    bare = bare_table_refs(texts, tables, text, keep, include_quoted, scoped_variables).select(
        *keep,
        F.lit("table").alias("dependency_type"),
        F.col("ref_table").alias("referenced_name"),
        F.lit(None).cast("string").alias("referenced_table"),
    )
    return refs.select(*keep, F.inline(each)).unionByName(bare).distinct()


def direct_dependencies(
    cat: dict[str, DataFrame],
    include_quoted: bool = False,
    spell_columns: bool = False,
    dash_comments: bool = False,
    scoped_variables: bool = False,
) -> DataFrame:
    """Table, column and measure dependencies of every measure of every model.

    ``include_quoted`` counts quoted table names without a column, which names with blanks need;
    ``spell_columns`` gives columns the spelling of the model; with ``dash_comments`` the text
    behind ``--`` holds no references; with ``scoped_variables`` a variable hides a table of its name
    only where it is visible.
    """
    measures = cat["semantic_model_measure"]
    found = _dependencies(measures, "expression", _MEASURE_KEYS, cat, include_quoted, spell_columns, dash_comments, scoped_variables)
    return conform(found.withColumnRenamed("table_name", "measure_table"), "measure_dependencies")


def function_dependencies(measures: DataFrame, known_functions: DataFrame | None = None) -> DataFrame:
    """Called functions as dependency rows, for closures that inherit them."""
    return conform(
        functions_used(measures, known_functions).select(
            MODEL,
            "measure_name",
            F.col("table_name").alias("measure_table"),
            F.lit("function").alias("dependency_type"),
            F.col("function_name").alias("referenced_name"),
        ),
        "measure_dependencies",
    )


def calculated_table_dependencies(
    cat: dict[str, DataFrame],
    include_quoted: bool = False,
    spell_columns: bool = False,
    dash_comments: bool = False,
    scoped_variables: bool = False,
) -> DataFrame:
    """Dependencies of the source code of calculated tables (direct ones only)."""
    code = cat["semantic_model_table"].where("is_calculated").select(MODEL, "table_name", "source_code")
    found = _dependencies(code, "source_code", (MODEL, "table_name"), cat, include_quoted, spell_columns, dash_comments, scoped_variables)
    # A measure row has no home table here.
    home = F.when(F.col("dependency_type") != "measure", F.col("referenced_table"))
    found = found.withColumn("referenced_table", home).withColumnRenamed("table_name", "calculated_table_name")
    return conform(found, "calculated_table_dependencies")


def _light_rows(measures: DataFrame) -> DataFrame:
    return measures.select(
        *_MEASURE_KEYS, F.explode(F.array_distinct(X.light_references(F.col("expression")))).alias("__ref")
    ).select(
        *_MEASURE_KEYS, F.col("__ref.table").alias("ref_table"), F.col("__ref.column").alias("ref_column")
    )


def external_table_refs(measures: DataFrame, included: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of real tables outside ``included`` that measures of included tables name.

    ``included`` and ``tables`` hold (semantic_model_id, table_name). Light scan: unquoted
    names only, compared with case.
    """
    inside = included.select(MODEL, "table_name").distinct()
    real = tables.select(MODEL, F.col("table_name").alias("ref_table")).distinct()
    refs = _light_rows(measures.join(inside, [MODEL, "table_name"], "left_semi"))
    return (
        refs.select(MODEL, "ref_table", "ref_column")
        .distinct()
        .join(real, [MODEL, "ref_table"], "left_semi")
        .join(inside.withColumnRenamed("table_name", "ref_table"), [MODEL, "ref_table"], "left_anti")
        .select(MODEL, F.col("ref_table").alias("table_name"), F.col("ref_column").alias("column_name"))
    )


def own_table_columns(measures: DataFrame) -> DataFrame:
    """Columns that the measures of a table take from the table itself."""
    return (
        _light_rows(measures)
        .where(F.col("ref_table") == F.col("table_name"))
        .select(MODEL, "table_name", F.col("ref_column").alias("column_name"))
        .distinct()
    )


def search_measures(measures: DataFrame, text: str) -> DataFrame:
    """Measures whose name or expression contains ``text``, without case."""
    needle = F.lower(F.lit(text))
    return measures.where(
        F.lower("measure_name").contains(needle) | F.lower(F.coalesce("expression", F.lit(""))).contains(needle)
    )
