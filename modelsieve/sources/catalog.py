"""The catalog as Parquet tables: write, read, upsert, query."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.plans.fixpoint import materialize
from modelsieve.schemas import DDL, conform, empty, struct_of

Catalog = Mapping[str, DataFrame]

# Tables are stored in hash buckets of the item they belong to, so that a re-import rewrites
# the buckets of the imported items only, and millions of items do not make millions of folders.
_ITEM_KEY = {
    **{t: "semantic_model_id" for t in DDL if t.startswith(("semantic_model", "measure_", "calculated_"))},
    **{t: "report_id" for t in DDL if t.startswith("report")},
}
BUCKET = "item_bucket"
_PARENT = {"semantic_model_id": "semantic_model", "report_id": "report"}


def replace_items(target: DataFrame, batch: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``target`` without the rows of any key in ``batch``, plus ``batch``."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = target.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def match_items(
    existing: DataFrame, incoming: DataFrame, key: str, name: str = "name", within: str = "workspace_id"
) -> DataFrame:
    """Key under which each incoming item is stored: its own if known, else that of its name.

    A name stands for an item only within its workspace, and only if no other stored or incoming
    item bears it there and the batch does not bring the stored item itself. In every other case
    the item keeps its own key, so that no item takes the place of another.

    Returns ``incoming`` with a column ``stored_key``.
    """
    scope = [c for c in (within, name) if c in existing.columns and c in incoming.columns]
    named = F.when(F.col(name).isNotNull(), F.to_json(F.struct(*scope)))
    stored = existing.select(key, named.alias("__named")).distinct()
    # One row per name: the one stored item that has it, if the batch does not have that item.
    alone = stored.where("__named is not null").groupBy("__named").agg(
        F.min(key).alias("__by_name"), F.count(F.lit(1)).alias("__n")
    )
    free = alone.where("__n = 1").join(incoming.select(F.col(key).alias("__by_name")), "__by_name", "left_anti")
    asked = incoming.select(key, named.alias("__named")).distinct().groupBy("__named").agg(F.count(F.lit(1)).alias("__asked"))
    by_name = free.join(asked.where("__asked = 1"), "__named").select("__named", "__by_name")
    by_key = stored.select(key).distinct().withColumn("__by_key", F.col(key))
    return (
        incoming.withColumn("__named", named)
        .join(by_key, key, "left")
        .join(by_name, "__named", "left")
        .withColumn("stored_key", F.coalesce("__by_key", "__by_name", key))
        .drop("__by_key", "__by_name", "__named")
    )


def upsert_catalog(catalog: Catalog, batch: Catalog, key: str, parent: str | None = None) -> Catalog:
    """Re-import items: every child table loses the rows of the imported keys first.

    ``parent`` is the table that names the imported items; an item without rows in a child
    table still clears its old rows there. Parent rows match by key, else by name, and the
    imported rows take over the stored key.
    """
    result = dict(catalog)
    if parent is None:
        for table, rows in batch.items():
            result[table] = replace_items(catalog[table], rows, key)
        return result
    matched = match_items(catalog[parent], batch[parent].dropDuplicates([key]), key)
    keys = matched.select(F.col(key).alias("__key"), "stored_key")
    stored = keys.select(F.col("stored_key").alias(key)).distinct()
    for table, rows in batch.items():
        renamed = rows.join(keys, rows[key] == keys["__key"]).select(
            *[(F.col("stored_key").alias(key) if c == key else rows[c]) for c in rows.columns]
        )
        kept = catalog[table].join(stored, key, "left_anti")
        result[table] = kept.unionByName(renamed, allowMissingColumns=True)
    return result


def upsert_workspaces(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by ``id``: the latest row wins, ``created_at`` of the first row stays.

    Both frames carry ``updated_at``; ``target`` may carry ``created_at``. Grouping uses plain
    aggregates, so many versions of one id are combined before the shuffle.
    """
    rows = target.unionByName(batch, allowMissingColumns=True)
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.col("updated_at"))
    rows = rows.withColumn("created_at", F.coalesce("created_at", "updated_at"))
    payload = [c for c in rows.columns if c not in ("id", "created_at")]
    order = ["updated_at", *[c for c in payload if c != "updated_at"]]
    return (
        rows.groupBy("id")
        .agg(F.max(F.struct(*order)).alias("__last"), F.min("created_at").alias("created_at"))
        .select("id", *[F.col(f"__last.{c}").alias(c) for c in payload], "created_at")
    )


LAYOUT = "catalog_layout"
BUCKETS = 64


def _layout(spark: SparkSession, path: str) -> int | None:
    """Bucket count a stored catalog was written with."""
    try:
        return spark.read.schema("buckets INT").json(f"{path}/{LAYOUT}").first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _set_layout(spark: SparkSession, path: str, buckets: int) -> None:
    spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.mode("overwrite").json(f"{path}/{LAYOUT}")


def _bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(_ITEM_KEY[table]), F.lit(buckets)).cast("int"))


def _write_buckets(df: DataFrame, path: str, table: str) -> None:
    # Rebalancing lets adaptive execution split the bucket of a huge item and merge small ones.
    (
        df.hint("rebalance", BUCKET)
        .write.mode("overwrite")
        .partitionBy(BUCKET)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(f"{path}/{table}")
    )


def write_catalog(catalog: Catalog, path: str, buckets: int = BUCKETS) -> None:
    """Write whole catalog tables as Parquet, in ``buckets`` hash buckets of their item key.

    The bucket count is stored with the catalog and holds for every later upsert. Choose it by
    the size of the catalog: an upsert rewrites whole buckets.
    """
    spark = next(iter(catalog.values())).sparkSession
    known = _layout(spark, path)
    if known not in (None, buckets):
        raise ValueError(f"the catalog is stored in {known} buckets, not {buckets}")
    _set_layout(spark, path, buckets)
    for table, df in catalog.items():
        if table in _ITEM_KEY:
            _write_buckets(_bucketed(df, table, buckets), path, table)
        else:
            df.write.mode("overwrite").parquet(f"{path}/{table}")


def upsert_stored_catalog(spark: SparkSession, path: str, batch: Catalog, buckets: int | None = None) -> None:
    """Replace the items of ``batch`` in a stored catalog; only their buckets are rewritten.

    Items are those of the parent table (``semantic_model`` or ``report``) where the batch has it.
    An item is matched by id, else by workspace and name, and takes over the stored id. Every child table of the
    kind loses its rows first, whether or not the batch has that table. Workspaces are upserted by
    id, workspace-wide dependencies replaced by workspace. The bucket count is the stored one;
    ``buckets`` is for a catalog that is not there yet. All tables are prepared before the first
    is rewritten.
    """
    known = _layout(spark, path)
    if known is None:
        known = buckets or BUCKETS
        _set_layout(spark, path, known)
    elif buckets not in (None, known):
        raise ValueError(f"the catalog is stored in {known} buckets, not {buckets}")
    prepared: list[tuple[str, DataFrame]] = []
    for key, parent in _PARENT.items():
        mine = {t: conform(df, t) for t, df in batch.items() if _ITEM_KEY.get(t) == key}
        if mine:
            prepared += _prepared_items(spark, path, mine, key, parent, known)
    for table, rows in batch.items():
        if table not in _ITEM_KEY:
            prepared.append((table, _prepared_plain(spark, path, table, conform(rows, table))))
    for table, rows in prepared:
        if table in _ITEM_KEY:
            _write_buckets(rows, path, table)
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{table}")


def _prepared_items(
    spark: SparkSession, path: str, batch: Catalog, key: str, parent: str, buckets: int
) -> list[tuple[str, DataFrame]]:
    """New content of the touched buckets of every table with this item key."""
    items = batch.get(parent)
    stored_parent = _stored(spark, path, parent)
    if items is None:
        rows = [df.select(key) for df in batch.values()]
        keys = rows[0]
        for more in rows[1:]:
            keys = keys.union(more)
        keys = keys.distinct().withColumn("stored_key", F.col(key))
    elif stored_parent is None:
        keys = items.select(key).distinct().withColumn("stored_key", F.col(key))
    else:
        keys = match_items(stored_parent, items.dropDuplicates([key]), key).select(key, "stored_key")
    keys = materialize(keys.withColumnRenamed(key, "__key"), "upsert-keys")
    marks = keys.select(F.col("stored_key").alias(key)).distinct()
    # The list of touched buckets is at most ``buckets`` long.
    touched = [r[0] for r in _bucketed(marks, parent, buckets).select(BUCKET).distinct().collect()]
    result = []
    for table in (t for t, k in _ITEM_KEY.items() if k == key):
        stored, rows = _stored(spark, path, table), batch.get(table)
        if stored is None and rows is None:
            continue
        if rows is not None:
            rows = rows.join(keys, rows[key] == keys["__key"]).select(
                *[(F.col("stored_key").alias(key) if c == key else rows[c]) for c in rows.columns]
            )
        result.append((table, _merged(stored, rows, table, marks, touched, buckets)))
    return result


def _merged(
    stored: DataFrame | None, rows: DataFrame | None, table: str, marks: DataFrame, touched: list[int], buckets: int
) -> DataFrame:
    """New content of the touched buckets of a table: old rows of other items, and the new rows."""
    parts = [] if rows is None else [_bucketed(rows, table, buckets)]
    if stored is not None:
        old = stored.where(F.col(BUCKET).isin(touched))
        parts.append(old.join(marks, _ITEM_KEY[table], "left_anti"))
        # An overwrite leaves a folder alone that it has no rows for, so each touched bucket
        # gets one row without an item; readers drop such rows.
        parts.append(_bucketed(marks, table, buckets).select(BUCKET).distinct())
    merged = parts[0]
    for more in parts[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    return materialize(merged, "upsert")


def _prepared_plain(spark: SparkSession, path: str, table: str, rows: DataFrame) -> DataFrame:
    stored = _stored(spark, path, table)
    if stored is None:
        return rows
    key = "id" if table == "workspaces" else "workspace_id"
    return materialize(replace_items(conform(stored, table), rows, key), "upsert")


def _stored(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    schema = struct_of(table)
    if table in _ITEM_KEY:
        schema = schema.add(BUCKET, "integer")
    try:
        stored = spark.read.schema(schema).parquet(f"{path}/{table}")
        return stored.where(F.col(_ITEM_KEY[table]).isNotNull()) if table in _ITEM_KEY else stored
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class StoredCatalog(Mapping):
    """Tables of a stored catalog. Parts of it read the buckets of the items asked for, and no others."""

    def __init__(self, stored: dict[str, DataFrame], buckets: int) -> None:
        self._stored, self._buckets = stored, buckets

    def __getitem__(self, table: str) -> DataFrame:
        return conform(self._stored[table], table)

    def __iter__(self) -> Iterator[str]:
        return iter(self._stored)

    def __len__(self) -> int:
        return len(self._stored)

    def of_items(self, key: str, *items: str) -> Catalog:
        """The catalog with the rows of some items only, in the tables that belong to items of this kind.

        The buckets follow from the ids before anything is read, so the scan lists their folders alone.
        """
        buckets = [F.pmod(F.xxhash64(F.lit(i)), F.lit(self._buckets)).cast("int") for i in items]
        wanted = F.col(key).isin(*items) & F.col(BUCKET).isin(*buckets)
        return {t: conform(df.where(wanted) if _ITEM_KEY.get(t) == key else df, t) for t, df in self._stored.items()}

    def of_each(self, key: str, items: DataFrame) -> Catalog:
        """Like :meth:`of_items` for a frame of ids, however many.

        The bucket is part of the join key: Spark takes the folders to read from the other side at
        run time (dynamic partition pruning) where that side is small enough to be sent along.
        """
        asked = items.select(key).distinct()
        marks = asked.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(self._buckets)).cast("int"))
        # Written, so that its size is known. Spark prunes only by a side that a comparison has made smaller.
        marks = materialize(marks, "asked-items").where(F.col(BUCKET) >= 0)
        return {
            t: conform(df.join(marks, [key, BUCKET], "left_semi") if _ITEM_KEY.get(t) == key else df, t)
            for t, df in self._stored.items()
        }


def one_item(catalog: Catalog, key: str, item: str) -> Catalog:
    """A catalog with the rows of one item in every table that has the key."""
    if isinstance(catalog, StoredCatalog):
        return catalog.of_items(key, item)
    return {name: (df.where(F.col(key) == item) if key in df.columns else df) for name, df in catalog.items()}


def read_catalog(spark: SparkSession, path: str, tables: Sequence[str] | None = None, views: bool = True) -> StoredCatalog:
    """Catalog tables below ``path``; with ``views`` each becomes a temporary view.

    Columns that an older table lacks read as null.
    """
    stored = {table: _stored(spark, path, table) for table in tables or DDL}
    catalog = StoredCatalog({t: df for t, df in stored.items() if df is not None}, _layout(spark, path) or BUCKETS)
    if views:
        register_views(catalog)
    return catalog


def register_views(catalog: Catalog) -> None:
    """Make every catalog table queryable by name."""
    for table, df in catalog.items():
        df.createOrReplaceTempView(table)


#: Table functions over the views of a catalog: name, the view they need, arguments and result, body.
_FUNCTIONS = (
    (
        "reachable", "measure_dependencies", "model STRING, measure STRING", "reached STRING, home_table STRING",
        """SELECT DISTINCT referenced_name, referenced_table FROM measure_dependencies
           WHERE semantic_model_id = model AND measure_name = measure AND dependency_type = 'measure'""",
    ),
    (
        "needed_columns", "measure_dependencies", "model STRING, measure STRING", "table_name STRING, column_name STRING",
        """SELECT DISTINCT referenced_table, referenced_name FROM measure_dependencies
           WHERE semantic_model_id = model AND measure_name = measure AND dependency_type = 'column'""",
    ),
    (
        "neighbours", "semantic_model_relationship", "model STRING, of_table STRING", "neighbour STRING",
        """SELECT DISTINCT if(from_table = of_table, to_table, from_table) FROM semantic_model_relationship
           WHERE semantic_model_id = model AND (from_table = of_table OR to_table = of_table)""",
    ),
    (
        "expanded", "semantic_model_relationship", "model STRING, of_table STRING, max_depth INT", "table_name STRING, depth INT",
        """WITH RECURSIVE walk(node, depth, way) MAX RECURSION LEVEL 100 AS (
             SELECT of_table, 0, array(of_table)
             UNION ALL
             SELECT r.to_table, w.depth + 1, array_append(w.way, r.to_table)
             FROM walk w JOIN semantic_model_relationship r ON r.semantic_model_id = model AND r.from_table = w.node
             WHERE w.depth < max_depth AND NOT array_contains(w.way, r.to_table)
               AND contains(lower(coalesce(r.cardinality, 'manyToOne')), 'many'))
           SELECT node, min(depth) FROM walk GROUP BY node""",
    ),
)


def register_functions(spark: SparkSession, catalog: Catalog) -> None:
    """Make closures and neighbourhoods callable in SQL, as table functions over the views of the catalog.

    ``reachable`` and ``needed_columns`` read the stored dependencies and follow as many steps as
    these do (all, where they are closed). ``expanded`` follows relationships from the many side to the one
    side of one model, way by way: it is for questions about single tables;
    :func:`graph.expand_tables` answers for many at once.
    """
    register_views(catalog)
    for name, view, arguments, result, body in _FUNCTIONS:
        if view in catalog:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({result}) RETURN {body}")


#: Plan nodes that do more than read.
_NOT_READING = ("Command", "Insert", "Create", "Drop", "ScriptTransformation", "ScriptInputOutput")


def _nodes(plan: object) -> Iterator[object]:
    """Nodes of an analysed plan, those inside views and subqueries included."""
    yield plan
    for group in (plan.children(), plan.innerChildren()):
        for i in range(group.size()):
            child = group.apply(i)
            if hasattr(child, "innerChildren"):
                yield from _nodes(child)


def query_catalog(spark: SparkSession, sql: str, args: dict[str, object] | None = None) -> DataFrame:
    """Run a read-only query over the registered views and functions.

    ``args`` are values for named markers (``:name``), which are never read as SQL. The text is a
    subquery of the statement that runs, where commands are a syntax error; a query whose analysed plan does
    more than read, as by starting a script, is refused before it runs.
    """
    text = sql.strip().rstrip(";")
    if not text:
        raise ValueError("only queries are allowed")
    found = spark.sql(f"SELECT * FROM (\n{text}\n)", args=args or {})
    for node in _nodes(found._jdf.queryExecution().analyzed()):
        if any(word in node.nodeName() for word in _NOT_READING):
            raise ValueError("only queries are allowed")
    return found


def table_counts(catalog: Catalog) -> DataFrame:
    """Row count per table in name order, then one total row (table name null)."""
    counts = None
    for table in sorted(catalog):
        one = catalog[table].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(table).alias("table_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("the catalog has no tables")
    return (
        counts.rollup("table_name")
        .agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("tables"))
        .orderBy(F.col("table_name").asc_nulls_last())
    )


def complete(spark: SparkSession, catalog: Catalog) -> Catalog:
    """The catalog with an empty frame for each table that it lacks."""
    return {**{t: empty(spark, t) for t in DDL if t not in catalog}, **catalog}
