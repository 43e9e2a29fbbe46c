"""Substring search in measures through an index of trigrams.

The index lists, for each run of three characters, the measures whose name or expression holds it. A
measure that holds a text holds all of the text's trigrams, so a search intersects their lists and
looks at the few texts that are left. Lists lie in hash buckets of the trigram: a search reads the
buckets of its own trigrams and, of the texts, those of the measures found.

Case does not matter. Texts of fewer than three characters have no trigram; :func:`search` reads all
measures for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.plans.fixpoint import materialize

N = 3
BUCKETS = 256
BUCKET = "gram_bucket"
KEY = ["semantic_model_id", "table_name", "measure_name"]


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in lower case."""

    def of_lower(lower: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(lower) - (N - 1)), lambda i: i > 0)
        runs = F.transform(places, lambda i: F.substr(lower, i, F.lit(N)))
        return F.when(F.length(lower) >= N, F.array_distinct(runs)).otherwise(F.expr("cast(array() as array<string>)"))

    # Bound to a name, or each run would put the whole text in lower case again.
    return F.element_at(F.transform(F.array(F.lower(text)), of_lower), 1)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(measures: DataFrame) -> DataFrame:
    """``gram``, where it is (``name`` or ``expression``) and the key of the measure.

    Measures of one key with different expressions list their common trigrams once each.
    """
    parts = F.array(
        F.struct(F.lit("name").alias("part"), grams(F.col("measure_name")).alias("grams")),
        F.struct(F.lit("expression").alias("part"), grams(F.coalesce("expression", F.lit(""))).alias("grams")),
    )
    # Measures that come again go before their trigrams are listed, which are a hundred times as many rows.
    each = measures.select(*KEY, "expression").distinct().select(*KEY, F.inline(parts))
    return each.select(F.explode("grams").alias("gram"), "part", *KEY)


def write_index(measures: DataFrame, path: str) -> None:
    """Store the index; rows of a bucket are sorted by trigram, so that a scan skips most of a file."""
    bucketed = postings(measures).withColumn(BUCKET, _bucket(F.col("gram")))
    (
        bucketed.hint("rebalance", BUCKET)
        .sortWithinPartitions(BUCKET, "gram")
        .write.mode("overwrite")
        .partitionBy(BUCKET)
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"gram STRING, part STRING, {', '.join(f'{k} STRING' for k in KEY)}, {BUCKET} INT").parquet(path)


def candidates(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Measures that hold all trigrams of a text (column ``text``), in one of their parts.

    A text is looked up by the one of its trigrams that the fewest measures hold, and these measures'
    lists are compared with its other trigrams. So trigrams that all measures hold are read once, and are not
    paired with every text that has them.
    """
    asked = texts.select("text").distinct().withColumn("__grams", grams(F.col("text"))).where(F.size("__grams") > 0)
    each = asked.select("text", "__grams", F.explode("__grams").alias("gram"))
    # Written, so that its size is known; the comparison lets Spark prune buckets by it.
    each = materialize(each.withColumn(BUCKET, _bucket(F.col("gram"))), "asked-grams").where(F.col(BUCKET) >= 0)
    here = [BUCKET, "gram"]
    lists = index.join(each.select(*here).distinct(), here)
    sizes = lists.groupBy(*here).agg(F.count(F.lit(1)).alias("__size"))
    # A trigram that nothing holds has no size and comes first; the text then has no measures.
    rarest = each.join(sizes, here, "left").groupBy("text").agg(
        F.min(F.struct(F.coalesce("__size", F.lit(0)).alias("size"), *here, "__grams")).alias("__first")
    )
    rarest = materialize(rarest.select("text", f"__first.{BUCKET}", "__first.gram", "__first.__grams"), "rarest-grams")
    found = index.join(rarest.where(F.col(BUCKET) >= 0), here).select("text", "__grams", "part", *KEY).distinct()
    # At most the trigrams asked for that one measure holds.
    held = lists.groupBy("part", *KEY).agg(F.collect_set("gram").alias("__held"))
    return found.join(held, ["part", *KEY]).where(F.size(F.array_except("__grams", "__held")) == 0).select("text", *KEY).distinct()


def search(index: DataFrame, measures: DataFrame, texts: DataFrame) -> DataFrame:
    """``text`` and key of every measure whose name or expression contains the text, whatever its case."""
    holds = F.lower("measure_name").contains(F.lower("text")) | F.lower(F.coalesce("expression", F.lit(""))).contains(F.lower("text"))
    found = measures.join(candidates(index, texts), KEY).where(holds).select("text", *KEY)
    short = texts.select("text").distinct().where((F.length("text") < N) & F.col("text").isNotNull())
    # The few texts without a trigram go through all measures together, as one list beside each measure.
    listed = short.agg(F.sort_array(F.collect_set("text"))).first()[0]
    if not listed:
        return found
    hits = F.filter(
        F.array(*map(F.lit, listed)),
        lambda t: F.lower("measure_name").contains(F.lower(t)) | F.lower(F.coalesce("expression", F.lit(""))).contains(F.lower(t)),
    )
    return found.unionByName(measures.select(F.explode(hits).alias("text"), *KEY))
