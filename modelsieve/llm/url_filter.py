"""URL verdicts by rules on hosts and paths and by a list of canonical URLs.

Everything listed has a key: the host and path of a rule, or the canonical form of a listed URL. A blocked
Bloom filter holds the keys: one 256-bit block of eight words per key, one bit in each word, so that a
test reads a single row of the filter. A page's URL asks for its own canonical form, and for one host
suffix and path prefix per shape that a rule has (labels of the host, characters of the path). The
few keys that pass the filter meet the list in an exact hash join, which removes false positives.

The filter is a written table of BITS_PER_KEY bits per listed key: Spark knows its size, and broadcasts
it only below its threshold. Distinct URLs are tested once, so a URL that most pages share is one row.

The rule with the longest text wins (ties: the longer host, then block before allow). A URL without a
rule is blocked if its canonical form is listed. Canonical: host without user, default port and final
dot; path with upper-case escapes and without final slashes; query in order of its parts, without
``utm_`` parts; no scheme, no fragment.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, and is allowed. An
empty list of rules or URLs decides nothing. Repeated pages, null ids and repeated rules or listed URLs
change nothing; listed nulls are left out. Only the id and URL columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
WORDS = 8
BITS = 256
SALTS = 32
#: Stands for the canonical form of what has none; no canonical form ends in a slash.
NO_URL = "://"
RULE = "host string, path string, action string"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Canonical form; null where there is no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.?(:80|:443)?$", "")
    # Escapes by their two digits, each upper-cased in place.
    path = F.regexp_replace(path_of(url), r"/+$", "")
    parts = F.split(path, "%")
    escaped = F.array_join(
        F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[0-9a-fA-F]{2}"), F.concat(F.upper(F.left(p, F.lit(2))), F.substr(p, F.lit(3)))).otherwise(p)),
        "%",
    )
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.startswith("utm_")))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, escaped, asked))


def _rule_key(salt: Column, host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), salt.cast("string"), F.lit(" "), host, path)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def listed_keys(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Everything listed: ``key, action, host, path`` (of a rule; null for a URL). ``urls``: ``url``."""
    rule = rules.where("host is not null and path is not null and action is not null")
    rule = rule.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").distinct()
    rule = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rule = rule.select(_rule_key(F.col("salt"), F.col("host"), F.col("path")).alias("key"), "action", "host", "path")
    # A URL becomes listed once, however often it is named.
    url = urls.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct()
    none = F.lit(None).cast("string")
    return rule.unionByName(
        url.select(F.concat(F.lit("url "), "url").alias("key"), F.lit("block").alias("action"), none.alias("host"), none.alias("path"))
    )


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _masks(key: Column) -> list[Column]:
    """For each word, the bit of the key: five bits of a second hash choose one of 32."""
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * w).bitwiseAND(F.lit(31)).cast("int")) for w in range(WORDS)]


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The blocks of a filter over ``key``, sized for ``n`` keys, and how many blocks there can be."""
    blocks = max(1, -(-n * BITS_PER_KEY // BITS))
    words = [mask.alias(f"w{w}") for w, mask in enumerate(_masks(F.col("key")))]
    placed = keys.select(_place(F.col("key"), blocks), *words)
    held = placed.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))
    return written(held, "bloom"), blocks


def possible(asked: DataFrame, held: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` whose ``key`` the filter may hold."""
    hit = [F.col(f"w{w}").bitwiseAND(mask) != 0 for w, mask in enumerate(_masks(F.col("key")))]
    found = asked.withColumn("block", _place(F.col("key"), blocks)).join(held, "block")
    for test in hit:
        found = found.where(test)
    return found.select(*asked.columns)


def _asked(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``host, path, url`` with each ``key`` to look for; ``shapes``: host labels and path characters."""
    kinds = [F.struct(F.lit(0).alias("labels"), F.lit(0).alias("chars"))]
    kinds += [F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in shapes]
    each = urls.withColumn("shape", F.explode(F.array(*kinds)))
    labels, chars = F.col("shape.labels"), F.col("shape.chars")
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -labels)
    rule = F.when(
        (labels > 0) & (_labels(F.col("host")) >= labels) & (F.length("path") >= chars),
        _rule_key(F.pmod(F.xxhash64("host", "url"), F.lit(SALTS)), suffix, F.left(F.col("path"), chars)),
    )
    key = F.when(labels == 0, F.concat(F.lit("url "), "url")).otherwise(rule)
    return each.select("host", "path", "url", key.alias("key")).where("key is not null")


def verdicts(pages: DataFrame, rules: DataFrame, urls: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``listed`` (its URL is)."""
    url = F.col(url_col)
    base = pages.select(
        F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(canonical(url), F.lit(NO_URL)).alias("url")
    )
    listed = written(listed_keys(rules, urls), "listed-keys")
    held, blocks = bloom(listed, listed.count())
    rule = listed.where("host is not null")
    # As many as the rules have different sizes.
    shapes = sorted(map(tuple, rule.select(_labels(F.col("host")), F.length("path")).distinct().collect()))
    asked = _asked(base.select("host", "path", "url").distinct(), shapes)
    hits = possible(asked, held, blocks).join(listed.withColumnsRenamed({"host": "r_host", "path": "r_path"}), "key")
    text = F.concat("r_host", "r_path")
    best = F.max(
        F.when(
            F.col("r_host").isNotNull(),
            F.struct(F.length(text).alias("chars"), F.length("r_host").alias("host"), "action", text.alias("text")),
        )
    )
    decided = hits.groupBy("host", "path", "url").agg(best.alias("best"), F.max(F.col("r_host").isNull()).alias("listed"))
    decided = decided.select("host", "path", "url", F.col("best.text").alias("rule"), F.col("best.action").alias("action"), "listed")
    listed_flag = F.coalesce(F.col("listed"), F.lit(False))
    return base.join(decided, ["host", "path", "url"], "left").select(
        F.col("page").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(listed_flag, "block").otherwise("allow")).alias("verdict"),
        listed_flag.alias("listed"),
    )
