"""Allow and block rules on URL prefixes, by a sorted sweep over reversed-host keys.

A rule (host, path) covers its host and all subdomains where the path starts with the rule's. Canonical keys hold the host
labels in reverse, so at each level of a URL's host ("com", "com.example", ...) the rules set on exactly that host are
prefixes of the path, that is, intervals in sorted order that nest. Each rule carries the stack of rules that are active
from its start. One sort per host level then merges rules and URLs: the last rule before a URL gives the stack, of which
only those whose interval has not yet ended apply. The longest (then the one with the longest host, then block) wins.

Everything is DataFrame operations. Distinct (host, path) are judged once; hosts with many URLs are dealt over salts, to
which their rules are copied, so that one host never has to sit in one task.

Null URLs and URLs without ``://`` have an empty host and path, and no rule fits them. URLs without a fitting rule get
``default`` and a null rule. Every input row gives one row, with repeated and null ids; further columns are left aside
whatever their names. Whole URLs are judged, however long. Empty tables of pages or rules are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import settle

#: URLs of one host level that are swept together, at least.
SALT_ROWS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule its key and the stack of rules active from its start, itself included."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    rule = rules.select(
        F.array_join(_reversed(host), ".").alias("level"), F.col("path").alias("from"),
        F.struct(
            F.length(F.concat(host, "path")).alias("length"), F.length(host).alias("host_length"),
            F.col("verdict"), F.concat(host, "path").alias("rule"), F.col("path").alias("path"),
        ).alias("active"),
    )  # of equal rules block wins: it is the larger word
    prefixes = rule.select(
        "level", "from",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("from")), lambda n: F.substr(F.col("from"), F.lit(1), n))).alias("prefix"),
    ).distinct()
    enclosing = rule.select("level", F.col("from").alias("prefix"), "active")
    return prefixes.join(enclosing, ["level", "prefix"]).groupBy("level", "from").agg(F.collect_set("active").alias("stack"))


def judge_urls(
    df: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow",
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """``id_column``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` has the text columns ``verdict`` (allow or block), ``host`` and ``path`` (with its leading slash).
    """
    host, path = host_and_path(url_column)
    pages = df.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    # written, so that the sizes of the rule tables are known before URLs are joined with them
    stacks = settle(_rule_stacks(rules))
    per_level = settle(stacks.groupBy("level").agg(F.count(F.lit(1)).alias("n_rules")))

    labels = _reversed(F.col("host"))
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    keys = pages.select("host", "path").distinct()
    keys = settle(keys.select("host", "path", F.explode(levels).alias("level")).join(per_level, "level"))
    salts = settle(
        keys.groupBy("level", "n_rules").agg(F.count(F.lit(1)).alias("n_urls"))
        .select("level", F.ceil(F.col("n_urls") / F.greatest(F.lit(salt_rows), 4 * F.col("n_rules"))).alias("salts"))
    )
    salt = F.pmod(F.xxhash64("host", "path"), F.col("salts")).alias("salt")
    urls = keys.drop("n_rules").join(salts, "level").select(
        "level", salt, F.col("path").alias("from"), F.lit(1).alias("kind"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
        "host", "path",
    )
    starts = stacks.join(salts, "level").select(
        "level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), "from",
        F.lit(0).alias("kind"), "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    sweep = Window.partitionBy("level", "salt").orderBy("from", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = urls.unionByName(starts).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fitting = F.filter("stack", lambda rule: F.startswith(F.col("path"), rule["path"]))
    best = swept.select("host", "path", F.array_max(fitting).alias("best")).groupBy("host", "path").agg(F.max("best").alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
