"""URL filtering by host-suffix and path-prefix expressions.

Each URL is expanded into (host suffix, path prefix) expressions, only of the label counts and path lengths that some
rule has. Expressions meet rules on a short hash prefix; the full digest then confirms, and the longest rule wins.

Null URLs and those without `://` have an empty host and path and meet no rule. Where a rule is listed both ways,
block wins; of equally long rules the one with the longer host wins. Repeated rows stay rows of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Hex digits of the digest that the join compares first.
SHORT = 8
#: Up to so many rules are sent to every executor (about 200 bytes each, 20 MB); more are joined by a shuffle.
BROADCAST_RULES = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.coalesce(rest, F.lit("")), r"(?s)[?#].*", "")
    host = F.regexp_extract(whole, r"(?s)^[^/]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(whole, r"(?s)^[^/]*(.*)$", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null) and verdict of each page.

    rules: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with the rule's.
    """
    known = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))  # "block" sorts behind "allow"
        .withColumn("rule_digest", digest(F.col("host"), F.col("path")))
        .select(F.col("rule_digest").substr(1, SHORT).alias("rule_short"), "rule_digest", F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "rule_verdict", (F.size(F.split("host", r"\.", -1))).alias("labels"), F.length("path").alias("path_chars"))
    )
    shape = known.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_chars").alias("chars"), F.count(F.lit(1)).alias("n")).first()
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # A URL's own expressions: the suffixes with as many labels as some rule, times the prefixes as long as some rule's. Each is one expression, whatever the rules.
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    numbers = lambda found: "array(" + ", ".join(map(str, sorted(found))) + ")"
    suffixes = F.expr(rf"transform(filter({numbers(shape['labels'])}, k -> k <= size(split(host, '[.]', -1))), k -> substring_index(host, '.', -k))")
    prefixes = F.expr(f"transform(filter({numbers(shape['chars'])}, k -> k <= length(path)), k -> left(path, k))")
    # The texts of a URL stay with its expressions, so that nothing is joined back; the best rule is kept by an aggregate that combines before the exchange.
    expressions = urls.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes)).withColumn("digest", digest(F.col("suffix"), F.col("prefix")))
    meeting = (F.col("digest").substr(1, SHORT) == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest"))
    met = expressions.join(F.broadcast(known) if shape["n"] <= BROADCAST_RULES else known, meeting, "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "host_chars", "rule", "rule_verdict"))).alias("best")
    return met.groupBy("row", "page_id", "host", "path").agg(best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
