"""URL filters: host rules by longest fit, pattern rules found by their rarest literal token. Native.

A pattern rule lists the tokens ([a-z0-9]+ runs of the lower-cased url) that any url it matches must
contain. It is filed under the one that the fewest urls contain. The tokens of a url fetch the rules
filed under them, and only these rules run their regular expression.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.scratch import written

TOKEN = "[a-z0-9]+"

# Fixed values: (verdict, host, path) of the host rules.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# Production patterns: (rule, regular expression on the lower-cased url, tokens a match must contain).
# Expressions use what Java's and RE2's syntax share.
PATTERNS = [
    ("spam host", r"^[a-z]+://([^/?#]*\.)?spam-farm\.", ["spam", "farm"]),
    ("casino", r"[./-]casino[./-]", ["casino"]),
    ("adult", r"[./-](xxx|porn)[./-]", []),
    ("pills", r"[/=-](viagra|cialis)([/&#.-]|$)", []),
    ("login page", r"/wp-login\.php([?#]|$)", ["wp", "login", "php"]),
    ("trackback", r"/trackback/?([?#]|$)", ["trackback"]),
    ("cart", r"/(cart|checkout)/?\?(.*&)?add=", ["add"]),
    ("session", r"[?&;](sid|phpsessid|jsessionid)=[a-z0-9]+", []),
    ("calendar", r"/calendar/[0-9]+/[0-9]+", ["calendar"]),
]


def rule_table(spark: SparkSession, patterns: list = PATTERNS) -> DataFrame:
    """(rule, pattern, tokens) as a DataFrame, priority by place in the list."""
    rows = [
        F.struct(
            F.lit(i).alias("priority"),
            F.lit(rule).alias("rule"),
            F.lit(pattern).alias("pattern"),
            F.array(*map(F.lit, tokens)).cast("array<string>").alias("tokens"),
        )
        for i, (rule, pattern, tokens) in enumerate(patterns)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(0)))


def filed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """The rules with the token each is filed under; null for a rule without a literal token.

    Tokens of rules are counted over all urls; the count is partial in each task.
    """
    literals = rules.select("rule", "priority", F.explode("tokens").alias("token"))
    seen = (
        urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
        .join(broadcast_if_small(literals.select("token").distinct()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        literals.join(broadcast_if_small(seen), "token", "left")
        .groupBy("priority")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return rules.drop("tokens").join(rarest, "priority", "left")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, pattern_rule): the first rule in the list that matches each distinct matched url."""
    urls = pages.select("url").where("url IS NOT NULL")
    index = written(filed(rules, urls), "url-rules")
    keys = F.concat(url_tokens(F.col("url")), F.array(F.lit("")))  # '' fetches rules without a token
    fetched = urls.select("url", F.explode(keys).alias("token")).join(
        broadcast_if_small(index.na.fill("", ["token"]), "pattern"), "token"
    )
    return (
        fetched.where(F.rlike(F.lower("url"), F.col("pattern")))
        .groupBy("url")
        .agg(F.min(F.struct("priority", "rule"))["rule"].alias("pattern_rule"))
    )


def host_and_path(url: Column) -> tuple:
    """What stands between the first :// and / ? # (A-Z lower-cased), and from there to ? or #."""
    there = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def host_rule(host: Column, path: Column, rules: list) -> Column:
    """The longest rule (host and path together) that fits, null if none does; a bounded list."""

    def fits(verdict, name, start):
        own = (host == name) | host.endswith("." + name)
        found = F.struct(F.lit(len(name + start)).alias("size"), F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when(own & path.startswith(start), found)

    found = [fits(*rule) for rule in rules]
    return F.array_max(F.array(*found)) if found else F.lit(None)


def judge(pages: DataFrame, rules: DataFrame = None, host_rules: list = HOST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule of every row of `pages`.

    The verdict is that of the longest host rule; without one, block if a pattern rule matches, else
    allow. Null urls have an empty host and path and are allowed. Repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    narrow = pages.select("page_id", "url")
    found = broadcast_if_small(written(matches(narrow, rules), "url-matches"), "url")
    host, path = host_and_path(F.col("url"))
    split = narrow.join(found, "url", "left").withColumns({"host": host, "path": path})
    ruled = split.withColumn("_fit", host_rule(F.col("host"), F.col("path"), host_rules))
    own = F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", own).alias("verdict"), "pattern_rule",
    )


def judge_sql(host_rules: list = HOST_RULES, patterns: list = PATTERNS) -> str:
    """The same rows in DuckDB SQL, testing every pattern on every url."""

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    fits = " UNION ALL ".join(
        f"SELECT {quoted(v)} verdict, {quoted(h)} host, {quoted(p)} path" for v, h, p in host_rules
    )
    tests = " ".join(f"WHEN regexp_matches(lower(url), {quoted(p)}) THEN {quoted(r)}" for r, p, _ in patterns)
    return f"""
WITH parts AS (
  SELECT page_id, url, row_number() OVER () AS n,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path,
    CASE {tests} END AS pattern_rule
  FROM pages
), rules AS ({fits}), fitting AS (
  SELECT n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n
)
SELECT page_id, host, path, rule, pattern_rule,
  coalesce(verdict, CASE WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting USING (n)
"""
