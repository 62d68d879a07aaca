"""URL filters: site rules and pattern rules, fetched by their rarest literal token.

A rule is indexed under one token, a run of ``[a-z0-9]`` that every matching URL must hold as a whole token.
Of a rule's tokens the one that the fewest URLs hold is taken, counted over all URLs. URLs fetch candidate
rules by their own tokens, and only those rules run their regular expression. Column expressions and joins
alone: there is no Python on any row.

Pattern syntax (letters are compared without regard to A-Z case):

==============  =====================================================================
``||`` first    the host or a subdomain of it begins here
``|``           first: the URL begins here; last: it ends here
``*``           any characters
``^``           one character outside ``[a-z0-9%]``, or the end
``/.../``       a Java regular expression over the lower-cased URL, as it stands
other           itself
==============  =====================================================================

A pattern without a whole token, such as ``/.../``, stands under the empty token, which every URL holds.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsluice.llm.common import written

#: A token held by more than one part in so many of all token rows is dealt over several tasks. By counting, no more
#: than this number of tokens can be so frequent.
SHARES = 256


def folded(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, folded; empty without ``://`` or on null."""
    return folded(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or on null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.+?(){}\[\]$|^*])", r"\\$1")


def _whole_tokens(text: Column) -> Column:
    """Tokens of a pattern that stand between characters which cannot belong to a token."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))


def site_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict): they fit the host and its subdomains where the URL's path starts with theirs.

    A null host or path is empty; an empty host fits every host, an empty path every path.
    """
    host, path = folded(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    return rules.select(
        F.concat(host, path).alias("rule"),
        "verdict",
        F.lit(True).alias("on_site"),
        F.concat(
            F.when(host == "", r"(?s)\A[^/]*").otherwise(F.concat(F.lit(r"(?s)\A([^/]*\.)?"), _literal(host))),
            F.when(path == "", r"(/|\z)").otherwise(_literal(path)),
        ).alias("regex"),
        _whole_tokens(F.concat(F.lit("||"), host, folded(path))).alias("tokens"),
        F.length(F.concat(host, path)).alias("weight"),
    )


def pattern_rules(rules: DataFrame) -> DataFrame:
    """Rules (pattern, verdict) in the syntax of this module; null or empty patterns fit nothing."""
    p = folded(F.col("pattern"))
    raw = (F.length(p) > 2) & p.startswith("/") & p.endswith("/")
    body = F.regexp_replace(F.regexp_replace(p, r"\A\|{1,2}", ""), r"\|\z", "")
    head = (
        F.when(p.startswith("||"), F.lit(r"\A[a-z][a-z0-9+.-]*://([^/?#]*\.)?")).when(p.startswith("|"), F.lit(r"\A")).otherwise(F.lit(""))
    )
    tail = F.when((F.length(p) > 1) & p.endswith("|"), F.lit(r"\z")).otherwise(F.lit(""))
    text = F.regexp_replace(body, r"([\\.+?(){}\[\]$|])", r"\\$1")
    text = F.replace(F.replace(text, F.lit("^"), F.lit(r"([^a-z0-9%]|\z)")), F.lit("*"), F.lit(".*"))
    return rules.filter(F.coalesce(F.length("pattern") > 0, F.lit(False))).select(
        F.col("pattern").alias("rule"),
        "verdict",
        F.lit(False).alias("on_site"),
        F.when(raw, F.expr("substring(pattern, 2, length(pattern) - 2)")).otherwise(F.concat(F.lit("(?s)"), head, text, tail)).alias("regex"),
        F.when(raw, F.array().cast("array<string>")).otherwise(_whole_tokens(p)).alias("tokens"),
        F.length("pattern").alias("weight"),
    )


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a URL, the empty token among them."""
    return F.array_union(F.array(F.lit("")), F.regexp_extract_all(folded(url), F.lit("[a-z0-9]+"), F.lit(0)))


def _url_tokens(urls: DataFrame) -> DataFrame:
    return urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))


KEY = ["rule", "verdict", "on_site"]


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its rarest token, with the number of tasks that the token's URLs are dealt over.

    ``urls`` need not be distinct. Rules are no corpus data: Spark joins their tokens by the size it knows.
    """
    rules = rules.dropDuplicates(KEY)
    own = rules.select(*KEY, F.explode(F.array_union(F.array(F.lit("")), "tokens")).alias("token"))
    wanted = own.select("token").distinct()
    met = _url_tokens(urls).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    total = urls.agg(F.sum(F.size(url_tokens(F.col("url")))).alias("n")).first()["n"] or 1
    # a real token beats the empty one even where every URL holds it; a token that no URL holds counts 0
    order = F.struct((F.col("token") == "").alias("void"), F.coalesce("n", F.lit(0)).alias("n"), "token")
    best = own.join(met, "token", "left").groupBy(*KEY).agg(F.min(order).alias("best"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("best.n") * F.lit(SHARES / total)).cast("int"))
    return rules.drop("tokens").join(best.select(*KEY, F.col("best.token").alias("token"), parts.alias("parts")), KEY)


def matches(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, rule, verdict, on_site, weight) for every rule that fits a URL; ``urls`` holds distinct URLs.

    The rows of a frequent token are dealt by a digest of the URL over as many tasks as its share asks for, and
    its rules are repeated that often.
    """
    hot = F.broadcast(index.filter("parts > 1").select("token", "parts").distinct())  # at most SHARES tokens
    tokens = _url_tokens(urls).join(hot, "token", "left")
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("url"), F.coalesce("parts", F.lit(1)))).drop("parts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    candidates = tokens.join(index.withColumn("salt", salts).drop("parts"), ["token", "salt"])
    site = F.concat(url_host(F.col("url")), url_path(F.col("url")))
    subject = F.when(F.col("on_site"), site).otherwise(folded(F.col("url")))
    return candidates.filter(F.regexp_like(subject, F.col("regex"))).select("url", *KEY, "weight")


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row.

    ``rules`` is the union of ``site_rules`` and ``pattern_rules``. The longest site rule that fits decides (of
    equal rules with two verdicts, ``block``). Without one, an ``allow`` pattern that fits wins over ``block``
    patterns; without any the verdict is ``allow``. ``pattern`` is the longest pattern that decided, else null;
    ties go to the first in order of text.

    A null URL, an empty one and one without ``://`` have an empty host and path, and site rules do not fit
    them; patterns are tried on the text as it is (null: none). Equal URLs are judged once, repeated rows are all
    returned, an empty table gives no row, and no other column of ``pages`` is read. An empty rule table
    allows all. A ``/.../`` rule that is no regular expression fails the job.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    given = rows.select("url").filter(F.col("url").isNotNull())
    index = written(rule_index(rules, given), "url-rules")
    blocks = F.col("verdict") == "block"
    longest = F.struct("weight", blocks.alias("blocks"), "rule")
    first = F.struct(blocks.alias("blocks"), (-F.col("weight")).alias("weight"), "rule")  # allow, long, early in text order
    verdicts = matches(given.distinct(), index).groupBy("url").agg(
        F.max(F.when(F.col("on_site"), longest)).alias("site"), F.min(F.when(~F.col("on_site"), first)).alias("choice")
    )
    # rows without a URL meet no verdict: they stay out of the join, where they would be one key
    joined = rows.filter(F.col("url").isNotNull()).join(verdicts, "url", "left")
    joined = joined.unionByName(rows.filter(F.col("url").isNull()), allowMissingColumns=True)
    by_site = F.col("site").isNotNull()
    blocked = F.when(by_site, F.col("site.blocks")).otherwise(F.coalesce("choice.blocks", F.lit(False)))
    return joined.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        F.col("site.rule").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
        F.when(~by_site, F.col("choice.rule")).alias("pattern"),
    )


def _listed(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A short list as a table of string columns, without Python on a row."""
    one = [F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, row))) for row in rows]
    kind = "array<struct<" + ", ".join(f"{n}: string" for n in names) + ">>"
    return spark.range(1).select(F.inline(F.array(*one).cast(kind)))


def rule_table(spark: SparkSession, sites: list[tuple[str, str, str]], patterns: list[tuple[str, str]]) -> DataFrame:
    """Rules from short lists of (host, path, verdict) and (pattern, verdict); long ones belong in a table."""
    by_site = site_rules(_listed(spark, sites, ("host", "path", "verdict")))
    return by_site.unionByName(pattern_rules(_listed(spark, patterns, ("pattern", "verdict"))))


#: The site rules of production: host, path, verdict.
SITES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The patterns of production, for URLs that no site rule fits.
PATTERNS = [
    ("://*^casino^*/", "block"),
    ("://*^pills^*/", "block"),
    ("://*^bets^*/", "block"),
    ("://*^poker^*/", "block"),
    ("^login^", "block"),
    ("^cart^", "block"),
    ("/search?", "block"),
    ("||blog.tionsh.*/en/*?utm_source=feed|", "block"),
    ("^page=2^ref=x|", "block"),
    (r"/\/[0-9]{5,}(\.html|\/)?$/", "block"),
    ("||m.casino-win.example.org^", "allow"),
    ("^example.org/de/", "allow"),
]
