"""URL filters: pattern rules indexed by their rarest literal token, and host rules where the longest wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough, table

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its path.
HOST_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
_PARAMETERS = (
    "gclid", "fbclid", "msclkid", "dclid", "yclid", "mc_eid", "igshid", "phpsessid", "jsessionid", "sessid", "csrftoken", "nonce", "returnurl", "returnto", "continueurl", "affid", "affiliateid",
    "clickid", "trackingid", "campaignid", "adgroupid", "utm_medium", "utm_campaign", "utm_term", "utm_content", "replytocom", "printable", "sortby", "orderby", "addtocart", "wishlist",
)
_PATHS = (
    "wp-login", "wp-json", "xmlrpc", "cgi-bin", "signup", "register", "logout", "signout", "basket", "wishlist", "myaccount", "unsubscribe", "optout", "trackback", "pingback", "printfriendly", "sitemap",
    "autodiscover", "phpmyadmin", "administrator", "oauth2", "recover-password", "forgot-password", "resetpassword", "addtocart", "returnpolicy", "servlet", "webmail", "cpanel", "graphql",
)
_HOSTS = ("doubleclick", "adserver", "adservice", "pixel", "tracker", "telemetry", "analytics", "clickserve", "popunder", "bannerads", "affiliates", "sponsored", "casino", "torrent", "warez")
_ENDINGS = ("exe", "msi", "dmg", "apk", "iso", "torrent", "woff2", "swf")
#: Regular expressions over the lower-cased url; a url that one of them finds is blocked. Their literal words, of
#: letters and digits, must stand in a url whole for the expression to match, so each is written between separators.
PATTERNS = (
    r"[?&]utm_source=feed(&|#|$)", r"[?&]page=[0-9]+&ref=[a-z]+", r"://m\.[^/]*/de/", r"/(login|signin|cart|checkout)(/|\?|$)",
    r"://ads?\.[^/]*/", r"[?&]sessionid=[0-9a-f]{8,}", r"://blog\.[^/]*/[a-z]{2}/[0-9]+#top$", r"/wp-admin/",
    r"[?&]redirect=https?(:|%3a)", r"://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[:/]",
    *(rf"[?&]{k}=[^&#]+" for k in _PARAMETERS), *(rf"/{k}(/|\?|#|$)" for k in _PATHS), *(rf"[/.]{k}\.[a-z.]+/" for k in _HOSTS), *(rf"\.{k}(\?|#|$)" for k in _ENDINGS),
)
#: Most rules that are broadcast; more are joined by shuffle.
BROADCAST = 50_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first :// up to / ? # or the end; then up to ? # or the end.

    Null, or a url without ://, has both empty.
    """
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def _variants(pattern: str, most: int = 64) -> list[str]:
    """A pattern with its literal alternatives and optional letters written out, one pattern a choice."""
    import re

    done, open_ = [], [pattern]
    while open_:
        p = open_.pop()
        group = re.search(r"\(([^()\[\]]*\|[^()\[\]]*)\)(?![*+?{])", p)
        letter = re.search(r"(?<![\\\])])([a-z0-9])\?", p)
        if len(done) + len(open_) > most or not (group or letter):
            done.append(p)
        elif group:
            open_ += [p[: group.start()] + x + p[group.end() :] for x in re.split(r"(?<!\\)\|", group[1])]
        else:
            open_ += [p[: letter.start()] + x + p[letter.end() :] for x in (letter[1], "")]
    return done


def _literals(pattern: str) -> list[str]:
    import re

    flat = re.sub(r"\[[^\]a-z0-9^\\-]+\](?![*+?{])", "/", pattern)  # classes of separators only
    flat = re.sub(r"\[[^\]]*\][*+?]?(\{[^}]*\})?", "\0", flat)  # other classes
    flat = re.sub(r"\\[^a-zA-Z0-9]([*+?]|\{[^}]*\})", "\0", flat)
    flat = re.sub(r"\\[^a-zA-Z0-9]", "/", flat)
    while True:  # groups with alternatives or a quantifier say nothing; others are read through
        new = re.sub(r"\(([^()|]*)\)(?![*+?{])", r"\1", flat)
        new = re.sub(r"\([^()]*\)[*+?]?(\{[^}]*\})?", "\0", new)
        if new == flat:
            break
        flat = new
    flat = re.sub(r"\\[a-zA-Z]", "\0", flat)
    flat = re.sub(r"(.)([*+?]|\{[^}]*\})", "\0", flat)
    flat = flat.replace("^", "\1").replace("$", "\1")
    return [m for m in re.findall(r"(?<![a-z0-9\0])[a-z0-9]+(?![a-z0-9\0])", flat)]


def literal_choices(pattern: str) -> list[list[str]]:
    """For each way to match a pattern, the words of letters and digits that every such match holds whole.

    Alternatives and optional letters are written out; what is left in classes, groups, quantified atoms and escapes
    says nothing. A word counts with a literal separator, or a class of separators, on both sides.
    """
    return [_literals(v) for v in _variants(pattern)]


def literal_tokens(pattern: str) -> list[str]:
    """The words that every match of a pattern holds whole, whichever way it matches."""
    first, *rest = literal_choices(pattern)
    return [t for t in first if all(t in r for r in rest)]


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def pattern_index(spark, patterns, frequency: DataFrame | None = None) -> DataFrame:
    """(rule, pattern, token): each pattern under the rarest literal token of each of its choices, by the urls' own
    (token, n) if given.

    A token no url has is the rarest. A pattern with a choice without a literal token has a null one alone: it runs on
    every url. No patterns give an empty index.
    """
    rows = []
    for i, p in enumerate(patterns):
        choices = literal_choices(p)
        choices = choices if all(choices) else [[None]]
        rows += [(i, p, c, t) for c, ts in enumerate(choices) for t in ts]
    rules = spark.createDataFrame(rows, "rule int, pattern string, choice int, token string")
    if frequency is not None:
        rules = rules.join(frequency, "token", "left")
    else:
        rules = rules.withColumn("n", F.lit(0))
    first = Window.partitionBy("rule", "choice").orderBy(F.coalesce("n", F.lit(0)), F.desc(F.length("token")), "token")
    return rules.withColumn("k", F.row_number().over(first)).where("k = 1").select("rule", "pattern", "token").distinct()


def token_frequency(urls: DataFrame, wanted: DataFrame, url_col: str = "url") -> DataFrame:
    """(token, n): in how many urls each wanted token stands. Counts cover all urls; only rules' tokens are shuffled."""
    found = urls.select(F.explode(url_tokens(F.col(url_col))).alias("token"))
    wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST) else wanted
    return found.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))


def matched(urls: DataFrame, index: DataFrame, url_col: str = "url", id_col: str = "_w_id") -> DataFrame:
    """Ids of the urls that a pattern finds. A url's tokens fetch its candidates; only those run.

    The rules are broadcast behind a count, else joined by token; a token that many urls have is no key of a rule
    that has a rarer one, and the skew of what remains is split by adaptive execution.
    """
    keyed, loose = index.where("token IS NOT NULL"), index.where("token IS NULL")
    keyed = F.broadcast(keyed) if small_enough(keyed, BROADCAST) else keyed
    rows = urls.select(F.col(id_col), F.lower(F.col(url_col)).alias("_w_url"))
    fetched = rows.select(id_col, "_w_url", F.explode(url_tokens(F.col("_w_url"))).alias("token")).join(keyed, "token").where(F.rlike("_w_url", F.col("pattern"))).select(id_col)
    always = [r["pattern"] for r in loose.select("pattern").collect()]
    if always:  # rules without a literal: few by their nature, one pass for them all
        fetched = fetched.unionByName(rows.where(reduce(lambda a, b: a | b, (F.rlike("_w_url", F.lit(p)) for p in always))).select(id_col))
    return fetched.distinct()


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as host and path in one, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, patterns=PATTERNS, rules=HOST_RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row a page: the host rule's verdict, else the patterns'.

    Null urls have an empty host and path, fit no rule and are allowed. Pages that share an id are judged each by its
    own url. Distinct urls are shuffled once; those that a pattern finds are joined back, broadcast while they are few.
    Without patterns, pages that no host rule fits are allowed. An empty table gives an empty one; other columns are
    left out, so none can clash.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    literals = sorted({t for p in patterns for c in literal_choices(p) for t in c})
    wanted = spark.createDataFrame([(t,) for t in literals], "token string")
    index = cut(pattern_index(spark, patterns, token_frequency(rows, wanted)))
    distinct = rows.select(F.col("url").alias("_w_id"), "url").where("url IS NOT NULL").distinct()
    found = cut(matched(distinct, index).withColumn("_w_hit", F.lit(True)))
    found = F.broadcast(found) if small_enough(found, BROADCAST) else found
    out = rows.join(found, rows["url"] == found["_w_id"], "left")
    name, verdict = host_rule(F.col("host"), F.col("path"), rules)
    judged = F.coalesce(verdict, F.when(F.col("_w_hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", name.alias("rule"), judged.alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """judge over all pages; nulls, ties and empty tables as there."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _sql() -> str:
    found = " OR ".join(f"regexp_matches(u, '{p}')" for p in PATTERNS)
    fits = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".replace("{}", h + p + "|" + v) for h, p, v in sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1])))
    return rf"""
WITH a AS (SELECT page_id, lower(url) AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {fits} END AS r FROM b)
SELECT page_id, host, path, split_part(r, '|', 1) AS rule, CASE WHEN r IS NOT NULL THEN split_part(r, '|', 2) WHEN {found} THEN 'block' ELSE 'allow' END AS verdict FROM c
"""


OP7_SQL = _sql()
