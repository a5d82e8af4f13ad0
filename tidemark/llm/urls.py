"""URL filters: host and path rules first, then a list of canonical URLs.

The list is asked through a blocked Bloom filter of bounded size (module bloom), which is sent to every
executor. Possible hits then meet the list in an exact hash join, which removes the false ones. A null URL or one without "://" has an empty host and path and is on no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that do not change what a URL shows, and host labels of the same site.
NOISE, SAME_SITE = "^(utm_|ref=)", r"^(www|m)\."


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m. and default port, path without closing slashes, the other parameters in order."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), SAME_SITE, ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~p.rlike(NOISE)))
    query = F.array_join(kept, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (written host/path) that fits the host or a domain above it and starts the path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one is asked before
        at = rule.index("/")
        site, start = rule[:at], rule[at:]
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", most_blocks: int = bloom.MOST_BLOCKS) -> DataFrame:
    """Judge every URL: the rule's verdict where one fits, else block if its canonical form is listed.

    `rules`: ("host/path", "allow" or "block"). Output: the id, host, path, canonical, rule, listed
    (boolean) and verdict; repeated rows stay repeated.
    """
    asked = listed.select(canonical(F.col(listed_col)).alias("canonical")).filter(F.col("canonical") != "").distinct()
    url = F.col(url_col)
    seen = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    seen = seen.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    probe = bloom.ask(seen, "canonical", asked, "canonical", most_blocks)
    columns = [id_col, "host", "path", "canonical", "rule"]
    out = probe.filter(~F.col("maybe")).select(*columns, F.lit(False).alias("listed"))
    sure = probe.filter("maybe").select(*columns).join(asked.withColumn("on_list", F.lit(True)), "canonical", "left")
    out = out.unionByName(sure.select(*columns, F.coalesce("on_list", F.lit(False)).alias("listed")))
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for rule, means in rules:
        verdict = F.when(F.col("rule") == rule, means).otherwise(verdict)
    return out.withColumn("verdict", verdict)
