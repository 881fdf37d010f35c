"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

All expressions are built in. The Bloom filter of the list (bloom.py) is broadcast and marks possible hits; only those
are shuffled to the exact hash join with the list, which removes false positives. A list too long for a filter of the
bound that bloom.py sets is joined as it is. Null URLs and those without `://` never reach the join.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule, is on no list and is
allowed; repeated rows are judged alike; an empty list blocks nothing; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import build
from .common import ascii_lower, free, quoted, settle

Rule = tuple[str, str]
#: Query parameters that name a visit and not a page.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme-less form that equal pages share; null without `://`.

    Host without a leading `www.` or `m.` and default port, path without a closing slash, parameters sorted and without those of
    TRACKING, no fragment.
    """
    host = F.regexp_replace(url_host(url), r"^(?:www|m)\.|:(?:80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls if none. A rule is host/path, its action allow or block."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, does in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, does).otherwise(action)
    return rule, action


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", listed_url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict, listed (boolean). Columns of these names in `pages` are replaced.

    `listed` holds URLs to block in column `listed_url`, in any form; `rules` overrule the list.
    """
    made = ("host", "path", "rule", "verdict", "listed")
    pages = pages.drop(*(c for c in pages.columns if c.lower() in made and c != url))
    canon, maybe, action, hit = free(pages, "canon", "maybe", "action", "hit")
    # read once, whatever it takes to tell what is listed: for the filter's size, its bits and the exact join
    names = settle(listed.select(canonical_url(quoted(listed_url)).alias(hit)).filter(F.col(hit).isNotNull()).distinct())
    bloom = build(names, hit)

    host, path = url_host(quoted(url)), url_path(quoted(url))
    seen = pages.withColumns({"host": host, "path": path, canon: canonical_url(quoted(url))})
    rule, does = rule_column(F.col("host"), F.col("path"), rules)
    seen = bloom.maybe(seen.withColumns({"rule": rule, action: does}), F.col(canon), maybe)

    clear = seen.filter(~F.col(maybe)).withColumn("listed", F.lit(False))
    exact = seen.filter(maybe).join(names, F.col(canon) == F.col(hit), "left").withColumn("listed", F.col(hit).isNotNull()).drop(hit)
    verdict = F.coalesce(F.col(action), F.when(F.col("listed"), "block").otherwise("allow"))
    return clear.unionByName(exact).withColumn("verdict", verdict).drop(canon, maybe, action)
