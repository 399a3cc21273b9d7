"""URL filter: hand-kept host and path rules, then a list of canonical URLs.

The list, which may be large, is tested in two steps.  A blocked Bloom filter
of fixed size is broadcast and passes URLs that may be listed; these alone are
joined with the list itself, which removes the false passes.

Defined results: host and path of a null url, or one without ``://``, are
empty, it is not listed and its verdict is allow unless a rule fits; list
entries may repeat or be null (ignored); empty tables give empty results;
repeated rows stay; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .tables import lower_ascii, packed

#: Query parameters that say where a visitor came from (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")


def _after_scheme(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without standard port, path (at least ``/``), and the sorted query without tracking parameters."""
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    short = F.regexp_replace(host(url), r":(80|443)$", "")
    full = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    sorted_query = F.array_join(F.array_sort(kept), "&")
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(short, full, F.when(sorted_query == "", F.lit("")).otherwise(F.concat(F.lit("?"), sorted_query))),
    )


def fitting_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest (host, path) rule that fits the host or a parent domain and begins the path; else null."""
    chosen = None
    for domain, start in sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_col == domain) | host_col.endswith("." + domain)) & path_col.startswith(start)
        chosen = F.when(fits, domain + start) if chosen is None else chosen.when(fits, domain + start)
    return F.lit(None).cast("string") if chosen is None else chosen


def judge(
    pages: DataFrame,
    listed: DataFrame,
    allow: Sequence[tuple[str, str]] = (),
    block: Sequence[tuple[str, str]] = (),
    url_col: str = "url",
    listed_col: str = "url",
    blocks: int = bloom.BLOCKS,
) -> DataFrame:
    """Each page as ``row`` with host, path, rule, listed and verdict; listed URLs without a rule are blocked."""
    url = F.col(url_col).cast("string")
    entries = listed.select(canonical(F.col(listed_col).cast("string")).alias("entry")).where("entry is not null")
    rows = packed(pages, host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rows = bloom.mark(rows, F.col("canonical"), bloom.build(entries, F.col("entry"), blocks), "possible", blocks)
    rows = rows.withColumn("possible", F.col("possible") & F.col("canonical").isNotNull())
    hits = rows.where("possible").join(
        entries.distinct(), F.col("canonical") == F.col("entry"), "left"
    ).select(*rows.columns, F.col("entry").isNotNull().alias("listed"))
    all_rows = rows.where("not possible").withColumn("listed", F.lit(False)).unionByName(hits)
    ruled = all_rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), [*allow, *block]))
    blocked = [h + p for h, p in block]
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("listed"), "block").otherwise("allow"))
    verdict = verdict.when(F.col("rule").isin(*blocked), "block").otherwise("allow") if blocked else verdict.otherwise("allow")
    return ruled.select("row", "host", "path", "rule", "listed", verdict.alias("verdict"))
