"""URL rules by a sort-merge range join over reversed-host keys.

A host becomes its labels in reverse, each closed by a dot (``blog.example.org`` ->
``org.example.blog.``). A rule for a host then covers one interval of the sorted keys, the
interval of a subdomain lies inside that of its parent, and a single sweep in key order keeps
the open intervals on a stack. Rules of a host sit on their interval by path; of all that fit, the
longest (host and path) wins.

The key space is cut into ranges (hot hosts too: the page path and id break ties), and each rule is given to
every range that its interval meets, so the ranges are swept on their own, in parallel; a range
holds pages in proportion, never all of a host.

Defined cases: null url, or one without ``://``: empty host and path, no rule fits. Repeated
rows are judged each on its own; a very long url is a key as any other; an empty table gives no
rows. Extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cuts_up_to, own_partitions

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LARGEST = "\U0010ffff"


def host_path(url: Column) -> tuple[Column, Column]:
    """Columns (host, path) of an url column."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(has, F.translate(host, upper, lower)).otherwise(""), F.when(has, path).otherwise("")


def reversed_key(host: str) -> str:
    return "".join(x + "." for x in reversed(host.split("."))) if host else ""


def reversed_key_column(host):
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _ranges(rules: Iterable[tuple[str, str, str]], bounds: list[str]) -> list[tuple[int, str, str, str, str]]:
    """Each rule once for every key range that its interval meets."""
    from bisect import bisect_right

    out = []
    for verdict, host, path in rules:
        key = reversed_key(host)
        for k in range(bisect_right(bounds, key), bisect_right(bounds, key + LARGEST) + 1):
            out.append((k, key, host, path, verdict))
    return out


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (range, key, rules first): rules open intervals, pages ask the stack."""
    at, stack = None, []  # stack: (key, {path: (rule, verdict)}), each key a prefix of the next
    for rows in batches:
        rules, verdicts, keep = [], [], []
        for k, key, page, host, path, verdict in zip(rows["range"], rows["key"], rows["is_page"], rows["host"], rows["path"], rows["verdict"], strict=True):
            if k != at:
                at, stack = k, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            keep.append(bool(page))
            if not page:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                stack[-1][1][path] = (host + path, verdict)
                continue
            fits = [x for _, paths in stack for p, x in paths.items() if path.startswith(p)]
            found = max(fits, key=lambda x: len(x[0]), default=None)
            rules.append(found and found[0])
            verdicts.append(found and found[1])
        out = rows.loc[keep, ["page_id", "host", "path"]].copy()
        out["rule"] = pd.Series(rules, index=out.index, dtype=object)
        out["verdict"] = pd.Series(verdicts, index=out.index, dtype=object)
        yield out


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", n_ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    n = n_ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("host_key", reversed_key_column(F.col("host")))
    # the place of a page in the key order: host interval first, then its own path and id
    p = p.withColumn("key", F.col("host_key")).withColumn("spread", F.concat_ws("\u0001", "host_key", "path", F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    # cut points from a bounded sample only balance the ranges; any cut gives the same result
    seen = p.select("spread", F.xxhash64("spread").alias("h")).orderBy("h").limit(40 * n).select("spread").collect()
    cuts = sorted({r["spread"] for r in seen}, key=lambda s: s.encode())
    cuts = sorted(set(cuts[:: max(1, len(cuts) // n)]), key=lambda s: s.encode())
    where = cuts_up_to(cuts, F.col("spread"))
    p = p.withColumn("range", where.cast("int")).select("range", "key", F.lit(1).alias("is_page"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    table = _ranges(rules, cuts)
    id_type = pages.schema["page_id"].dataType.simpleString()
    r = spark.createDataFrame(table or [(0, "", "", "", "")], "range int, key string, host string, path string, verdict string")
    if not table:
        r = r.limit(0)
    r = r.select("range", "key", F.lit(0).alias("is_page"), F.lit(None).cast(id_type).alias("page_id"), "host", "path", "verdict")
    both = own_partitions(p.unionByName(r), max(n, len(cuts) + 1), F.col("range"), "range").sortWithinPartitions("range", "key", "is_page", F.length("path"))
    out = both.mapInPandas(sweep, f"page_id {id_type}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
