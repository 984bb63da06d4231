"""URL filters: a sorted sweep over reversed-host keys with a stack of active nested rules.

A rule (host, path) becomes the key ``reversed host / path``; every url gets such a key for
its host and for each parent domain no deeper than the deepest rule.  A rule then fits exactly
the keys it is a prefix of, an interval of the sorted key space, and intervals nest.  Keys and
rules are cut into ranges at sampled split points (a rule goes to each range it reaches into),
sorted inside the range, and swept once.  Nothing is broadcast but the split points, of which
there are as many as shuffle partitions; equal keys are split by a hash of the page id.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_batches, spread

SAMPLE_KEYS = 10_000  # about so many keys choose the split points; they steer balance, never results
_LOWEST = -(1 << 63)


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _split_points(keys: DataFrame, parts: int) -> list[tuple[bytes, int]]:
    share = F.pmod(F.xxhash64("key", "tie"), F.lit(1 << 30)) / (1 << 30)
    sample = keys.select("key", "tie").where(share * keys.count() < SAMPLE_KEYS).distinct().collect()
    ranked = sorted((row.key.encode(), row.tie) for row in sample)
    return sorted({ranked[len(ranked) * i // parts] for i in range(1, parts)}) if ranked else []


def _place(rows: DataFrame, splits: list[tuple[bytes, int]], is_rule: bool) -> DataFrame:
    """Add ``part``, the range of a key; a rule is repeated for each range it reaches into."""
    def of_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [k.encode() for k in batch["key"].to_pylist()]
        if is_rule:
            reach = [range(bisect_left(splits, (k, _LOWEST)), bisect_right(splits, (k + b"\xff", 0)) + 1)
                     for k in keys]
            take = [i for i, parts in enumerate(reach) for _ in parts]
            part = [p for parts in reach for p in parts]
            batch = batch.take(pa.array(take, pa.int64()))
        else:
            part = [bisect_right(splits, x) for x in zip(keys, batch["tie"].to_pylist())]
        return batch.append_column("part", pa.array(part, pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int"
    return map_batches(rows, of_rows, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, rules before pages of equal key; the stack holds the nested rules."""
    stack: list[tuple[str, str, str]] = []
    for batch in batches:
        found: list[tuple[str | None, str | None]] = []
        pages: list[int] = []
        columns = (batch[c].to_pylist() for c in ("key", "rule", "verdict"))
        for i, (key, rule, verdict) in enumerate(zip(*columns)):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule, verdict))
            else:
                pages.append(i)
                found.append(stack[-1][1:] if stack else (None, None))
        kept = batch.take(pa.array(pages, pa.int64())).select(["id", "host", "path", "n_keys"])
        yield (kept.append_column("rule", pa.array([f[0] for f in found], pa.string()))
               .append_column("verdict", pa.array([f[1] for f in found], pa.string())))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every page.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains where the
    url's path starts with the rule's; of the fitting rules the longest host and path together
    wins, then the longer host.

    Null or broken urls have empty host and path and fall to ``default`` unless a rule has an
    empty host.  Rules with a null are ignored, of equal rules with different verdicts the
    larger word wins (``block`` over ``allow``).  Repeated pages come out as often as they came
    in, a null id is kept, an empty table gives an empty result; further columns are not
    carried, whatever their names.
    """
    parts = spread(pages)
    rules = (rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
                          F.col("path"), F.col("verdict")).dropna()
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"),
                        url_path(F.col(url_col)).alias("path"))
    levels = F.least(F.size(_labels(F.col("host"))), F.lit(depth))
    keys = (urls.select("id", "host", "path", levels.alias("n_keys"), _labels(F.col("host")).alias("labels"),
                        F.xxhash64("id").alias("tie"), F.explode(F.sequence(F.lit(1), levels)).alias("level"))
            .select("id", "host", "path", "n_keys", "tie",
                    _key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key")))
    rule_keys = rules.select(
        F.lit(None).cast(keys.schema["id"].dataType).alias("id"), "host", "path", F.lit(0).alias("n_keys"),
        F.lit(_LOWEST).alias("tie"), _key(_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict")
    nothing = F.lit(None).cast("string")
    splits = _split_points(keys, parts)
    placed = (_place(keys.withColumns({"rule": nothing, "verdict": nothing}), splits, False)
              .unionByName(_place(rule_keys, splits, True)))
    swept = (placed.repartitionById(len(splits) + 1, F.col("part"))
             .sortWithinPartitions("part", "key", F.col("rule").isNull())
             .mapInArrow(_sweep, f"id {keys.schema['id'].dataType.simpleString()}, host string, path string, "
                                 "n_keys int, rule string, verdict string"))
    found = F.col("rule").isNotNull()
    rule_host = F.length(F.regexp_extract("rule", r"^([^/]*)", 1))
    best = F.max(F.when(found, F.struct(F.length("rule").alias("length"), rule_host.alias("host_length"),
                                        F.col("rule"), F.col("verdict"))))
    return (swept.groupBy("id", "host", "path").agg(best.alias("best"), F.count("*").alias("rows"),
                                                    F.first("n_keys").alias("n_keys"))
            .select("id", "host", "path", "best",
                    F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("n_keys")).cast("int"))).alias("_copy"))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
