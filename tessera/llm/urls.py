"""Allow and block rules on URLs, by a sort-merge range join.

A host is turned round label by label and closed with a dot (``www.example.org`` gives
``org.example.www.``), so a rule's host and all its subdomains are one interval of keys.
Rules and URLs are dealt out by ranges of that key and sorted; one sweep over each range
keeps a stack of the hosts whose interval is open, each with its path rules.  A rule is
copied to every range its interval reaches: at a range's edge these are only the rules of
that key's own ancestors.  Ranges are cut by (key, path, row), so neither a hot host nor a
hot URL fills one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, tasks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_ALL = "\U0010ffff"
SAMPLE_PER_RANGE = 20
MOST_RANGES = 50_000


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot; an empty host has an empty key."""
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(turned)


class Sweep:
    """The open hosts along the sorted keys, outermost first."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}, []))
        _, _, paths, sizes = self.stack[-1]
        # The same rule given twice: block wins.
        paths[path] = min(verdict, paths.get(path, verdict), key=lambda v: v != "block")
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def find(self, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule; of equally long ones that with the longer host."""
        best = None
        for _, host, paths, sizes in self.stack:
            for n in sizes:
                if n <= len(path) and path[:n] in paths:
                    found = (len(host) + n, len(host), host + path[:n], paths[path[:n]])
                    best = max(best, found) if best else found
                    break
        return (best[2], best[3]) if best else (None, None)


def url_verdicts(
    urls: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow"
) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, the ``rule`` that decides and the ``verdict``.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest host and path wins, and
    of equal rules block.  Where none fits, ``rule`` is NULL and the verdict is ``default``.
    A NULL url, or one without ``://``, has an empty host and path.  Repeated rows stay; an
    empty table gives an empty result; rules with a NULL or an empty host fit nothing.
    """
    spark, keep = urls.sparkSession, list(keep)
    names = [f"k{i}" for i in range(len(keep))]
    link = F.col(f"`{url}`").cast("string")
    left = urls.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)],
        url_host(link).alias("host"),
        url_path(link).alias("path"),
    ).withColumn("salt", F.xxhash64("path", *names))
    left = left.select(host_key(F.col("host")).alias("key"), "host", "path", "salt", F.lit(1).alias("kind"),
                       F.lit(None).cast("string").alias("verdict"), *names)
    lower = F.translate(F.col("host"), UPPER, LOWER)
    right = (
        rules.filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(lower.alias("host"), "path", "verdict")
        .select(host_key(F.col("host")).alias("key"), "host", "path", F.lit(0).cast("long").alias("salt"),
                F.lit(0).alias("kind"), "verdict", *[F.lit(None).cast(left.schema[n].dataType).alias(n) for n in names])
    )
    # Edges from a sample with a fixed number of rows per range, as Spark's own ranges are.
    ranges = min(tasks(spark), MOST_RANGES)
    rows = max(left.count(), 1)
    taken = left.select("key", "path", "salt").sample(min(1.0, SAMPLE_PER_RANGE * ranges / rows), seed=7)
    points = sorted(tuple(r) for r in taken.limit(2 * SAMPLE_PER_RANGE * ranges).collect())
    edges = sorted({points[len(points) * i // ranges] for i in range(1, ranges)}) if points else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, salts, kinds = (batch.column(c).to_pylist() for c in ("key", "path", "salt", "kind"))
            take, part = [], []
            for i, (key, path, salt, kind) in enumerate(zip(keys, paths, salts, kinds, strict=True)):
                if kind:
                    take.append(i)
                    part.append(bisect_right(edges, (key, path, salt)))
                else:
                    low, high = bisect_left(edges, (key,)), bisect_left(edges, (key + AFTER_ALL,))
                    take.extend([i] * (high - low + 1))
                    part.extend(range(low, high + 1))
            out = batch.take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *out.columns], ["part", *out.schema.names])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_hosts = None, Sweep()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "kind", "key", "host", "path", "verdict"))
            take, rule, verdict = [], [], []
            for i, (p, kind, key, host, path, says) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part, open_hosts = p, Sweep()
                open_hosts.close(key)
                if kind:
                    name, judged = open_hosts.find(path)
                    take.append(i)
                    rule.append(name)
                    verdict.append(judged or default)
                else:
                    open_hosts.add(key, host, path, says)
            got = batch.select([*names, "host", "path"]).take(pa.array(take, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*got.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [*names, "host", "path", "rule", "verdict"],
            )

    both = left.unionByName(right)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
    dealt = map_arrow(both, deal, f"part int, {fields}")
    ids = ", ".join(f"{n} {left.schema[n].dataType.simpleString()}" for n in names)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "key", "kind")
    swept = map_arrow(ordered, sweep, f"{ids}, host string, path string, rule string, verdict string")
    return swept.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "host", "path", "rule", "verdict")
