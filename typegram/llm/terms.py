"""Frequencies of terms and n-grams from sorted suffixes.

Every record gives its suffixes, cut to the longest n-gram. They are routed by their first term, sorted in reverse
lexicographic order, and one pass with a stack as deep as the longest n-gram yields the counts of all prefixes.
A suffix carries how often it occurs and, per prefix length, whether that prefix is new in its record; so the record
set of a prefix is counted by adding flags, and the stack holds numbers instead of unbounded sets.

Defined cases: NULL records or NULL terms count nothing (a NULL term ends an n-gram); NULL or negative weights count 0;
a term repeated in a record counts once as record; terms may hold any sign, the separator too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typegram.session import written

SEP = "\x1f"
#: First terms of more than a HOT_SHARE-th and more than HOT_FLOOR of all suffixes are spread over SALTS tasks by the task they
#: come from; so there are at most HOT_SHARE of them.
HOT_SHARE, HOT_FLOOR = 1000, 100_000
SALTS = 32
#: Terms of a suffix of import roots.
SUFFIX = 2


def _suffixes(max_n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple[str, ...], list[int]] = {}
            for terms, weights in zip(pdf["terms"], pdf["weights"], strict=True):
                if terms is None:
                    continue
                terms = list(terms)
                weights = [1] * len(terms) if weights is None else [0 if w is None or w != w or w < 0 else int(w) for w in weights]
                seen: set[tuple[str, ...]] = set()
                for i, first in enumerate(terms):
                    if first is None:
                        continue
                    key, flags, length = (), [0] * max_n, 0
                    for n, term in enumerate(terms[i:i + max_n]):
                        if term is None:
                            break
                        key = (*key, term)
                        length = n + 1
                        if key not in seen:
                            seen.add(key)
                            flags[n] = 1
                    row = out.setdefault(key, [0, *[0] * max_n])
                    row[0] += weights[i]
                    for n in range(length):
                        row[n + 1] += flags[n]
            yield pd.DataFrame({"suffix": list(out), "w": [r[0] for r in out.values()], "flags": [r[1:] for r in out.values()]})

    return run


def _stack(max_n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path: list[str] = []
        counts: list[list[int]] = []  # per open prefix: occurrences, records
        done: list[tuple] = []

        def close(to: int) -> None:
            while len(path) > to:
                w, r = counts.pop()
                done.append((list(path), w, r))
                path.pop()
                if counts:
                    counts[-1][0] += w

        for pdf in batches:
            for suffix, w, flags in zip(pdf["suffix"], pdf["w"], pdf["flags"], strict=True):
                terms = list(suffix)
                same = 0
                while same < min(len(path), len(terms)) and path[same] == terms[same]:
                    same += 1
                close(same)
                for term in terms[same:]:
                    path.append(term)
                    counts.append([0, 0])
                counts[-1][0] += int(w)
                for n in range(len(terms)):
                    counts[n][1] += int(flags[n])
            yield pd.DataFrame(done, columns=["terms", "occurrences", "records"])
            done.clear()
        close(0)
        yield pd.DataFrame(done, columns=["terms", "occurrences", "records"])

    return run


def frequencies(records: DataFrame, terms: str, weights: str | None = None, max_n: int = 1,
                hot_share: int = HOT_SHARE, hot_floor: int = HOT_FLOOR, salts: int = SALTS) -> DataFrame:
    """term (parts joined by U+001F), n, occurrences, records of all n-grams up to max_n. One row of records is one record."""
    source = records.select(F.col(terms).alias("terms"), (F.col(weights) if weights else F.lit(None)).cast("array<bigint>").alias("weights"))
    flags = ", ".join(f"sum(flags[{i}])" for i in range(max_n))
    suffixes = source.mapInPandas(_suffixes(max_n), "suffix array<string>, w bigint, flags array<bigint>")
    # equal suffixes of one task are one row already; the salt keeps the tasks' rows of a hot first term apart
    suffixes = written(suffixes.withColumn("first", F.col("suffix")[0]).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))))
    counts = suffixes.groupBy("first").agg(F.count("*").alias("c"))
    total = suffixes.count()
    hot = counts.filter(F.col("c") > max(total / hot_share, hot_floor)).select("first", F.lit(True).alias("is_hot"))
    routed = suffixes.join(F.broadcast(hot), "first", "left").withColumn("salt", F.when(F.col("is_hot"), F.col("salt")).otherwise(0))
    grouped = routed.groupBy("first", "salt", "suffix").agg(F.sum("w").alias("w"), F.expr(f"array({flags})").alias("flags"))
    # reverse lexicographic: a suffix comes before its own prefixes, whose counts are then complete when they close
    ordered = grouped.repartition("first", "salt").sortWithinPartitions("first", "salt", F.desc("suffix"))
    partial = ordered.select("suffix", "w", "flags").mapInPandas(_stack(max_n), "terms array<string>, occurrences bigint, records bigint")
    whole = partial.groupBy("terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return whole.select(F.array_join("terms", SEP).alias("term"), F.size("terms").alias("n"), "occurrences", "records")


def final_scans(scans: DataFrame) -> DataFrame:
    """The highest attempt of each scan_id, once; among equal attempts one with frequencies, then the latest."""
    order = F.struct(F.coalesce("attempt", F.lit(-1)).alias("a"), F.col("frequencies").isNotNull().alias("f"), F.col("finished_at").alias("t"))
    names = [c for c in ("archive", "dataset", "python_files", "parsed_files", "parse_failures", "decode_failures", "frequencies") if c in scans.columns]
    return scans.filter("scan_id IS NOT NULL").groupBy("scan_id").agg(F.max_by(F.struct(*names), order).alias("s")).select("scan_id", "s.*")


def root_frequencies(scans: DataFrame) -> DataFrame:
    """root, files, scans: files that import a root, summed over the final attempts, and scans that list it.

    A scan is the record of its roots in alphabetical order, so a suffix is a root with the next ones; of all prefixes that the
    stack counts, the roots themselves are the ones of one term.
    """
    entries = F.array_sort(F.map_entries("frequencies"))
    rows = final_scans(scans).filter("frequencies IS NOT NULL").select(
        F.transform(entries, lambda x: x["key"]).alias("terms"), F.transform(entries, lambda x: x["value"]).alias("weights"))
    return frequencies(rows, "terms", "weights", max_n=SUFFIX).filter("n = 1").select(F.col("term").alias("root"), F.col("occurrences").alias("files"), F.col("records").alias("scans"))


def marked_roots(scans: DataFrame, archives: DataFrame, rare_below: int = 3, common_part: int = 10) -> DataFrame:
    """root, files, scans, mark: rare under rare_below files, common from a common_part-th of all python files, else NULL."""
    latest = archives.groupBy("archive").agg(F.max_by("archive_python_files", F.struct("snapshot_at", "archive_python_files")).alias("n"))
    total = latest.agg(F.sum("n")).first()[0] or 0
    rows = root_frequencies(scans)
    mark = F.when(F.col("files") < rare_below, "rare").when(F.col("files") * common_part >= total, "common")
    return rows.select("root", "files", "scans", mark.alias("mark"))
