"""URL rules held as a sorted digest array.

Each entry (a host and a path prefix) is one 64-bit xxhash key of `host/path`. The keys are sorted
in one file that every executor memory-maps; a second file holds the entries' full strings. A
batch of urls makes one key for each (host suffix, path prefix length in use) pair, probes all of
them with one vectorised binary search, and confirms every hit against the stored string, so that
equal digests of different strings never decide a verdict.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

ALLOW, BLOCK = "allow", "block"
#: The production rules: (verdict, host, path).
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
UPPER = {c: c + 32 for c in range(65, 91)}
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without a `://`."""
    found = PARTS.search(url or "")
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


@dataclass(frozen=True)
class DigestArray:
    """Names the two files of a published array; open() maps them on whichever machine it runs."""

    keys: str
    strings: str
    lengths: tuple[int, ...]

    @staticmethod
    def publish(spark: SparkSession, rules) -> DigestArray:
        """Write the files and have Spark ship them to each executor's own work folder."""
        entries = sorted((xxhash.xxh64_intdigest((host + path).encode()), host, path, verdict) for verdict, host, path in rules)
        keys = np.array([e[0] for e in entries], np.uint64)
        lines = "".join(f"{host}\t{path}\t{verdict}\n" for _, host, path, verdict in entries).encode()
        stamp = hashlib.sha256(keys.tobytes() + lines).hexdigest()[:16]
        home = tempfile.mkdtemp(prefix="loomgraph-urls-")
        names = (f"urls-{stamp}.keys", f"urls-{stamp}.strings")
        for name, data in zip(names, (keys.tobytes(), lines), strict=True):
            with open(os.path.join(home, name), "wb") as f:
                f.write(data)
            if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
                spark.sparkContext.addFile(os.path.join(home, name))
        return DigestArray(*names, tuple(sorted({len(path) for _, _, path in rules})))

    def open(self) -> tuple[np.ndarray, list[list[str]]]:
        path = SparkFiles.get(self.keys)
        keys = np.memmap(path, np.uint64, "r") if os.path.getsize(path) else np.empty(0, np.uint64)
        with open(SparkFiles.get(self.strings), encoding="utf-8") as f:
            return keys, [line.rstrip("\n").split("\t") for line in f]


def probe(urls: list[tuple[str, str]], keys: np.ndarray, entries: list[list[str]], lengths: tuple[int, ...]) -> list[tuple[str, str] | None]:
    """For each (host, path): the longest fitting rule and its verdict, or None."""
    owner: list[int] = []
    wanted: list[tuple[str, str]] = []
    for i, (host, path) in enumerate(urls):
        at, cuts = 0, [n for n in lengths if n <= len(path)]
        while host and cuts and at >= 0:
            for n in cuts:
                owner.append(i)
                wanted.append((host[at:], path[:n]))
            at = host.find(".", at) + 1 or -1
    out: list[tuple[str, str] | None] = [None] * len(urls)
    if not wanted or not len(keys):
        return out
    digests = np.fromiter((xxhash.xxh64_intdigest((h + p).encode()) for h, p in wanted), np.uint64, len(wanted))
    low, high = np.searchsorted(keys, digests, "left"), np.searchsorted(keys, digests, "right")
    best: dict[int, tuple[int, int]] = {}
    for j in np.flatnonzero(high > low):
        host, path = wanted[j]
        for k in range(low[j], high[j]):
            if entries[k][:2] == [host, path] and (len(host), len(path)) > best.get(owner[j], (-1, -1)):
                best[owner[j]] = len(host), len(path)
                out[owner[j]] = host + path, entries[k][2]
    return out


def filter_urls(pages: DataFrame, rules=RULES, otherwise: str = ALLOW, url: str = "url") -> DataFrame:
    """Judge every row's url; keeps `page_id`, adds host, path, rule and verdict.

    A rule fits its host and all subdomains of it where the url's path starts with the rule's
    path; the rule with the longest host, then path, wins; a url that no rule fits, among them a
    null or empty url and one without a host, gets rule null and the verdict `otherwise`. Rules that repeat a
    (host, path) must agree. Rows are judged alone: repeated rows are judged alike, an empty table
    gives an empty result, and other columns of the input are not read.
    """
    seen: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if seen.setdefault((host, path), verdict) != verdict:
            raise ValueError(f"rules disagree on {host}{path}")
        if "\t" in host + path or "\n" in host + path:
            raise ValueError("a rule holds a tab or a line end")
    array = DigestArray.publish(pages.sparkSession, [(v, h, p) for (h, p), v in seen.items()])

    def run(batches):
        keys, entries = array.open()
        for b in batches:
            urls = [split_url(u) for u in b.column(1).to_pylist()]
            found = probe(urls, keys, entries, array.lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([h for h, _ in urls], pa.string()),
                    pa.array([p for _, p in urls], pa.string()),
                    pa.array([x and x[0] for x in found], pa.string()),
                    pa.array([x[1] if x else otherwise for x in found], pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    some = pages.select("page_id", url)
    return some.mapInArrow(run, f"page_id {some.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")
