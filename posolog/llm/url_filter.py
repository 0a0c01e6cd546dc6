"""URL filters over a sorted array of 64-bit digests.

A list of strings `host/path-prefix` becomes one file: sorted xxhash keys, the strings' offsets, the strings. Workers
map it into memory, probe all host suffixes and path prefixes of a batch of urls by one vectorised binary search, and
compare the stored string before a hit counts.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import json
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posolog.llm.common import mapped, raw_texts, shipped

#: (action, host, path): a rule fits its host and all subdomains.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: What the list blocks where no rule fits.
BLOCKED = (("spam-farm.example.org", ""), ("spam-farm.example.net", ""), ("spam-farm.example.com", ""))


def _file(n: int, values: list[str], keys: Iterable[bytes], ends: Iterable[bytes], codes: Iterable[bytes], strings: Iterable[bytes]) -> Iterator[bytes]:
    """A list's file in chunks: a head, n sorted keys, where the n strings end, the places of their values, the strings."""
    head = json.dumps({"n": n, "values": values}).encode()
    yield len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8)
    yield from keys
    yield from ends
    yield from codes
    yield from strings


def built(entries: Iterable[tuple[str, str]]) -> bytes:
    """The file of a short list: entries (string, value); of equal strings the last one's value holds."""
    held = {k.encode(): v for k, v in entries}
    digests = {k: xxhash.xxh64_intdigest(k) for k in held}
    strings, values = sorted(held, key=digests.get), sorted(set(held.values()))
    keys = np.array([digests[k] for k in strings], np.uint64)
    codes = np.array([values.index(held[k]) for k in strings], np.uint64)
    return b"".join(_file(len(strings), values, [keys.tobytes()], [np.cumsum([len(k) for k in strings]).astype(np.uint64).tobytes()], [codes.tobytes()], strings))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (key, string, code) a row of four blobs for each batch."""
    for batch in batches:
        strings = raw_texts(batch.column(1))
        blobs = [(batch.column(0).to_numpy().view(np.uint64) + np.uint64(1 << 63)).tobytes(), np.array([len(x) for x in strings], np.uint64).tobytes(), batch.column(2).to_numpy().astype(np.uint64).tobytes(), b"".join(strings)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["keys", "sizes", "codes", "strings"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw_texts(batch.column(0))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array((keys - np.uint64(1 << 63)).view(np.int64)), *batch.columns], ["key", "string", "code"])


def built_of_table(entries: DataFrame) -> tuple[str, list[int]]:
    """Ships the list of a table (host, path, value) to all executors; returns its name and the lengths of its paths.

    Strings are digested and sorted by Spark and come to the driver part by part, which appends them to files: its memory
    holds one batch. The list as a whole must fit on each machine's disk. Null hosts and paths count as empty; of equal
    strings the greatest value holds.
    """
    spark = entries.sparkSession
    host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    cuts = sorted((r[0] for r in entries.select(F.length(path)).distinct().collect()), reverse=True)
    values = sorted(r[0] for r in entries.select("value").distinct().collect())
    coded = entries.select(F.concat(host, path).alias("string"), (F.array_position(F.array(*map(F.lit, values)), F.col("value")) - 1).alias("code")).groupBy("string").agg(F.max("code").alias("code"))
    ranked = coded.mapInArrow(_digested, "key bigint, string string, code bigint").orderBy("key", "string")
    n, end, told = 0, 0, hashlib.sha256(json.dumps(values).encode())
    with contextlib.ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile()) for _ in range(4)]
        for row in ranked.mapInArrow(_packed, "keys binary, sizes binary, codes binary, strings binary").toLocalIterator():
            ends = np.cumsum(np.frombuffer(row["sizes"], np.uint64), dtype=np.uint64) + np.uint64(end)
            n, end = n + len(ends), int(ends[-1]) if len(ends) else end
            for f, blob in zip(files, (bytes(row["keys"]), ends.tobytes(), bytes(row["codes"]), bytes(row["strings"])), strict=True):
                told.update(blob)
                f.write(blob)
        for f in files:
            f.seek(0)
        return shipped(spark, f"urls-{told.hexdigest()[:24]}.bin", _file(n, values, *(iter(functools.partial(f.read, 1 << 20), b"") for f in files))), cuts


class DigestList:
    """A list's file, mapped into memory."""

    def __init__(self, path: str):
        size = int.from_bytes(open(path, "rb").read(8), "little")  # noqa: SIM115
        whole = np.memmap(path, np.uint8, "r")
        head = json.loads(bytes(whole[8 : 8 + size]))
        n, at = head["n"], 8 + size + (-size % 8)
        self.values = head["values"]
        self.keys = whole[at : at + 8 * n].view(np.uint64)
        self.ends = whole[at + 8 * n : at + 16 * n].view(np.uint64)
        self.codes = whole[at + 16 * n : at + 24 * n].view(np.uint64)
        self.strings = whole[at + 24 * n :]

    def find(self, probes: list[bytes]) -> list[str | None]:
        """The values of the strings that are on the list, None for the others."""
        if not len(self.keys) or not probes:
            return [None] * len(probes)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        out: list[str | None] = [None] * len(probes)
        for i in np.flatnonzero(hit):
            k = at[i]
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if bytes(self.strings[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])]) == probes[i]:
                    out[i] = self.values[int(self.codes[k])]
                    break
                k += 1
        return out


_OPEN: dict[str, DigestList] = {}


def _opened(name: str) -> DigestList:
    if name not in _OPEN:
        _OPEN[name] = DigestList(SparkFiles.get(name))
    return _OPEN[name]


def parts_of(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].encode().lower().decode(), tail[:cut]


def suffixes(host: str) -> list[str]:
    """A host and the domains above it."""
    return [host, *(host[k + 1 :] for k, c in enumerate(host) if c == ".")] if host else []


def _listed(spark: SparkSession, entries, value: str | None = None) -> tuple[str, list[int]]:
    """A shipped list's name and the lengths of its paths, longest first, of a table or of (value, host, path) rows."""
    if isinstance(entries, DataFrame):
        return built_of_table(entries if value is None else entries.withColumn("value", F.lit(value)))
    rows = [(e if value is None else (value, *e)) for e in entries]
    data = built((h + p, v) for v, h, p in rows)
    return shipped(spark, f"urls-{hashlib.sha256(data).hexdigest()[:24]}.bin", [data]), sorted({len(p) for _, _, p in rows}, reverse=True)


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule (or null) and verdict to every row; columns of these names are replaced, all others stay.

    rules are rows (action, host, path), blocked rows (host, path); either may be a table, of (host, path, value) or of
    (host, path), which is how long lists come. The longest fitting rule (host and path together) decides; where none
    fits, a url is blocked if the list has its host, or a domain above it, with a prefix of its path. Urls that are null
    or have no `://` have an empty host and path, fit nothing and are allowed. A path is compared as it is written, a
    host by whole labels. Rows are judged by themselves, repeated ones alike; a url of any length is judged whole.
    """
    spark = pages.sparkSession
    (ruled, rule_cuts), (listed, list_cuts) = _listed(spark, rules), _listed(spark, blocked, "block")

    def probed(parts: list[tuple[str, str]], name: str, cuts: list[int]) -> list[tuple[str, str] | None]:
        """For each url its longest string on the list and that string's value."""
        owners, probes = [], []
        for i, (host, path) in enumerate(parts):
            for suffix in suffixes(host):
                for k in cuts:
                    if k <= len(path):
                        owners.append(i)
                        probes.append(suffix + path[:k])
        best: list[tuple[str, str] | None] = [None] * len(parts)
        for i, probe, value in zip(owners, probes, _opened(name).find([p.encode() for p in probes]), strict=True):
            if value is not None and (best[i] is None or len(probe) > len(best[i][0])):
                best[i] = probe, value
        return best

    def work(urls: pa.Array) -> list[pa.Array]:
        parts = [parts_of(u) for u in urls.to_pylist()]
        fits, found = probed(parts, ruled, rule_cuts), probed(parts, listed, list_cuts)
        verdicts = [r[1] if r else "block" if b else "allow" for r, b in zip(fits, found, strict=True)]
        return [pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], [r[0] if r else None for r in fits], verdicts)]

    return mapped(pages, url_col, [(c, "string") for c in ("host", "path", "rule", "verdict")], work)
