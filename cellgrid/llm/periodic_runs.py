"""Periodic runs: stretches of words that repeat themselves at least `times` times with some period.

All-lag scan: the words of a document become numbers, and the array is compared with itself shifted by every lag up to
n / times. A stretch of places that agree with the word `lag` places on is a run of that period, as long as the stretch and one
period. Lags are compared many at a time, as rows of a matrix; the rows without a stretch of the least length are set aside by a
few passes over the whole matrix, and only the others are cut into stretches.

The work grows with the square of a document's words. Documents above `long_bytes` are therefore dealt out as ranges of
lags of equal work, which Spark spreads over all machines; what the ranges find is put together by document.

A stretch that has period q has period 2q as well. If it is long enough for both, both find the same first and last word
(words q apart agree inside, so the stretch of 2q ends where that of q ends), hence the smallest period of each interval is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table, words, written


@dataclass(frozen=True)
class Repeats:
    """What counts as a run, and the sizes that divide the work (never what is found)."""

    least: int = 24
    times: int = 3
    #: Texts of more bytes are scanned by ranges of lags.
    long_bytes: int = 1 << 16
    #: Comparisons of words in one such range, about.
    work: int = 1 << 27
    #: Comparisons at a time.
    block: int = 1 << 20


Run = tuple[int, int, int]
RESULT = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def numbered(tokens: list) -> np.ndarray:
    """Numbers that are equal where the words are."""
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int32, len(tokens))
    return ids.astype(np.uint16) if len(seen) < 0xFFFF else ids.astype(np.uint32)


def scan(ids: np.ndarray, first: int, last: int, repeats: Repeats) -> list[Run]:
    """(start, length, period) of the stretches of every lag from `first` to `last` that are long enough, maximal, periods not yet compared."""
    n, found = len(ids), []
    last = min(last, n // repeats.times)
    if n < repeats.least or last < first:
        return found
    padded = np.concatenate([ids, np.full(last + 1, np.iinfo(ids.dtype).max, ids.dtype)])  # no word has this number
    shifted = np.lib.stride_tricks.sliding_window_view(padded, n)
    rows = max(1, repeats.block // n)
    for at in range(first, last + 1, rows):
        upto = min(at + rows, last + 1)
        same = shifted[at:upto] == ids
        need = max(1, min(max(repeats.least - q, (repeats.times - 1) * q) for q in (at, upto - 1, min(max(at, repeats.least // repeats.times), upto - 1))))
        for k in np.flatnonzero(_stretched(same, need).any(axis=1)).tolist():
            q = at + k
            edges = np.flatnonzero(np.diff(same[k], prepend=False, append=False))
            starts, ends = edges[0::2], edges[1::2]
            lengths = ends - starts + q
            ok = lengths >= max(repeats.least, repeats.times * q)
            found += zip(starts[ok].tolist(), lengths[ok].tolist(), [q] * int(ok.sum()), strict=True)
    return found


def _stretched(same: np.ndarray, need: int) -> np.ndarray:
    """Where `need` true values in a row begin, by doubling the stretch."""
    have = 1
    while have < need and same.shape[1] > 1:
        step = min(have, need - have)
        same = same[:, : max(0, same.shape[1] - step)] & same[:, step:]
        have += step
    return same


def distinct_runs(found: list[Run]) -> list[Run]:
    """Each interval once, with its smallest period; by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def digest(tokens: list, runs: list[Run]) -> tuple:
    """The columns of RESULT for a document's words (bytes) and its runs."""
    kept = np.ones(len(tokens), bool)
    best: Run | None = None
    for run in runs:
        start, length, period = run
        kept[start + period : start + length] = False
        if best is None or length * best[2] > best[1] * period:  # ties: runs come by start, then period
            best = run
    left = tokens if kept.all() else [t for t, k in zip(tokens, kept.tolist(), strict=True) if k]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    hashed = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()
    start, length, period = best or (None, None, None)
    return len(runs), start, length, period, 1000 * length // period if best else None, *hashed


def _batch(keys: list[tuple[str, pa.Array]], rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*[k for _, k in keys], *columns], [*[k for k, _ in keys], *names])


def _whole(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """Documents that are scanned at one place."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    tokens = text.encode().split()
                    ids = numbered(tokens)
                    rows.append(digest(tokens, distinct_runs(scan(ids, 1, len(ids), repeats))))
                yield _batch([("doc_id", part.column(0))], rows)

    return docs.mapInArrow(find, f"doc_id bigint, {RESULT}")


def _by_ranges(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """Documents that are scanned by ranges of lags: their words as numbers are sent to each range, what the ranges find to the document."""
    kept = written(docs.withColumn("key", F.monotonically_increasing_id()), "long-texts")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = numbered(text.as_py().encode().split()).astype(np.uint32)
                lags = max(1, repeats.work // max(1, len(ids)))
                for first in range(1, len(ids) // repeats.times + 1, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([first + lags - 1]), pa.array([ids.tobytes()])], ["key", "first", "last", "ids"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                key, first, last = (b.column(c)[k].as_py() for c in range(3))
                ids = np.frombuffer(b.column(3)[k].as_buffer(), np.uint32)
                found = scan(ids.astype(np.uint16) if len(ids) and ids.max() < 0xFFFF else ids, first, last, repeats)
                runs = pa.array([dict(zip(("start", "length", "period"), r, strict=True)) for r in found], pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), runs], ["key", "run"])

    dealt = kept.select("key", "text").mapInArrow(ranges, "key bigint, first bigint, last bigint, ids binary").repartition("key", "first")
    found = dealt.mapInArrow(find, "key bigint, run struct<start bigint, length bigint, period bigint>").groupBy("key").agg(F.collect_list("run").alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                runs = distinct_runs([(r["start"], r["length"], r["period"]) for r in b.column(2)[k].as_py() or []])
                yield _batch([("doc_id", b.column(0).slice(k, 1))], [digest(b.column(1)[k].as_py().encode().split(), runs)])

    return kept.join(found, "key", "left").select("doc_id", "text", "runs").mapInArrow(finish, f"doc_id bigint, {RESULT}")


def periodic_runs(docs: DataFrame, repeats: Repeats = Repeats()) -> DataFrame:
    """doc_id and, for every row of `docs` (doc_id, text), its periodic runs: n_runs, the run with the greatest length / period
    (start, length, period, exponent_milli; nulls without a run), and SHA-256 of all runs and of the text without their repeats.

    Words are separated by ASCII white space. A run is as long as `least` and `times` periods at least. Null and empty texts have
    no words and no runs; null and repeated doc_ids are kept, one row each; other columns are not looked at; an empty table
    gives no rows. A document's runs are fewer than its words, so they fit where the document does.
    """
    def found() -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        long = F.octet_length("text") > repeats.long_bytes
        return _whole(rows.where(~long), repeats).unionByName(_by_ranges(rows.where(long), repeats))

    return settled(found, "runs")


def looped(docs: DataFrame) -> DataFrame:
    """`docs` with the words of every tenth document (by crc32 of its doc_id) repeated from some place on; a null doc_id changes nothing.

    With h that crc32 and g = h / 10, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def turned(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, at(i.cast("bigint")))), " ")).otherwise("")

    once = F.element_at(F.transform(F.array(words(F.col("text").cast("string"))), turned), 1)
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull() & (h % 10 == 0), once).otherwise(F.col("text").cast("string")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, every tenth of them with planted repeats."""
    return periodic_runs(looped(table(spark, sf_dir, "documents")))
