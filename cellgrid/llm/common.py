"""Helpers shared by the operators of this subpackage: table access, the shared work folder, text as numbers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, dropped, work_dir  # noqa: F401  (the operators take all of these from here)

#: Words of every operator are maximal runs of characters outside this ASCII white space; bytes.split() splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; always through Spark's reader, since the path may be in a store that only Spark opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that `settled` removes when it ends, innermost last.
_passing: list[list[DataFrame]] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, and survives the loss of any executor."""
    out = cut(df, name, **options)
    if _passing:
        _passing[-1].append(out)
    return out


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `build` gives, written; the tables that it wrote on its way are removed."""
    _passing.append([])
    try:
        out = cut(build(), name)
    finally:
        dropped(*_passing.pop())
    if _passing:
        _passing[-1].append(out)
    return out


def in_few_parts(df: DataFrame) -> DataFrame:
    """`df` in fewer, larger parts, without a shuffle: a task takes several parts one after the other, so none is held with another.

    For each file that an executor writes to a local disk Hadoop starts three processes (chmod). Until such a process runs
    its own program it shares the executor's memory and counts as large, so hundreds of tiny files cost more than their rows.
    There are four parts for each core at least, and one for every eight of a shuffle's, so they grow in number with the shuffles.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def whole(df: DataFrame, row: str = "row") -> Column:
    """All columns of `df` as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row)


def listed(spark: SparkSession, rows: Iterable[tuple], schema: str, name: str) -> DataFrame:
    """A table of the driver's own numbers, few by their nature: written as one text file to the shared folder and read by Spark, so that no Python runs on executors."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}.csv"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        for part in slices(rows, 4096):
            out.write(bytearray("".join(",".join(map(str, r)) + "\n" for r in part), "ascii"))
    finally:
        out.close()
    return spark.read.schema(schema).csv(path)


def crc32_of_id(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, by which the folds are dealt; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows, those with the smallest hashes of `key`; all of them if there aren't more. No task sends rows that don't count."""
    n, whole = df.count(), 1 << 30
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(whole)) < int(whole * rows / n))


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def slices(values: Iterable, size: int) -> Iterator[list]:
    """Lists of at most `size` of the values."""
    part: list = []
    for v in values:
        part.append(v)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine; the files are never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def window_hashes(t: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every window of `size` consecutive numbers (words, by their hashes)."""
    n = len(t) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = (h ^ t[k : k + n]) * mix
        h ^= h >> shift
    return h


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of the column's values modulo `bits`, built in 4 KB parts by Spark; at most bits / 8 bytes come to the driver, whatever the rows."""
    place = F.pmod(column, F.lit(bits)) + 1  # Spark numbers the bits from 1
    parts = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for r in parts:
        out[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out[: bits // 8]


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in a bitmap."""
    p = values.view(np.int64) % (8 * len(bitmap))
    return ((bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
