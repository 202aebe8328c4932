"""Language identification by rank order.

The n-grams of 1 to 5 letters inside words (a blank before and after each word belongs to it) are ranked by how often they
occur. A language's profile is the ranking of its most frequent n-grams over all its training texts. A text is ranked the same
way; its out-of-place distance to a profile is the sum, over the text's most frequent n-grams, of how far each stands from its
place in the profile, or the profile's length where it is not there. The language with the smallest distance is predicted.

N-grams are known by 64-bit hashes; among equally frequent ones the smaller hash comes first, in texts as in profiles.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, table

#: What texts without letters are, and all texts where nothing was learned.
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


@dataclass(frozen=True)
class Profiles:
    """The model's parameters. `languages` bounds what is collected and sent to the tasks: there are fewer languages; more is an error."""

    longest: int = 5
    ranks: int = 400
    languages: int = 8192
    #: Distinct words that a task gathers before it passes on the counts of their n-grams.
    flush: int = 250_000


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters."""
    found = _WORDS.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]  # fractions and the like aren't letters


def sorting(h: np.ndarray) -> np.ndarray:
    """An order in which equal hashes are neighbours: by the upper bits, with the place in the lower ones, which sorts faster than places by hashes do."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    key = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    order, key = (key & low).astype(np.int64), key & ~low
    mixed = (key[1:] == key[:-1]) & (h[order[1:]] != h[order[:-1]])
    return np.argsort(h) if mixed.any() else order  # two hashes share their upper bits


def counted(words: Counter[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of words that occur so often, by hash, and their counts. A lone blank is none."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    letters = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word, times = np.repeat(np.arange(len(words)), sizes), np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes)
    h, hashes, counts = np.zeros(len(letters), np.uint64), [], []
    for k in range(min(longest, len(letters))):
        n = len(letters) - k
        h = (h[:n] ^ letters[k:]) * _MIX
        h ^= h >> _SHIFT
        inside = word[:n] == word[k:] if k else letters != ord(" ")
        hashes.append(h[inside])
        counts.append(times[:n][inside])
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = sorting(h)
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(c[order], starts)


def ranked(text: str, profiles: Profiles) -> np.ndarray:
    """A text's most frequent n-grams, the first one first."""
    h, c = counted(Counter(words_of(text)), profiles.longest)
    top = profiles.ranks
    if len(h) > top:  # only those that are as frequent as the last one can stay
        least = -np.partition(-c, top - 1)[top - 1]
        h, c = h[c >= least], c[c >= least]
    return h[np.lexsort((h, -c))][:top]


@dataclass
class Model:
    """Every profile: the n-grams of all (sorted hashes), and for the k-th of them, from starts[k] to starts[k + 1], which languages have it and in which places."""

    langs: list[str]
    hashes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    def judge(self, ranked: np.ndarray, ranks: int) -> tuple[str, float]:
        """The nearest language, the first by name among equally near ones, and how near it is: 1 in the same order, 0 with nothing in common."""
        if not len(ranked) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.hashes, ranked), len(self.hashes) - 1)
        own = np.flatnonzero(self.hashes[at] == ranked)
        first, n = self.starts[at[own]], self.starts[at[own] + 1] - self.starts[at[own]]
        entry = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        nearer = ranks - np.abs(self.places[entry] - np.repeat(own, n))  # than if the profile lacked it
        distance = ranks * len(ranked) - np.bincount(self.owners[entry], nearer, len(self.langs))
        k = int(np.argmin(distance))
        return self.langs[k], float(1 - distance[k] / (ranks * len(ranked)))


def learn(docs: DataFrame, profiles: Profiles = Profiles()) -> Model:
    """Profiles of every language of `docs` (lang, text), from all its texts; rows without a lang are left out, null texts count as empty.

    Each task passes on its counts of n-grams; only the `ranks` first of each language come to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter[str]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, seen in words.items():
                h, c = counted(seen, profiles.longest)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c)], ["lang", "h", "c"])
            words.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > profiles.flush:
                    yield from out()
        yield from out()

    texts = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "lang string, h bigint, c bigint").groupBy("lang", "h").agg(F.sum("c").alias("c"))
    # Hashes are compared unsigned, as in texts; the first of each language are found before any shuffle.
    unsigned = F.expr("h ^ CAST(-9223372036854775808 AS BIGINT)")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), unsigned)) - 1
    first = counts.withColumn("place", place).where(F.col("place") < profiles.ranks).select("lang", "h", "place")
    rows = first.limit(profiles.languages * profiles.ranks + 1).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    if len(langs) > profiles.languages or rows.num_rows > profiles.languages * profiles.ranks:
        raise ValueError(f"more than {profiles.languages} languages")
    h = rows["h"].to_numpy().view(np.uint64)
    number = {x: k for k, x in enumerate(langs)}
    owners = np.fromiter((number[x] for x in rows["lang"].to_pylist()), np.int64, len(h))
    order = np.lexsort((owners, h))
    hashes, starts = np.unique(h[order], return_index=True)
    return Model(langs, hashes, np.append(starts, len(h)), owners[order], rows["place"].to_numpy()[order])


def predict(docs: DataFrame, model: Model, profiles: Profiles = Profiles()) -> DataFrame:
    """doc_id, held_out (whether crc32 of doc_id leaves 2 of 4), lang_pred and score (0 to 1) of every row of `docs` (doc_id, text).

    Whole texts are read. Texts that are null or have no letter are `und` with score 0; null and repeated doc_ids are kept,
    one row each (a null id counts as the empty string); an empty table gives no rows; other columns are not looked at.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [model.judge(ranked(t, profiles), profiles.ranks) for t in part.column(2).to_pylist()]
                langs, scores = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(judge, "doc_id bigint, held_out boolean, lang_pred string, score double")


def held_out() -> Column:
    return crc32_of_id("doc_id") % 4 == 2


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.where(~held_out())))
