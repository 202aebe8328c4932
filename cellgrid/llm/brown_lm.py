"""Scoring by a class-based bigram model (Brown et al.).

Every word belongs to one class; P(word | previous word) = P(class | previous class) * P(word | class), both smoothed by
counts. Classes come from exchange clustering in two steps:

* Sweeps over the most frequent words, each a type of its own, and over shared types of all others by their shape (length
  and last letters): in each sweep every type may move to the class that explains its neighbours best, by the counts of
  neighbouring classes in the whole training corpus. Sweeps go on until they add little.
* One exchange of every other word against the classes so found: its neighbouring classes are a table keyed by the word, and
  Spark tasks move each word to its best class. So the words that are clustered, like their counts, grow with the corpus.

Counts and classes of words are exact for the whole vocabulary: they stay a distributed table, joined to the words of each
document. Transitions are counted once more with the final classes of all words. Texts are read twice, once to count words
and once to turn them into numbers; everything else works on those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, dropped, table, written


@dataclass(frozen=True)
class Brown:
    """The model's parameters. `types`, `shapes` and `known` bound what is broadcast and collected, never what is counted or clustered."""

    classes: int = 32
    #: Words that take part in the sweeps one by one, and shared types of the others; together below 65,536.
    types: int = 1 << 13
    shapes: int = 1 << 9
    #: Words whose counts and classes travel to the tasks; those of the others are joined.
    known: int = 1 << 17
    #: Sweeps go on until one adds less than this to the information, in nats a token, that a class gives about the next one.
    least_gain: float = 0.001
    #: How many occurrences of a word its shape's neighbours count for when the word gets its class.
    prior: float = 0.1
    alpha: float = 0.1

    @property
    def size(self) -> int:
        """How many types there are: shapes first, then the end, then words."""
        return self.shapes + 1 + self.types

    @property
    def end(self) -> int:
        return self.shapes

    def shape(self, w: bytes) -> int:
        """The shared type of words that are not types of their own."""
        return xxhash.xxh32_intdigest(bytes([min(len(w), 24)]) + w[-2:]) % self.shapes


#: Hash under which the end of a text is counted.
END = 0
MEMO_ENTRIES = 500_000
FLUSH = 400_000
#: Occurrences that a task gathers before it passes on their neighbours.
GATHERED = 1 << 20


def word_hash(w: bytes) -> int:
    """A signed 64-bit hash, never the one of the end."""
    return (xxhash.xxh64_intdigest(w) - (1 << 63)) or 1


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (crc32_of_id("doc_id") % 7 == 2).alias("held_out"), F.col("text").cast("string").alias("text"))


def count_words(train: DataFrame) -> DataFrame:
    """h and count c of every distinct word of the training texts and of their ends."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*map(word_hash, seen), END], pa.int64()), pa.array([*seen.values(), ends], pa.int64())], ["h", "c"])

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(split(t))
                ends += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
                    ends = 0
        if ends:
            yield out()

    return train.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words by hash (sorted) with count and type (-1: no type of its own); words as frequent as `least` are in it."""

    hashes: np.ndarray
    counts: np.ndarray
    types: np.ndarray
    least: int


def frequent_words(counts: DataFrame, brown: Brown) -> Vocabulary:
    """The vocabulary of the tasks: how many words have each count gives the least count at which at most `known` words are left; only those come to the driver."""
    words = counts.where(F.col("h") != END)
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = words.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", upto).where(F.col("upto") <= brown.known).agg(F.min("c")).first()[0]
    least = least if least is not None else 1 << 62
    rows = words.where(F.col("c") >= least).select("h", "c").collect()
    rows.sort(key=lambda r: (-r.c, r.h))
    types = np.full(len(rows), -1, np.int32)
    types[: brown.types] = brown.end + 1 + np.arange(min(brown.types, len(rows)))
    h, c = np.array([r.h for r in rows], np.int64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], types[order], least)


class Reader:
    """Words to (place among the frequent words or -1, type, hash), remembered."""

    def __init__(self, vocabulary: Vocabulary, brown: Brown):
        self.v, self.brown = vocabulary, brown
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.place, self.type, self.hash = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def read(self, texts: list[list[bytes]]) -> np.ndarray:
        """For all words of the texts, one after another, their numbers in `place`, `type` and `hash`."""
        if len(self.memo) > MEMO_ENTRIES:
            self.clear()
        new = list(set().union(*texts).difference(self.memo))
        if new:
            self.memo.update(zip(new, range(len(self.hash), len(self.hash) + len(new)), strict=True))
            h = np.array([word_hash(w) for w in new], np.int64)
            at = np.minimum(np.searchsorted(self.v.hashes, h), max(0, len(self.v.hashes) - 1))
            found = self.v.hashes[at] == h if len(self.v.hashes) else np.zeros(len(h), bool)
            types = np.array([self.brown.shape(w) for w in new], np.int32)
            if len(self.v.hashes):
                own = found & (self.v.types[at] >= 0)
                types[own] = self.v.types[at][own]
            self.place, self.type, self.hash = np.append(self.place, np.where(found, at, -1)), np.append(self.type, types), np.append(self.hash, h)
        return np.fromiter(map(self.memo.__getitem__, (w for t in texts for w in t)), np.int64, sum(map(len, texts)))


ROWS = "row_no bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_near bigint, near double, types binary, others binary, hashes array<bigint>, times array<int>"


def read_documents(docs: DataFrame, vocabulary: Vocabulary, brown: Brown, ends: int) -> DataFrame:
    """Per row what the frequent words' counts give, its words as numbers, and the rarer words (hash, times) that must be joined.

    `types` has each word's type and the end (2 bytes each). `others` says which word stands where a type is shared (4 bytes
    each): its place in the vocabulary, or the vocabulary's size plus its place in `hashes`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, row_no = Reader(shared.value, brown), TaskContext.get().partitionId() << 40
        logs, known = np.log10(shared.value.counts + 1.0), len(shared.value.hashes)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cut = [split(t) for t in part.column(2).to_pylist()]
                lengths = [len(t) for t in cut]
                ids = reader.read(cut)
                types, place, hashed = reader.type[ids].astype("<u2"), reader.place[ids], reader.hash[ids]
                near = np.where(place >= 0, logs[place] if len(logs) else 0.0, 0.0)
                of, upto = np.repeat(np.arange(len(cut)), lengths), np.cumsum([0, *lengths])
                far = np.flatnonzero(place < 0)
                rows, order = of[far], np.lexsort((hashed[far], of[far]))  # the rarer words of each row, each word once
                r, h = rows[order], hashed[far][order]
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(far) else np.empty(0, bool)
                starts = np.flatnonzero(new)
                firsts = np.searchsorted(r[starts], np.arange(len(cut) + 1))
                codes = place.copy()
                codes[far[order]] = known + np.cumsum(new) - 1 - firsts[r]
                common = np.flatnonzero(types < brown.shapes)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row_no + np.arange(len(cut))), part.column(0), part.column(1), pa.array(np.array(lengths) + 1, pa.int64()),
                        pa.array(np.bincount(of, place >= 0, len(cut)).astype(np.int64) + int(ends > 0)), pa.array(np.bincount(of, near, len(cut)) + math.log10(ends + 1)),
                        rows_of(np.insert(types, upto[1:], brown.end), upto + np.arange(len(upto))), rows_of(codes[common].astype("<u4"), np.searchsorted(common, upto)),
                        lists(h[starts]), lists(np.diff(np.append(starts, len(h))).astype(np.int32)),
                    ],
                    ["row_no", "doc_id", "held_out", "n_tokens", "n_near", "near", "types", "others", "hashes", "times"],
                )
                row_no += len(cut)

    return _texts(docs).mapInArrow(read, ROWS)


def rows_of(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column from all rows' numbers one after another; `edges` are the places where rows begin, and the end."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of each row, all numbers one after another) of a binary column, without copies."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data, width = column.buffers()[2], np.dtype(kind).itemsize
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return np.diff(at) // width, whole.view(kind)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def neighbour_counts(read: DataFrame, brown: Brown, classes: np.ndarray) -> np.ndarray:
    """By type, how often each class precedes (first half) and follows (second half) it in all training texts of `read`."""
    spark, k, size = read.sparkSession, brown.classes, brown.size
    shared = spark.sparkContext.broadcast(classes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size * 2 * k, np.int64)
        scaled = shared.value.astype(np.int64)
        for b in _slices(batches):
            types = np.concatenate([[brown.end], joined(b.column(0), "<u2")[1]]).astype(np.int64)
            c, row = scaled[types], types * (2 * k)
            sums += np.bincount(row[1:] + c[:-1], minlength=len(sums))
            sums += np.bincount(row[:-1] + k + c[1:], minlength=len(sums))
        table = sums.reshape(size, 2 * k)
        most = table.max(1)
        for kind, low, high in (("<u2", 1, 1 << 16), ("<i4", 1 << 16, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
            used = np.flatnonzero((most >= low) & (most < high))
            for at in range(0, len(used), 2048):
                rows = used[at : at + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([x.tobytes() for x in table[rows].astype(kind)], pa.binary())], ["type", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.frombuffer(x, {4 * k: "<u2", 8 * k: "<i4", 16 * k: "<i8"}[len(x)]).astype(np.int64)
                sums[t] = sums[t] + row if t in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["type", "counts"])

    partial = read.where("not held_out").select("types").mapInArrow(count, "type int, counts binary")
    rows = partial.repartition(parts, "type").mapInArrow(add, "type int, counts binary").collect()  # one row per type: a fixed size
    out = np.zeros((size, 2 * k), np.int64)
    for r in rows:
        out[r.type] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def first_classes(brown: Brown) -> np.ndarray:
    """Types dealt to classes in turn, so that frequent ones are apart; the last class is the end's alone."""
    c = np.arange(brown.size) % (brown.classes - 1)
    c[brown.end] = brown.classes - 1
    return c.astype(np.int32)


def class_pairs(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often class d follows class c."""
    k = counts.shape[1] // 2
    out = np.zeros((k, k), np.int64)
    np.add.at(out, classes, counts[:, k:])
    return out


def weights(counts: np.ndarray, classes: np.ndarray, brown: Brown) -> np.ndarray:
    """What a neighbour of each class, before (first half) or after a word, says for each class of the word; nothing is ever said for the end's."""
    pairs = class_pairs(counts, classes).astype(float) + brown.alpha
    info = np.log(pairs * pairs.sum() / np.outer(pairs.sum(1), pairs.sum(0)))
    return np.vstack([info, info.T])


def exchange(counts: np.ndarray, classes: np.ndarray, turn: int, brown: Brown) -> np.ndarray:
    """Moves types to the class under which their neighbours are likeliest; in each round half of them may move."""
    gain = counts @ weights(counts, classes, brown)  # column k: the type in class k
    best = gain[:, :-1].argmax(1).astype(np.int32)
    may = (np.arange(len(classes)) % 2 == turn % 2) & counts.any(1)
    may[brown.end] = False
    return np.where(may, best, classes).astype(np.int32)


def information(counts: np.ndarray, classes: np.ndarray) -> float:
    """What a class tells about the next one, in nats a token: the class model's likelihood rises and falls with it."""
    pairs = class_pairs(counts, classes).astype(float)
    n = pairs.sum()
    if not n:
        return 0.0
    expected = np.outer(pairs.sum(1), pairs.sum(0)) / n
    used = pairs > 0
    return float((pairs[used] * np.log(pairs[used] / expected[used])).sum() / n)


def learned_classes(count: Callable[[np.ndarray], np.ndarray], brown: Brown) -> tuple[np.ndarray, np.ndarray]:
    """(classes, their neighbour counts by `count`) after as many sweeps, in which every type may move once, as still add `least_gain`."""
    classes = first_classes(brown)
    counts = count(classes)
    value = information(counts, classes)
    while True:
        moved, its_counts = classes, counts
        for turn in range(2):
            moved = exchange(its_counts, moved, turn, brown)
            its_counts = count(moved)
        gain = information(its_counts, moved) - value
        if gain > 0:
            classes, counts, value = moved, its_counts, value + gain
        if gain < brown.least_gain:
            return classes, counts


def packed_neighbours(h: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(hashes, first places, packed counts) of the occurrences (hash, slot): per hash its slots and how often, as 6 + 26 bits."""
    order = np.lexsort((slots, h))
    h, slots = h[order], slots[order]
    new_word = np.concatenate([[True], h[1:] != h[:-1]])
    starts = np.flatnonzero(new_word | np.concatenate([[True], slots[1:] != slots[:-1]]))
    n = np.diff(np.append(starts, len(h)))
    entries = (slots[starts] | (n << 6)).astype("<u4")
    firsts = np.flatnonzero(new_word[starts])
    return h[starts[firsts]], order[starts[firsts]], rows_of(entries, np.append(firsts, len(entries)))


def best_classes(read: DataFrame, vocabulary: Vocabulary, brown: Brown, classes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """h, c and class of every word of the training texts that is no type of its own: the class under which its neighbours are likeliest.

    A task passes on a word's neighbouring classes once, however often it meets the word; sorted by word they are added up
    as they come, so no word is gathered whole. A rare word leans on the neighbours of its shape.
    """
    k = brown.classes
    if k > 32 or brown.size > 1 << 16:
        raise ValueError("at most 32 classes and 65,536 types")
    say = weights(counts, classes, brown)
    lean = np.divide(counts[: brown.shapes] @ say, counts[: brown.shapes, :k].sum(1, keepdims=True), out=np.zeros((brown.shapes, k)), where=counts[: brown.shapes, :k].sum(1, keepdims=True) > 0) * brown.prior
    shared = read.sparkSession.sparkContext.broadcast((vocabulary.hashes, classes, say, lean))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, _, _ = shared.value
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            h, shapes, before, after = (np.concatenate(x) for x in zip(*held, strict=True))
            words, first, packed = packed_neighbours(np.concatenate([h, h]), np.concatenate([before, k + after]))
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(shapes[first % len(h)].astype(np.int32)), packed], ["h", "shape", "counts"])

        size = 0
        for b in _slices(batches):
            types = np.concatenate([[brown.end], joined(b.column(0), "<u2")[1]])
            at = np.flatnonzero(types < brown.shapes)
            if not len(at):
                continue
            n, codes = joined(b.column(1), "<u4")
            far = b.column(2)
            firsts = np.cumsum([0, *far.value_lengths().to_numpy(zero_copy_only=False)[:-1]])
            hashes = np.concatenate([known, far.flatten().to_numpy(zero_copy_only=False)])
            place = np.where(codes < len(known), codes, codes + np.repeat(firsts, n))
            c = classes[types].astype(np.int64)
            held.append((hashes[place], types[at], c[at - 1], c[at + 1]))
            size += len(at)
            if size >= GATHERED:
                yield out()
                held.clear()
                size = 0
        if held:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, say, lean = shared.value
        last: tuple[int, int, np.ndarray] | None = None

        def out(h: np.ndarray, shapes: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            best = (table @ say + lean[shapes])[:, :-1].argmax(1)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(table[:, :k].sum(1).astype(np.int64)), pa.array(best.astype(np.int32))], ["h", "c", "class"])

        for b in _slices(batches, 4096):
            h, shapes = b.column(0).to_numpy(), b.column(1).to_numpy()
            n, entries = joined(b.column(2), "<u4")
            new = np.concatenate([[True], h[1:] != h[:-1]])
            of = np.repeat(np.cumsum(new) - 1, n)
            words, firsts = h[new], shapes[new]
            table = np.bincount(of * 2 * k + (entries & 63), entries >> 6, len(words) * 2 * k).reshape(-1, 2 * k)
            if last:
                if last[0] == words[0]:
                    table[0] += last[2]
                else:
                    yield out(np.array([last[0]]), np.array([last[1]]), last[2][None])
            last = (int(words[-1]), int(firsts[-1]), table[-1])
            if len(words) > 1:
                yield out(words[:-1], firsts[:-1], table[:-1])
        if last:
            yield out(np.array([last[0]]), np.array([last[1]]), last[2][None])

    met = read.where("not held_out").select("types", "others", "hashes").mapInArrow(gather, "h bigint, shape int, counts binary")
    return met.repartition("h").sortWithinPartitions("h").mapInArrow(choose, "h bigint, c bigint, class int")


def known_classes(others: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The class of each frequent word that is no type of its own (0 for those that are); at most `known` rows come to the driver."""
    out = np.zeros(len(vocabulary.hashes), np.uint8)
    rows = others.where(F.col("c") >= vocabulary.least).select("h", "class").collect()
    if rows:
        out[np.searchsorted(vocabulary.hashes, np.array([r.h for r in rows], np.int64))] = [r["class"] for r in rows]
    return out


CLASSED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, classes binary"


def with_classes(read: DataFrame, others: DataFrame, vocabulary: Vocabulary, brown: Brown, classes: np.ndarray, own: np.ndarray) -> DataFrame:
    """Per row of `read` its known words, the sum of log counts and the class of every word and of the end; a word that no training text has takes its shape's class."""
    words = read.select("row_no", F.posexplode(F.arrays_zip("hashes", "times")).alias("at", "x")).select("row_no", "at", F.col("x.hashes").alias("h"), F.col("x.times").alias("times"))
    far = words.join(others, "h").groupBy("row_no").agg(F.sum("times").alias("n_far"), F.sum(F.log10(F.col("c") + 1) * F.col("times")).alias("far"), F.collect_list(F.struct("at", "class")).alias("met"))  # as long as the text at most
    x = read.select("row_no", "doc_id", "held_out", "n_tokens", "n_near", "near", "types", "others", F.size("hashes").alias("n_hashes")).join(far, "row_no", "left")
    x = x.select("doc_id", "held_out", "n_tokens", (F.col("n_near") + F.coalesce("n_far", F.lit(0))).cast("bigint").alias("n_known"), (F.col("near") + F.coalesce("far", F.lit(0.0))).alias("logs"), "types", "others", "n_hashes", F.coalesce("met", F.array().cast("array<struct<at:int,class:int>>")).alias("met"))
    shared = read.sparkSession.sparkContext.broadcast((classes, own, len(vocabulary.hashes)))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, own, known = shared.value
        for b in _slices(batches):
            lengths, types = joined(b.column(5), "<u2")
            n, codes = joined(b.column(6), "<u4")
            c = classes[types].astype(np.uint8)
            hashes, met = b.column(7).to_numpy(), b.column(8)
            firsts = np.cumsum([0, *hashes[:-1]])
            found = np.full(hashes.sum(), 255, np.uint8)
            pairs = met.flatten()
            found[np.repeat(firsts, met.value_lengths().to_numpy(zero_copy_only=False)) + pairs.field(0).to_numpy(zero_copy_only=False)] = pairs.field(1).to_numpy(zero_copy_only=False)
            all_classes = np.concatenate([own, found])
            theirs = all_classes[np.where(codes < known, codes, codes + np.repeat(firsts, n))]
            at = np.flatnonzero(types < brown.shapes)
            c[at] = np.where(theirs < 255, theirs, c[at])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], rows_of(c, np.cumsum([0, *lengths]))], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"])

    return x.mapInArrow(resolve, CLASSED)


def transitions(classed: DataFrame, brown: Brown) -> np.ndarray:
    """How often class d follows class c in the training texts: one small table from each task."""
    k = brown.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * k, np.int64)
        for b in _slices(batches):
            c = np.concatenate([[k - 1], joined(b.column(0), "u1")[1]]).astype(np.int64)
            sums += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["pair", "n"])

    out = np.zeros(k * k, np.int64)
    for r in classed.where("not held_out").select("classes").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(k, k)


@dataclass
class ClassModel:
    """log10 of transitions, and of the total that a word's count is divided by in each class."""

    transitions: np.ndarray
    class_totals: np.ndarray


def class_model(pairs: np.ndarray, others: DataFrame, vocabulary: Vocabulary, brown: Brown, classes: np.ndarray, ends: int) -> ClassModel:
    """Smoothed transitions, and tokens plus distinct words of each class."""
    by_class = np.zeros(brown.classes)
    for r in others.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # one row per class
        by_class[r["class"]] += r.c + r.n
    own = vocabulary.types >= 0
    np.add.at(by_class, classes[vocabulary.types[own]], vocabulary.counts[own] + 1)
    by_class[-1] += ends + (ends > 0)
    p = pairs.astype(float)
    return ClassModel(np.log10((p + brown.alpha) / (p.sum(1, keepdims=True) + brown.alpha * brown.classes)), np.log10(by_class + 1))


def class_scores(classed: DataFrame, model: ClassModel) -> DataFrame:
    """`classed` with the log10 probability of its classes and of a count of one in each, as `steps`."""
    shared = classed.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in _slices(batches):
            lengths, c = joined(b.column(5), "u1")
            before = np.concatenate([[len(m.class_totals) - 1], c[:-1]])
            steps = m.transitions[before, c] - m.class_totals[c]
            sums = np.add.reduceat(steps, np.cumsum([0, *lengths[:-1]])) if len(lengths) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(5)], pa.array(sums)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "steps"])

    return classed.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, steps double")


def score_documents(docs: DataFrame, brown: Brown | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of `docs`.

    Tokens are the words in lower case (A to Z only) and one end. base_score is the smoothed unigram log10 probability,
    score the class model's. Null and empty texts are an end alone; null and repeated doc_ids are kept, one row each (a
    null id counts as the empty string when folds are dealt). Without training texts all counts are 0.
    """
    brown = brown or Brown()
    counts = written(count_words(_texts(docs).where("not held_out")), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == END, F.col("c")).otherwise(0)).alias("e")).first()
    tokens, distinct, ends = total.n or 0, total.v, total.e or 0
    vocabulary = frequent_words(counts, brown)
    dropped(counts)
    read = written(read_documents(docs, vocabulary, brown, ends), "read")
    classes, neighbours = learned_classes(lambda c: neighbour_counts(read, brown, c), brown)
    others = written(best_classes(read, vocabulary, brown, classes, neighbours), "word-classes")
    classed = written(with_classes(read, others, vocabulary, brown, classes, known_classes(others, vocabulary)), "classed")
    dropped(read)
    model = class_model(transitions(classed, brown), others, vocabulary, brown, classes, ends)
    x = class_scores(classed, model)
    base = F.col("logs") - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    score = F.col("logs") + F.col("steps")
    return x.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from the documents outside the held-out fold."""
    return score_documents(table(spark, sf_dir, "documents"))
