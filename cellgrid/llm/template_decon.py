"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, units after numbers and names (capitalised inside a sentence) become typed
placeholders. Windows of template words are joined by hash with the benchmark's. Joined windows of a document and an item
line up on diagonals; a diagonal counts if it covers enough words and its slots are consistent: each value of the item stands
for one value in the document, and no two names or numbers fall together. So questions with other numbers are found too.
Where words were put in or left out a copy goes on along another diagonal: pieces of diagonals that follow each other closely,
in the document and in the item, form a chain, and a chain counts like a diagonal. Where words are changed so densely that no
window is left whole, seeds of four words that match word for word hold the chain together, if they lie close to each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, in_few_parts, settled, table, whole, window_hashes

WINDOW = 8
#: Words of a seed; only items longer than a window have seeds.
SEED = 4
#: A seed is at most so many words from the next piece of its chain, in the document and in the item.
SEED_GAP = 4
#: A diagonal must cover this many words, or all but one of a shorter item's.
MIN_WORDS = 13
#: The templates of windows with fewer literal words say too little; such windows match word for word.
MIN_LITERAL = 4
#: Keeps hashes of words apart from those of templates.
WORD_FOR_WORD = np.uint64(0xD6E8FEB86659FD93)
#: Keeps hashes of seeds apart from those of windows.
SEED_MARK = np.uint64(0xA0761D6478BD642F)
#: Bits of the filter through which the documents' windows pass before the join; its size is fixed, whatever the benchmark.
FILTER_BITS = 1 << 24
#: Pieces of a chain that hold a window each are at most so many words apart, in the document and in the item.
GAP = 2 * WINDOW
MEMO_ENTRIES = 500_000

NUMBER, UNIT, NAME = 1, 2, 3
#: Units that are replaced after a number.
UNITS = frozenset("km m cm mm mi ft in kg g mg lb lbs oz t l ml s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year mph kmh km/h m/s c f k % usd eur gbp dollars dollar euros euro cents cent meters metres kilometers kilometres grams kilograms liters litres miles feet inches pounds percent".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")

ITEM_WINDOWS = pa.schema([("item_id", pa.int64()), ("item_words", pa.int32()), ("size", pa.int32()), ("place", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.int64())), ("exact", pa.bool_())])
WINDOWS = "doc_id bigint, row_no bigint, place bigint, h bigint, slots array<bigint>"
LEAKS = "doc_id bigint, item_id bigint, covered_words int, item_words int, windows int, slots int, changed_slots int"


class Canon:
    """Words as numbers: for each, the hash of its literal form, its type and whether a sentence ends with it; remembered."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.lit, self.kind, self.ends = np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)

    def ids(self, words: list[str]) -> np.ndarray:
        memo, lit, kind, ends = self.memo, [], [], []
        for w in set(words).difference(memo):
            core = _EDGE.sub("", w)
            low = core.lower()
            memo[w] = len(self.lit) + len(lit)
            lit.append(xxhash.xxh64_intdigest(low) | 1)
            kind.append(NUMBER if _NUMBER.fullmatch(core) else UNIT if low in UNITS else NAME if core[:1].isupper() and not core.isupper() else 0)
            ends.append(w[-1:] in ".!?:;|" or not core)
        if lit:
            self.lit, self.kind, self.ends = np.append(self.lit, np.array(lit, np.uint64)), np.append(self.kind, np.array(kind, np.int8)), np.append(self.ends, np.array(ends, bool))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def templates(canon: Canon, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, slot values, number of the text) of all words of some texts; the slot value of a literal word is 0."""
    if len(canon.lit) > MEMO_ENTRIES:
        canon.clear()
    of = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    if not len(of):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), of
    ids = canon.ids([w for words in texts for w in words])
    lit, kind, ends = canon.lit[ids], canon.kind[ids], canon.ends[ids]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    before = np.where(first, 0, np.concatenate([[0], kind[:-1]]))
    inside = ~first & ~np.concatenate([[True], ends[:-1]])
    slot = (kind == NUMBER) | ((kind == UNIT) & (before == NUMBER)) | ((kind == NAME) & inside)
    return np.where(slot, kind.astype(np.uint64) * np.uint64(7919), lit), np.where(slot, lit, np.uint64(0)), of


def literal_enough(values: np.ndarray, size: int) -> np.ndarray:
    """Which windows have enough literal words (all of a window shorter than that)."""
    n = np.concatenate([[0], np.cumsum(values == 0)])
    return n[size:] - n[:-size] >= min(MIN_LITERAL, size)


def matched_windows(t: np.ndarray, v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which are of templates) of every window: of its template, or of its words where the template says too little."""
    h, good = window_hashes(t, size), literal_enough(v, size)
    at = np.flatnonzero(~good)
    if len(at):
        words = np.where(v != 0, v, t)
        h[at] = window_hashes(words[at[:, None] + np.arange(size)].T, size)[0] ^ WORD_FOR_WORD
    return h.view(np.int64), good


def seeds(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hashes of every seed: of its words, slots or not."""
    return (window_hashes(np.where(v != 0, v, t), SEED) ^ SEED_MARK).view(np.int64)


def dense_seeds(hit: np.ndarray, of: np.ndarray, windows: np.ndarray, window: int, least: int) -> np.ndarray:
    """Those of the places `hit` of seeds that a chain can use; all places are sorted.

    A stretch is what lies at most SEED_GAP words apart. A chain that holds a seed lies in one stretch up to its next window, so
    a stretch without a window that covers fewer than `least` words holds no chain.
    """
    at = np.concatenate([hit, windows])
    end = np.concatenate([hit + SEED, windows + window])
    seed = np.arange(len(at)) < len(hit)
    order = np.argsort(at, kind="stable")
    at, end, seed = at[order], end[order], seed[order]
    if not len(hit):
        return hit
    reach = np.maximum.accumulate(end)  # later texts lie behind earlier ones, so the reach never grows past a text's end
    stretch = np.concatenate([[0], np.cumsum((at[1:] - reach[:-1] > SEED_GAP) | (of[at[1:]] != of[at[:-1]]))])
    covered = np.bincount(stretch, np.concatenate([[end[0] - at[0]], np.maximum(0, end[1:] - np.maximum(at[1:], reach[:-1]))]))
    keep = (covered >= least) | (np.bincount(stretch, ~seed) > 0)
    return at[seed & keep[stretch]]


def needed(item_words: int, min_words: int) -> int:
    """How many words of an item a copy has to cover."""
    return min(min_words, max(1, item_words - (item_words > 3)))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_words, size, place, h, slots, exact (matched word for word, so without slots) of the benchmark's windows and seeds.

    An item with fewer words than a window is one window; items with more also have seeds; null and empty items have none.
    """
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ITEM_WINDOWS.names}
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").split()
                if not words:
                    continue
                t, v, _ = templates(canon, [words])
                size = min(window, len(words))
                h, good = matched_windows(t, v, size)
                rows = [(size, p, int(h[p]), v[p : p + size].view(np.int64).tolist() if good[p] else [], not good[p]) for p in range(len(h))]
                if len(words) > window > SEED:
                    rows += [(SEED, p, x, [], False) for p, x in enumerate(seeds(t, v).tolist())]
                for r in rows:
                    for column, x in zip(out.values(), (item, len(words), *r), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_pydict(out, ITEM_WINDOWS)

    b = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    return b.mapInArrow(compute, "item_id bigint, item_words int, size int, place bigint, h bigint, slots array<bigint>, exact boolean")


def document_windows(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int, least: int | None) -> DataFrame:
    """The windows of all whole texts that pass the filter, and the seeds that lie close enough to be of use; null and empty texts have none.

    `least` is how many words the items with seeds need at least (None: there are no seeds).
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        canon, held, row_no = Canon(), shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                b = batch.slice(first, 256)
                doc_ids = b.column(0).to_pylist()
                t, v, of = templates(canon, [(x or "").split() for x in b.column(1).to_pylist()])
                ids, rows, places, hashes, slots = [], [], [], [], []
                starts = np.searchsorted(of, np.arange(len(doc_ids)))
                full = np.empty(0, np.int64)
                for size in sizes:
                    if len(t) < size:
                        continue
                    h, good = matched_windows(t, v, size)
                    hit = np.flatnonzero(in_bitmap(held, h))
                    hit = hit[of[hit] == of[hit + size - 1]]
                    for at in hit.tolist():
                        k = int(of[at])
                        ids.append(doc_ids[k])
                        rows.append(row_no + k)
                        places.append(at - int(starts[k]))
                        slots.append(v[at : at + size].view(np.int64).tolist() if good[at] else [])
                    hashes += h[hit].tolist()
                    full = hit if size == window else full
                if least is not None and len(t) >= SEED:
                    h = seeds(t, v)
                    hit = np.flatnonzero(in_bitmap(held, h))
                    hit = dense_seeds(hit[of[hit] == of[hit + SEED - 1]], of, full, window, least)
                    numbers = of[hit]
                    ids += [doc_ids[k] for k in numbers.tolist()]
                    rows += (row_no + numbers).tolist()
                    places += (hit - starts[numbers]).tolist()
                    hashes += h[hit].tolist()
                    slots += [[]] * len(hit)
                row_no += len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(places, pa.int64()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], ["doc_id", "row_no", "place", "h", "slots"])

    d = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return d.mapInArrow(compute, WINDOWS)


def _stretches(windows: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, windows) of what windows (place, size) in order of place cover without a gap."""
    out: list[list[int]] = []
    for place, size in windows:
        if out and place <= out[-1][1]:
            out[-1][1:] = max(out[-1][1], place + size), out[-1][2] + 1
        else:
            out.append([place, place + size, 1])
    return [tuple(x) for x in out]


def best_match(item_words: int, window: int, min_words: int, lines: list[dict]) -> tuple[int, int, int, int] | None:
    """(covered words, windows, slots, changed slots) of the best diagonal or chain of one text and one item, if any covers enough.

    A line has its number (place in the text less place in the item), its sorted windows (place in the item, size), the places
    of those that match word for word because their template says too little, and its pairs of slots. Where the pairs don't
    agree, only what matches so counts. Seeds, the windows of less than the full size, count in chains alone.
    """
    need, size = needed(item_words, min_words), min(window, item_words)
    found, pieces = [], set()
    for line in lines:
        pairs = frozenset((x["a"], x["b"]) for x in line["pairs"])
        windows = [(w["place"], w["size"]) for w in line["windows"]]
        if len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
            windows, pairs = [(p, size) for p in line["exact"]], frozenset()
        full = [w for w in windows if w[1] == size]
        at = _stretches(full)
        covered = sum(z - a for a, z, _ in at)
        if covered >= need:
            found.append((covered, len(full), len(pairs), sum(x != y for x, y in pairs)))
        pieces |= {(a + line["line"], a, z, n, True, pairs) for a, z, n in at}
        if len(full) < len(windows):
            pieces |= {(a + line["line"], a, z, n, any(a <= p < z for p, _ in full), pairs) for a, z, n in _stretches(windows)}
    if max(found, default=(0,))[0] < item_words and pieces:
        found += _chains(sorted(pieces, key=lambda p: p[:4]), need)
    return max(found, default=None)


def _chains(pieces: list[tuple], need: int) -> list[tuple[int, int, int, int]]:
    """What the chains of enough words have; `pieces` are (place in the text, place in the item, its end in the item, windows, whether one is of full size, pairs), in order of place."""
    best: list[tuple[int, int, dict, dict]] = []  # of the best chain that ends with each piece: covered words, windows, slots by the item's value and by the text's
    found, first = [], 0
    longest = max(p[2] - p[1] for p in pieces)
    for k, (at, place, end, windows, full, pairs) in enumerate(pieces):
        mine = (end - place, windows, dict(pairs), {b: a for a, b in pairs})
        while pieces[first][0] + longest + GAP < at:
            first += 1
        for m in range(first, k):
            before, (covered, n, there, back) = pieces[m], best[m]
            gap = GAP if full and before[4] else SEED_GAP
            if not (before[0] < at and before[1] < place and before[2] < end and at - (before[0] + before[2] - before[1]) <= gap and place - before[2] <= gap):
                continue
            total = covered + end - max(place, before[2])
            if (total, n + windows) > mine[:2] and all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs):
                mine = (total, n + windows, there | dict(pairs), back | {b: a for a, b in pairs})
        best.append(mine)
        if mine[0] >= need:
            found.append((mine[0], mine[1], len(mine[2]), sum(a != b for a, b in mine[2].items())))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and benchmark item that it repeats: doc_id, item_id, covered_words, item_words, windows, slots, changed_slots.

    Null and empty texts and items match nothing. Rows that share a doc_id (or have none) count as one document, though a
    copy lies within one row. A document that holds an item twice is listed with the better place. Empty tables give no rows.
    """
    items = item_windows(benchmark, window)
    seeded = (F.col("item_words") > window) & F.lit(window > SEED)
    sizes = [(r["size"], r["least"]) for r in items.groupBy(F.when(seeded & (F.col("size") == SEED), 0).otherwise(F.col("size")).alias("size")).agg(F.min("item_words").alias("least")).collect()]  # at most `window` + 1 of them
    least = next((needed(n, min_words) for size, n in sizes if size == 0), None)
    near = document_windows(docs, bitmap_of(items, "h", FILTER_BITS), sorted(size for size, _ in sizes if size), window, least)
    found = near.join(items.withColumnsRenamed({"place": "item_place", "slots": "item_slots"}), "h")
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"] != 0)
    of = ("doc_id", "row_no", "item_id", "item_words")
    on_line = found.groupBy(*of, (F.col("place") - F.col("item_place")).alias("line")).agg(  # all as long as the item at most
        F.sort_array(F.collect_set(F.struct(F.col("item_place").alias("place"), "size"))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_place")))).alias("exact"),
    )
    lines = on_line.groupBy(*of).agg(F.collect_list(F.struct("line", "windows", "exact", "pairs")).alias("lines"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if m := best_match(r["item_words"], window, min_words, r["lines"]):
                    out.append((r["doc_id"], r["item_id"], m[0], r["item_words"], *m[1:]))
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 5), strict=True)], [x.split()[0] for x in LEAKS.split(", ")])

    best = lines.mapInArrow(match, LEAKS).groupBy("doc_id", "item_id").agg(F.max(F.struct("covered_words", "windows", "slots", "changed_slots", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.covered_words").cast("bigint").alias("covered_words"), "m.item_words", "m.windows", "m.slots", "m.changed_slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that repeat no benchmark item, with all their columns: row by row, whatever their ids.

    Whether a row does depends on its text alone, so rows go by a hash of their text. Those hashes are few and written
    first, so that Spark sees whether they may be broadcast.
    """
    rows = docs.select(whole(docs), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    bad = settled(lambda: in_few_parts(leaks(rows.select(F.col("h").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("h")).distinct()), "leaks")
    return rows.join(bad, "h", "left_anti").select("row.*")


def op7_template_decon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that repeats a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
