"""Phrases whose words keep together, mined with count tries.

Every shard of the corpus counts its phrases in a trie of limited depth (language at the root, a word on each edge) and passes
it on level by level, sorted. Ranges of the sorted order are dealt to tasks, each of which merges the runs of all shards that fall
into it and keeps the frequent nodes. A walk over a range holds the path to the current node, so the counts of a phrase's left parts are on it;
the right parts come by suffix links, from a phrase to the one without its first word.

Tries grow in steps: words, then two words, then the rest. A phrase is as rare as its rarest part at least, so a step follows only
words and pairs that the step before found frequent (a bitmap of their hashes: it may keep a phrase too much, never lose one).
The first steps only decide what is followed, so their runs are dealt by hash and merged at once; the last one's are written, since
ranges are found by sampling.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, in_bitmap, settled, table, written

#: Language of rows that have none.
UNKNOWN = "und"


@dataclass(frozen=True)
class Mining:
    """What counts as a phrase worth reporting, and the sizes that bound a task's memory (never what is counted)."""

    longest: int = 4
    least: int = 30
    #: A phrase goes if a longer one around it has this share of its occurrences, in percent.
    percent: int = 80
    top: int = 2000
    scale: int = 2_000_000
    #: Words and borders that a shard gathers before it writes its trie.
    gathered: int = 1 << 20
    #: Bits of a bitmap for each frequent phrase, and of the whole bitmap at most (64 MB).
    bits_each: int = 16
    most_bits: int = 1 << 29


#: Texts are taken in parts of about so many bytes, cut between pieces, so that a very long one is never held as words at once.
PART = 1 << 22
_BORDERS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text (borders written as full stops) in parts that end at borders; a piece longer than a part stays whole."""
    at = 0
    while len(text) - at > PART:
        end = text.rfind(b".", at, at + PART)
        end = end if end >= 0 else text.find(b".", at + PART)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _hashes(root: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, from the hashes of their language and of each word."""
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
    h = root.astype(np.uint64)
    for w in words:
        h = (h ^ w) * mix
        h ^= h >> shift
    return h


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


NODE = ["lang", "phrase", "f"]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (not negative) in order, each key's number among them, and how often each occurs; places ride in the lower bits where they fit, which sorts faster."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True, return_counts=True)
    packed = np.sort((keys << bits) | np.arange(len(keys)))
    order, key = packed & ((1 << bits) - 1), packed >> bits
    new = np.concatenate([[True], key[1:] != key[:-1]])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return key[starts], number, np.diff(starts, append=len(keys))


class Shard:
    """The count trie of some texts: words get numbers as they come, the trie is built level by level when it is written."""

    def __init__(self, first: int, last: int, frequent: np.ndarray | None):
        self.first, self.last, self.frequent = first, last, frequent
        self.clear()

    def clear(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."]  # number 0: the border between pieces, which is never part of a word
        self.langs: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.roots: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: str, part: bytes) -> None:
        number = self.ids.__getitem__
        tokens = part.replace(b".", b" . ").split()
        w = np.fromiter(map(number, tokens), np.int64, len(tokens))
        self.words += [w, np.zeros(1, np.int64)]
        self.roots.append((self.langs.setdefault(lang, len(self.langs)), len(w) + 1))
        self.size += len(w) + 1

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """lang, phrase and count of the trie's nodes from level `first` to `last`, each level in the order of the trie; before the first level, the roots with all words."""
        names, langs = list(self.ids), sorted(self.langs)
        order = np.array(sorted(range(1, len(names)), key=names.__getitem__), np.int64)
        place, lang_place = np.full(len(names), -1, np.int64), np.empty(len(langs), np.int64)
        place[order] = np.arange(len(order))
        lang_place[[self.langs[x] for x in langs]] = np.arange(len(langs))
        vocabulary = [names[k] for k in order]
        w = place[np.concatenate(self.words)]
        level = np.repeat(lang_place[[k for k, _ in self.roots]], [n for _, n in self.roots])
        self.clear()
        known = self.followed(w, level, vocabulary, langs)
        words, lang = pa.array(vocabulary, pa.binary()).cast(pa.string()), pa.array(langs, pa.string())
        if self.first == 1:
            all_words = np.bincount(level[w >= 0], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([lang, pa.array([""] * len(langs), pa.string()), pa.array(all_words, pa.int64())], NODE)
        for d in range(1, self.last + 1):
            if d >= max(2, self.first):
                known = known[:-1] & known[1:]
            n = len(known)
            alive = np.flatnonzero(known & (w[d - 1 : d - 1 + n] >= 0) & (level[:n] >= 0))
            keys, node, counts = grouped(level[alive] * len(words) + w[alive + d - 1])
            parent, word = np.divmod(keys, max(1, len(words)))
            level = np.full(n, -1, np.int64)
            level[alive] = node
            parent, label = pa.array(parent), words.take(pa.array(word))
            lang = lang.take(parent)
            phrases = label if d == 1 else pc.binary_join_element_wise(phrases.take(parent), label, " ")
            if d >= self.first:
                yield pa.RecordBatch.from_arrays([lang, phrases, pa.array(counts, pa.int64())], NODE)

    def followed(self, w: np.ndarray, root: np.ndarray, vocabulary: list[bytes], langs: list[str]) -> np.ndarray:
        """At which places a phrase may start: every word in the first step, later those where a frequent phrase of the step before starts."""
        d = self.first - 1
        if d == 0:
            return w >= 0
        n = max(0, len(w) - d + 1)
        out = np.ones(n, bool)
        for k in range(d):
            out &= w[k : k + n] >= 0
        word_hash = np.array([*map(_hash, vocabulary), 0], np.uint64)  # a border, -1, takes the last one
        lang_hash = np.array([_hash(x.encode()) for x in langs], np.uint64)
        if n:
            out &= in_bitmap(self.frequent, _hashes(lang_hash[root[:n]], [word_hash[w[k : k + n]] for k in range(d)]))
        return out


def shard_tries(docs: DataFrame, first: int, last: int, frequent: np.ndarray | None, mining: Mining) -> DataFrame:
    """lang, phrase and f: the nodes of all shards' tries from level `first` to `last`, each shard's sorted."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(first, last, frequent)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in _parts(text.encode().lower().translate(_BORDERS)):
                    shard.add(lang, part)
                    if shard.size >= mining.gathered:
                        yield from shard.nodes()
        if shard.size:
            yield from shard.nodes()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(build, "lang string, phrase string, f bigint")


def merged_tries(nodes: DataFrame, least: int, longest: int, ranges: bool = False) -> DataFrame:
    """lang, phrase, f, h (its hash), m (its words; 0 at a root) and l1, l2, ... of every phrase that occurs `least` times.

    l1 is the count of its first word, and so on; null where there is no such part, or where that part is in an earlier range.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(longest)
        held: tuple[str, str, int] | None = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            lang, phrase, f = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(phrase[1:], phrase[:-1])).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(f, starts)
            names = lambda at: (lang[int(at)].as_py(), phrase[int(at)].as_py())
            if held and held[:2] == names(0):
                sums[0] += held[2]
            elif held and held[2] >= least:
                walk.take(*held)
            held = (*names(starts[-1]), int(sums[-1]))
            keep = np.flatnonzero(sums[:-1] >= least)
            at = pa.array(starts[keep])
            for row in zip(lang.take(at).to_pylist(), phrase.take(at).to_pylist(), sums[keep].tolist(), strict=True):
                walk.take(*row)
            if walk.rows:
                yield walk.out()
        if held and held[2] >= least:
            walk.take(*held)
            yield walk.out()

    columns = ", ".join(f"l{k} bigint" for k in range(1, longest))
    key = ["phrase", "lang"]  # sorts faster than the language first
    dealt = nodes.repartitionByRange(*key) if ranges else nodes.repartition(*key)
    return dealt.sortWithinPartitions(*key).mapInArrow(merge, f"lang string, phrase string, f bigint, h bigint, m int, {columns}")


class Walk:
    """A walk over the sorted phrases of one range, with the counts of those that the current one begins with, by language."""

    def __init__(self, longest: int):
        self.longest, self.rows = longest, []
        self.path: list[str] = []
        self.counts: dict[str, dict[str, int]] = {}

    def take(self, lang: str, phrase: str, f: int) -> None:
        while self.path and not phrase.startswith(self.path[-1]):
            del self.counts[self.path.pop()]
        left, at = [], phrase.find(" ")
        while at >= 0:
            left.append(self.counts.get(phrase[:at], {}).get(lang))
            at = phrase.find(" ", at + 1)
        if phrase not in self.counts:
            self.path.append(phrase)
            self.counts[phrase] = {}
        self.counts[phrase][lang] = f
        self.rows.append((lang, phrase, f, len(left) + 1 if phrase else 0, *left, *[None] * (self.longest - 1 - len(left))))

    def out(self) -> pa.RecordBatch:
        lang, phrase, f, m, *left = zip(*self.rows, strict=True)
        self.rows = []
        words = [p.encode().split(b" ") for p in phrase]
        h = np.zeros(len(words), np.uint64)
        for n in set(m):
            at = [k for k, x in enumerate(m) if x == n]
            columns = [np.array([_hash(words[k][j]) for k in at], np.uint64) for j in range(n)]
            h[at] = _hashes(np.array([_hash(lang[k].encode()) for k in at], np.uint64), columns)
        columns = [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(f, pa.int64()), pa.array(h.view(np.int64)), pa.array(m, pa.int32()), *[pa.array(x, pa.int64()) for x in left]]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f", "h", "m", *[f"l{k}" for k in range(1, self.longest)]])


def bitmap_of_phrases(frequent: DataFrame, mining: Mining) -> np.ndarray:
    """A bitmap of their hashes, sized by how many there are."""
    bits = max(1 << 20, frequent.count() * mining.bits_each)
    return bitmap_of(frequent, "h", min(mining.most_bits, 1 << (bits - 1).bit_length()))


def frequent_phrases(docs: DataFrame, mining: Mining) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words that occur `least` times, as `merged_tries` gives them, every left part known; and lang, n: all words."""
    found = written(merged_tries(shard_tries(docs, 1, 1, None, mining), mining.least, 2), "words")
    n, whole = found.where("m = 0").select("lang", F.col("f").alias("n")), found.where("m > 0").select(*NODE)
    found = found.where("m > 0")
    if mining.longest > 2:
        found = written(merged_tries(shard_tries(docs, 2, 2, bitmap_of_phrases(found, mining), mining), mining.least, 2), "pairs")
        whole = whole.unionByName(found.select(*NODE))
    nodes = written(shard_tries(docs, min(3, mining.longest), mining.longest, bitmap_of_phrases(found, mining), mining), "tries")
    every = written(merged_tries(whole.unionByName(nodes), mining.least, mining.longest, ranges=True), "phrases")
    return with_left_parts(every, mining.longest), n


def with_left_parts(every: DataFrame, longest: int) -> DataFrame:
    """The left parts that lie before the start of a range: what a range lacks begins its first phrase, so there are fewer than `longest` of them for each range, and they are broadcast."""
    lacking = [every.where((F.col("m") > k) & F.col(f"l{k}").isNull()).select("lang", F.substring_index("phrase", " ", k).alias("phrase")).distinct() for k in range(1, longest)]
    if not lacking:
        return every
    parts = written(reduce(DataFrame.unionByName, lacking).join(every.select("lang", "phrase", "f"), ["lang", "phrase"]), "left")
    for k in range(1, longest):
        part = F.broadcast(parts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f")))
        same = (F.col("lang") == F.col("_lang")) & (F.substring_index("phrase", " ", k) == F.col("_part")) & F.col(f"l{k}").isNull() & (F.col("m") > k)
        every = every.join(part, same, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", "_f")).drop("_lang", "_part", "_f")
    return every


def with_right_parts(every: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, m, f, l and r of every phrase of two words or more: the counts of what stands left and right of each cut.

    A phrase's first right part is the phrase behind its suffix link, and the next ones are that phrase's own.
    """
    left = F.array(*[F.col(f"l{k}") for k in range(1, longest)])
    every = written(every.select("lang", "phrase", "m", "f", F.slice(left, 1, F.col("m") - 1).alias("l")), "left-parts")
    below = every.where("m = 1").withColumn("r", F.expr("CAST(array() AS array<bigint>)"))
    levels = []
    for m in range(2, longest + 1):
        behind = below.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "r").alias("r"))
        here = every.where(F.col("m") == m).withColumn("suffix", F.expr("substr(phrase, instr(phrase, ' ') + 1)"))
        below = here.join(behind, ["lang", "suffix"]).drop("suffix")
        levels.append(below)
    return reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the phrases of `docs` (lang, text) that keep together best, `top` for each lang.

    Letters A-Z are lower-cased; texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs.
    A null text counts as empty, a null lang as `und`; repeated rows count each time; without phrases there are no rows. Other
    columns are not looked at.
    """
    if mining.longest < 2:
        raise ValueError("phrases have two words at least")

    def scored() -> DataFrame:
        every, n = frequent_phrases(docs, mining)
        phrases = written(with_right_parts(every, mining.longest), "cuts")
        score = lambda k: F.expr(f"CAST({mining.scale} AS DECIMAL(10,0)) * CAST(f AS DECIMAL(20,0)) div (CAST(l[{k}] AS DECIMAL(20,0)) + CAST(r[{k}] AS DECIMAL(20,0)))")
        cuts = [F.when(F.col("m") > k + 1, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.get("l", F.lit(k)).alias("l"), F.get("r", F.lit(k)).alias("r"))) for k in range(mining.longest - 1)]
        cut = F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull()))
        around = phrases.where("m > 2").select("lang", "f", F.split("phrase", " ").alias("w"), "m")
        inner = F.expr("flatten(transform(sequence(2, m - 1), k -> transform(sequence(1, m - k + 1), i -> array_join(slice(w, i, k), ' '))))")
        longer = around.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        dec = lambda c: F.col(c).cast("decimal(20,0)")
        kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * dec("longer") < mining.percent * dec("f")))
        kept = kept.select("lang", "phrase", F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        best = kept.withColumn("rank", rank).where(F.col("rank") <= mining.top)
        return best.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

    return settled(scored, "collocations")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


def oracle_sql(mining: Mining = Mining()) -> str:
    """The same rows in DuckDB: every phrase at every place, counted and cut."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) piece
  FROM (SELECT coalesce(lang, '{UNKNOWN}') lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') text FROM documents)),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) i FROM worded),
phrases AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*) f
  FROM places, (SELECT unnest(range(1, {mining.longest} + 1)) m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
words AS (SELECT lang, CAST(sum(f) AS BIGINT) n FROM phrases WHERE m = 1 GROUP BY lang),
frequent AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') w FROM phrases WHERE f >= {mining.least}),
cuts AS (SELECT c.lang, c.phrase, c.m, c.w, c.f, k, x.f l, y.f r, CAST({mining.scale}::HUGEINT * c.f // (x.f + y.f) AS BIGINT) score
  FROM (SELECT *, unnest(range(1, m)) k FROM frequent WHERE m > 1) c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, f, array_to_string(w[i:i + j - 1], ' ') phrase FROM
  (SELECT *, unnest(range(1, m - j + 2)) i FROM (SELECT *, unnest(range(2, m)) j FROM frequent WHERE m > 2))),
longer AS (SELECT lang, phrase, max(f) f FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase WHERE o.f IS NULL OR 100 * o.f < {mining.percent} * c.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= {mining.top}"""
