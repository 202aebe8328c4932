"""Near duplicates by an exact Jaccard join on word shingles, with set-relation skipping.

Every text becomes a set of shingle hashes; texts with the same set form a class, and classes are joined. Two sets at the
threshold share a shingle in their prefixes under any common order of shingles. The order used here puts shingles seen in
many prefixes last, so the lists of the inverted index that passages would fill stay short. Skipping works on two levels:

* Index level: an entry carries its place in its set and the set's size. Lists are cut into blocks by size. What an entry's
  place leaves of its set bounds the size of sets that it can link to, so an entry looks only into the blocks up to there,
  and into none if its place is too late: block and list together are the key of the join, and other blocks are never read.
  Pairs are skipped by the other entry's place, and by what their prefixes share together.
* Answer level: a long list is never paired with itself. The sets of its blocks form groups, one for each block's leader,
  and groups whose leaders are alike are one. A group has a centre, the elements that most of the sets like a leader have,
  and every set is kept by its delta, what it and the centre don't share. Two sets of a group differ by |dx| + |dy| - 2 |dx & dy|. So sets whose deltas are
  small link for certain, which a comparison of every set with the one nearest to the centre shows; any others link only
  if their deltas share enough, which is a join with a prefix filter of its own, on deltas instead of sets, and only
  between sets that are not connected yet. Answers of a set follow from those of a similar set; what is left is compared.

Comparisons are exact on 64-bit hashes of the shingles. Connected components of the links come from joins on narrow tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, dropped, in_bitmap, in_few_parts, settled, table, whole, window_hashes, written

#: Lists of at most this many sets are paired directly; shingles in more prefixes than this come last in the order.
SHORT_LIST = 24
#: Size of the bitmaps of such shingles and of the rows to fetch: fixed, so what is broadcast doesn't grow.
BITMAP_BITS = 1 << 26
#: A centre is estimated from so many sets of a group; it decides how much is compared, never what links.
CENTRE_SETS = 63
#: Stands for no element in the index of deltas: under it meet sets so near the centre that deltas need not share any.
NONE = -(1 << 63)


@dataclass(frozen=True)
class Jaccard:
    """Two sets link when den * |intersection| >= num * |union|; shingles have `words` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def prefix(self, n: int) -> int:
        """How many of a set's first elements must contain one of any set that it links to."""
        return n - -(-self.num * n // self.den) + 1

    def delta_prefix(self, n: int) -> int:
        """How many first elements of a delta must contain one of any delta that it must share elements with: a set of n differs from one that it links to by less."""
        return (self.den - self.num) * n // self.num + 1

    def needed(self, a: Column, b: Column) -> Column:
        """The least overlap with which sets of these sizes link."""
        return F.ceil(self.num * (a + b) / F.lit(float(self.den + self.num)) - 1e-9)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes. Arrow cuts the texts and numbers their distinct words, each of which is hashed once."""

    def __init__(self, words: int):
        self.words = words

    def sets(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        numbered = cut.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[numbered.indices.to_numpy()]
        word = np.array([w != b"" for w in distinct], bool)[numbered.indices.to_numpy()]  # white space at a text's ends leaves empty words
        ends = np.concatenate([[0], np.cumsum(word)])[cut.offsets.to_numpy()].tolist()
        h, out = h[word], []
        windows = window_hashes(h, self.words)
        for a, b in zip(ends, ends[1:], strict=False):
            s = np.sort(windows[a : b - self.words + 1] if b - a >= self.words else window_hashes(h[a:b], b - a) if b > a else h[:0])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table between two steps: most are narrow, and there are dozens of them."""
    return written(in_few_parts(df), name)


def _class_of(s: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _by_part(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def common_shingles(docs: DataFrame, rule: Jaccard) -> np.ndarray:
    """A bitmap of the shingles that lie in more than SHORT_LIST prefixes when the order is that of the hashes."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler(rule.words)
        for b in _by_part(batches):
            parts = [s[: rule.prefix(len(s))] for s in tool.sets(b.column(0)) if len(s)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64))], ["h"])

    counts = _texts(docs).select("text").mapInArrow(prefixes, "h bigint").groupBy("h").count()
    return bitmap_of(counts.where(F.col("count") > SHORT_LIST), "h", BITMAP_BITS)


def signatures(docs: DataFrame, rule: Jaccard, common: np.ndarray) -> DataFrame:
    """doc_id, size n, class and prefix of every row; an empty set has no class."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Shingler(rule.words)
        for b in _by_part(batches):
            sets, prefixes = tool.sets(b.column(1)), []
            for s in sets:
                late = in_bitmap(shared.value, s)
                prefixes.append(np.concatenate([s[~late], s[late]])[: rule.prefix(len(s))].view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "cls", "prefix"])

    return _texts(docs).mapInArrow(sign, "doc_id bigint, n bigint, cls bigint, prefix array<bigint>")


def fetch_sets(docs: DataFrame, rule: Jaccard, wanted: DataFrame) -> DataFrame:
    """cls and the whole sorted set of the wanted classes (cls, rep): only rows whose doc_id is some class's `rep` are shingled again.

    A class can come more than once (from rows that share a doc_id), though only once from a task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64("rep").alias("r")), "r", BITMAP_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = Shingler(rule.words), set()
        for b in batches:
            keep = b.filter(pa.array(in_bitmap(shared.value, b.column(0).to_numpy())))
            for part in _by_part([keep]):
                found = {_class_of(s): s for s in tool.sets(part.column(1)) if len(s)}
                new = [c for c in found if c not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[c].tobytes() for c in new], pa.binary())], ["cls", "members"])

    return _texts(docs).select(F.xxhash64("doc_id").alias("r"), "text").mapInArrow(fetch, "cls bigint, members binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the sets of both, as ma and mb. Where many pairs share a set it is `b`: the narrow pairs meet it first, and then spread over their own sets."""
    return pairs.join(sets.withColumnsRenamed({"cls": "b", "members": "mb"}), "b").join(sets.withColumnsRenamed({"cls": "a", "members": "ma"}), "a").select("a", "b", "ma", "mb")


def compared(pairs: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (a, b), each once, with whether their sets share a half and whether they link."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_part(batches):
            alike, linked = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(2 * n >= len(x) + len(y) - n)
                linked.append(rule.den * n >= rule.num * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(alike, pa.bool_()), pa.array(linked, pa.bool_())], ["a", "b", "alike", "linked"])

    return _with_sets(pairs, sets).mapInArrow(count, "a bigint, b bigint, alike boolean, linked boolean").distinct()


def centres(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(leader, centre) of each group (cls, leader, alike): the elements in most of CENTRE_SETS sets, dealt by a hash, of those like a leader before others.

    Leaders count no more than others: they stand first in some list, so they are no fair sample of a group.
    """
    dealt = Window.partitionBy("leader").orderBy(F.desc("alike"), F.xxhash64("cls"), "cls")
    few = near.withColumn("k", F.row_number().over(dealt)).where(F.col("k") <= CENTRE_SETS).select("leader", "cls")
    few = few.join(sets, "cls")

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for members in b.column(1).to_pylist():
                e, n = np.unique(np.concatenate([np.frombuffer(m, np.uint64) for m in members]), return_counts=True)
                out.append(e[2 * n > len(members)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["leader", "centre"])

    return few.groupBy("leader").agg(F.collect_list("members").alias("m")).mapInArrow(most, "leader bigint, centre binary")


def deltas(led: DataFrame, sets: DataFrame, centre: DataFrame, rule: Jaccard, common: np.ndarray) -> DataFrame:
    """led (cls, leader) with the set's size n, the size d of its delta from the centre, how many of the delta are outside the centre (a), and the delta's prefix.

    Deltas of a group have a common order, rare elements first: those outside the centre before the centre's own, and
    common shingles last among the former.
    """
    late = led.sparkSession.sparkContext.broadcast(common)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_part(batches):
            n, d, a, out = [], [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, gone = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                m = in_bitmap(late.value, added)
                n.append(len(x))
                d.append(len(added) + len(gone))
                a.append(len(added))
                out.append(np.concatenate([added[~m], added[m], gone])[: rule.delta_prefix(len(x))].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["cls", "leader", "n", "d", "a", "delta"])

    x = led.join(centre, "leader").join(sets, "cls").select("cls", "leader", "members", "centre")
    return x.mapInArrow(compare, "cls bigint, leader bigint, n bigint, d bigint, a bigint, delta array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """cls and label (the smallest class reachable) for all ends of `edges` (a, b), by minimum labels with pointer jumping."""
    both = _stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = _stored(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"cls": "b", "label": "l"}), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = labels.join(near.withColumnRenamed("a", "cls"), "cls").select("cls", "label", F.least("label", "l").alias("low"))
        # jump: the label of the label is at least as low
        far = labels.select(F.col("cls").alias("low"), F.col("label").alias("far"))
        after = _stored(low.join(far, "low").select("cls", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")), "labels")
        moved = after.where("moved").limit(1).count()
        dropped(labels)
        labels = after.drop("moved")
        if not moved:
            dropped(both)
            return labels


ENTRIES = "h bigint, cls bigint, n bigint, place int, long boolean"


def index_lists(signed: DataFrame) -> DataFrame:
    """The inverted index over classes: h, cls, n, place and whether the list is long; nearly all lists of one are left out.

    Lists are counted first, by partial sums, and bitmaps of a fixed size tell the tasks that read the prefixes which
    elements have more than one entry, and which have many. So no list, however long, is gathered or sorted in one task.
    An element that shares a bit with a long list's counts as one too, which changes how its sets are compared, never which link.
    """
    classes = _stored(signed.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")
    counts = _stored(classes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    many = bitmap_of(counts, "h", BITMAP_BITS)
    long = bitmap_of(counts.where(F.col("length") > SHORT_LIST), "h", BITMAP_BITS)
    dropped(counts)
    shared = signed.sparkSession.sparkContext.broadcast((many, long))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, long = shared.value
        for b in _by_part(batches, 2048):
            sizes = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            h = b.column(2).flatten().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(in_bitmap(many, h))
            of = np.repeat(np.arange(len(sizes)), sizes)[kept]
            place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
            columns = [h[kept], b.column(0).to_numpy()[of], b.column(1).to_numpy()[of], place.astype(np.int32), in_bitmap(long, h[kept])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "cls", "n", "place", "long"])

    return classes.mapInArrow(entries, ENTRIES)


def size_block(n: Column, rule: Jaccard) -> Column:
    """Blocks of sizes, two from a size to the largest that it can link to."""
    return F.floor(F.log(n.cast("double")) * 2 / float(np.log(rule.den / rule.num)))


def meetings(short: DataFrame, rule: Jaccard) -> DataFrame:
    """Entries of one list, x and y, that may link: x looks into the blocks of sizes from its own up to the largest that its place leaves open."""
    largest = F.least(F.floor((F.col("n") - F.col("place")) * (rule.den + rule.num) / rule.num) - F.col("n"), F.floor(F.col("n") * rule.den / rule.num))
    x = short.withColumn("largest", largest).where("largest >= n")
    x = x.withColumn("block", F.explode(F.sequence(size_block(F.col("n"), rule), size_block(F.col("largest"), rule)))).alias("x")
    y = short.withColumn("block", size_block(F.col("n"), rule)).alias("y")
    c = lambda t, k: F.col(f"{t}.{k}")
    after = (c("x", "n") < c("y", "n")) | ((c("x", "n") == c("y", "n")) & (c("x", "cls") < c("y", "cls")))
    enough = (c("y", "n") <= c("x", "largest")) & (c("y", "n") - c("y", "place") >= rule.needed(c("x", "n"), c("y", "n")))
    return x.join(y, (c("x", "h") == c("y", "h")) & (c("x", "block") == c("y", "block")) & after & enough)


def short_pairs(lists: DataFrame, rule: Jaccard) -> DataFrame:
    """Pairs from short lists that their sizes, places and what their prefixes share leave open."""
    x = meetings(lists.where("not long"), rule)
    x = x.groupBy(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), F.least("x.n", "y.n").alias("n1"), F.greatest("x.n", "y.n").alias("n2")).agg(
        F.count("*").alias("seen"), F.min(F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))).alias("left"))
    # after the last common shingle of the prefixes at most `left` - 1 more can be shared; lists that are long are not counted in `seen`
    long = lists.where("long").groupBy("cls").agg(F.count("*").alias("more"))
    x = x.join(long.withColumnRenamed("cls", "a"), "a", "left")
    return x.where(F.col("seen") + F.coalesce("more", F.lit(0)) + F.col("left") - 1 >= rule.needed(F.col("n1"), F.col("n2"))).select("a", "b")


def long_lists(lists: DataFrame, rule: Jaccard) -> DataFrame:
    """The long lists with each entry's block of sizes and the leaders (smallest class) of its block and of the block below."""
    block = F.floor(F.log(F.col("n").cast("double")) / float(np.log(rule.den / rule.num)))
    big = lists.where("long").withColumn("block", block)
    lead = big.groupBy("h", "block").agg(F.min("cls").alias("leader"))
    below = lead.select("h", (F.col("block") + 1).alias("block"), F.col("leader").alias("leader_below"))
    return big.join(lead, ["h", "block"]).join(below, ["h", "block"], "left")


def led_sets(big: DataFrame) -> DataFrame:
    """(cls, leader): every set of a long list with the leaders of its block and of the block below."""
    return big.select("cls", F.explode(F.array("leader", "leader_below")).alias("leader")).where("leader is not null and leader != cls").distinct()


def open_pairs(moved: DataFrame, hubs: DataFrame, labels: DataFrame, rule: Jaccard) -> DataFrame:
    """All pairs of a group (leader, cls, n, d, a, delta), in different components, that their deltas leave open.

    Of any such pair one set at least is outside the component of the group's hub; only those look for partners. Deltas
    differ in all elements outside the centre that they don't share. So an element of the centre that both lack (they are
    common: a centre has few) brings two sets together only if all of those may differ; sets that share some of those meet
    there, before it in the order.
    """
    label = labels.select("cls", "label")
    home = hubs.join(label.withColumnRenamed("cls", "hub"), "hub", "left").select("leader", F.coalesce("label", "hub").alias("home"))
    x = moved.join(label, "cls", "left").withColumn("comp", F.coalesce("label", "cls")).drop("label").join(home, "leader").withColumn("out", F.col("comp") != F.col("home"))
    mixed = x.where("out").select("leader").distinct()
    x = _stored(x.join(mixed, "leader", "left_semi"), "open")
    index = x.select("leader", "cls", "n", "d", "a", "comp", "out", F.posexplode("delta").alias("place", "element"))
    close = F.col("d") <= F.floor((rule.den - rule.num) * F.col("n") / F.lit(float(rule.num)))  # others need shared elements whatever they meet
    index = index.unionByName(x.where(close).select("leader", "cls", "n", "d", "a", "comp", "out", F.lit(0).alias("place"), F.lit(NONE).cast("bigint").alias("element")))
    c = lambda t, k: F.col(f"{t}.{k}")
    may_differ = c("x", "n") + c("y", "n") - 2 * rule.needed(c("x", "n"), c("y", "n"))
    share = F.ceil((c("x", "d") + c("y", "d") - may_differ) / 2)
    outside, gone = F.least(c("x", "a") - c("x", "place"), c("y", "a") - c("y", "place")), F.least(c("x", "d") - c("x", "a"), c("y", "d") - c("y", "a"))
    left = F.when(outside > 0, outside + gone).otherwise(F.least(c("x", "d") - c("x", "place"), c("y", "d") - c("y", "place")))
    apart = (outside > 0) | (c("x", "a") + c("y", "a") <= may_differ)
    meets = F.when(c("x", "element") == NONE, share <= 0).otherwise((share > 0) & (left >= share) & apart)
    sizes = rule.num * F.greatest(c("x", "n"), c("y", "n")) <= rule.den * F.least(c("x", "n"), c("y", "n"))
    once = ~c("y", "out") | (c("x", "cls") < c("y", "cls"))
    met = index.where("out").alias("x").join(index.alias("y"), (c("x", "leader") == c("y", "leader")) & (c("x", "element") == c("y", "element")) & once & (c("x", "comp") != c("y", "comp")) & sizes & meets)
    met = met.groupBy("x.leader", F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), share.alias("share")).agg(F.count("*").alias("seen"), F.min(left).alias("left"))
    return met.where(F.col("seen") + F.col("left") - 1 >= F.col("share")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_links(led: DataFrame, edges: DataFrame, docs: DataFrame, rule: Jaccard, reps: DataFrame, common: np.ndarray) -> DataFrame:
    """`edges` with links that connect whatever the long lists' groups (cls, leader) connect."""
    classes = _stored(led.select("cls").union(led.select("leader")).distinct().join(reps, "cls"), "grouped")
    sets = _stored(fetch_sets(docs, rule, classes).dropDuplicates(["cls"]), "sets")
    near = _stored(compared(led.select(F.col("cls").alias("a"), F.col("leader").alias("b")), sets, rule), "near")
    edges = edges.union(near.where("linked").select("a", "b"))
    leaders = led.select("leader").distinct()
    kin = components(near.where("alike").join(leaders.withColumnRenamed("leader", "a"), "a", "left_semi").select("a", "b"))
    own = leaders.join(kin.withColumnRenamed("cls", "leader"), "leader", "left").select("leader", F.coalesce("label", "leader").alias("family"))
    group = near.select(F.col("a").alias("cls"), F.col("b").alias("leader"), "alike").union(leaders.select(F.col("leader").alias("cls"), "leader", F.lit(True)))
    group = _stored(group.join(own, "leader").groupBy("cls", F.col("family").alias("leader")).agg(F.max("alike").alias("alike")), "groups")
    moved = _stored(deltas(group.select("cls", "leader"), sets, centres(group, sets), rule, common), "moved")
    hubs = _stored(moved.groupBy("leader").agg(F.min_by("cls", F.struct("d", "cls")).alias("hub")), "hubs")
    spokes = moved.join(hubs, "leader").where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    edges = edges.union(_stored(compared(spokes, sets, rule).where("linked").select("a", "b"), "links"))
    more = _stored(open_pairs(moved, hubs, components(edges), rule), "pairs")
    edges = edges.union(_stored(compared(more, sets, rule).where("linked").select("a", "b"), "links"))
    dropped(sets)
    return edges


def _in_components(docs: DataFrame, rule: Jaccard) -> DataFrame:
    """doc_id, n, cls, component_id and kept of every row of `docs`: kept is the component's class to keep, the least of those with the least doc_id; rows without a set have none."""
    common = common_shingles(docs, rule)
    signed = _stored(signatures(docs, rule, common), "signatures")
    reps = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    lists = _stored(index_lists(signed), "lists")
    pairs = _stored(short_pairs(lists, rule), "pairs")
    paired = _stored(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(reps, "cls"), "paired")
    edges = _stored(compared(pairs, fetch_sets(docs, rule, paired), rule).where("linked").select("a", "b"), "links")
    led = _stored(led_sets(long_lists(lists, rule)), "led")
    if led.limit(1).count():
        edges = group_links(led, edges, docs, rule, reps, common)
    labels = components(edges)
    named = reps.join(labels, "cls", "left").withColumn("comp", F.coalesce("label", "cls"))
    first = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "cls")).getField("cls")
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"), first.alias("kept"))
    return signed.select("doc_id", "n", "cls").join(named.join(names, "comp").select("cls", "component_id", "kept"), "cls", "left")


def near_duplicates(docs: DataFrame, rule: Jaccard | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and set_class (the id of the row's set) of every row of `docs`.

    component_id is the smallest doc_id among the rows reachable by links. A null, empty or wordless text has an empty set,
    links with nothing and is its own component; a text with fewer words than a shingle has one element. Rows with a null
    doc_id take part and lend no id; a component without any id has a null one. Rows that share a doc_id are separate
    rows. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    out = _in_components(docs, rule or Jaccard())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("cls").alias("set_class"))


def _with_set(rows: DataFrame, rule: Jaccard) -> DataFrame:
    """`rows` with the class of each text's set as `set`."""
    def classes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Shingler(rule.words)
        for texts in parts:
            yield pa.array([_class_of(s) for at in range(0, len(texts), 256) for s in tool.sets(texts.slice(at, 256))], pa.int64())

    classes.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn("set", F.arrow_udf(classes, "bigint")("text"))


def one_of_each(docs: DataFrame, rule: Jaccard | None = None) -> DataFrame:
    """The rows of `docs` to keep, with all their columns: one of each component, a row with its smallest doc_id.

    Rows are judged by doc_id and set together, so rows that share an id, or have none, answer for their own components
    alone; of rows equal in both one stays. Of a component without any id one row stays. Rows without words all stay.
    """
    rule = rule or Jaccard()

    def judge() -> DataFrame:
        groups = _in_components(docs, rule).where("cls is not null").groupBy("doc_id", "cls").agg(F.first("kept").alias("kept"), F.first("component_id").alias("component_id"), F.count("*").alias("rows"))
        gone = (F.col("cls") != F.col("kept")) | ~F.col("doc_id").eqNullSafe(F.col("component_id"))
        return in_few_parts(groups.select("doc_id", "cls", gone.alias("gone"), "rows").where("gone or rows > 1"))

    judged = settled(judge, "judged")
    go = judged.where("gone").select(F.col("doc_id").alias("gone_id"), F.col("cls").alias("gone_set"))
    several = judged.where("not gone").select(F.col("doc_id").alias("several_id")).distinct()  # ids that kept rows share
    rows = docs.select(whole(docs), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))

    def kept(how: str) -> DataFrame:
        part = _with_set(rows.join(several, F.col("id").eqNullSafe(F.col("several_id")), how), rule)
        return part.join(go, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("set") == F.col("gone_set")), "left_anti")

    again = kept("left_semi").withColumn("wordless", F.when(F.col("set").isNull(), F.monotonically_increasing_id()))
    return kept("left_anti").select("row.*").unionByName(again.dropDuplicates(["id", "set", "wordless"]).select("row.*"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component, 4-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def oracle_sql(rule: Jaccard | None = None) -> str:
    """DuckDB SQL with the rows of op5_ngram_jaccard: all pairs that share a shingle, and all that each document reaches."""
    r = rule or Jaccard()
    lower = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE d AS (SELECT ROW_NUMBER() OVER () AS k, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i : i + {r.words - 1}], ' ') AS g FROM d, range(1, greatest(len(w) - {r.words - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1) t(i)),
n AS (SELECT k, COUNT(*) AS n FROM s GROUP BY 1),
shares AS (SELECT a.k AS a, b.k AS b, COUNT(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT a, b FROM shares JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE {r.den} * m >= {r.num} * (x.n + y.n - m)),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, COALESCE(ANY_VALUE(n.n), 0) AS n_shingles, MIN(o.doc_id) AS component_id FROM d LEFT JOIN n ON n.k = d.k JOIN reach ON reach.a = d.k JOIN d o ON o.k = reach.b GROUP BY d.k, d.doc_id"""
