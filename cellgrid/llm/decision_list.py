"""Quality rules as learned decision lists.

Statistics of each text are plain Spark expressions. Sequential covering learns from labelled rows: a rule for low quality
grows condition by condition (the threshold with the best FOIL gain), is pruned on rows set aside, and the rows it covers
leave; it goes on while new rules stay precise. The outcome is an ordered list of threshold conjunctions, emitted as one
Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, table, words

#: The learner reads about this many labelled rows at most, those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
MAX_RULES = 8
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5

#: Inputs of the rules: each is a share or a mean, so that they don't depend on a text's length.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "symbols_per_char": "n_symbols / word_chars",
    "chars_per_word": "word_chars / n_words",
    "repeat_share": "n_repeat_words / n_words",
    "dup_lines_per_word": "n_dup_lines / n_words",
    "upper_share": "n_upper / word_chars",
    "bangs_per_word": "n_bangs / n_words",
    "digit_share": "n_digits / word_chars",
    "distinct_share": "n_distinct / n_words",
}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(w: Column) -> Column:
    """Words of `w` (an array) that lie in a 3-word window found twice or more in it, the first one included.

    Windows are compared by a 64-bit hash; those with a hash in common are found by sorting (hash, place) pairs, and a
    word in several such windows counts once.
    """
    def count(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - 3)
        hashes = F.transform(places, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(_let(_repeated(hs), _covered)))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(w, count)).cast("bigint")


def _repeated(hs: Column) -> Column:
    pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))


def _covered(places: Column) -> Column:
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of `docs`; null and empty texts have zeros."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", F.explode(F.array(words(F.col("text")))).alias("w"))  # a generator's output is computed once
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    return d.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        (F.length("text") - n(r"[\x20\x09-\x0D]")).cast("bigint").alias("word_chars"),
        n(r"[#*$%&|<>]").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        n(r"\p{Lu}").alias("n_upper"),
        n(r"!").alias("n_bangs"),
        n(r"[0-9]").alias("n_digits"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
    )


def features() -> dict[str, Column]:
    """Each feature as an expression over the statistics; without words all are 0."""
    return {k: F.when(F.col("n_words") > 0, F.expr(f"CAST({sql} AS DOUBLE)")).otherwise(0.0) for k, sql in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    """feature >= threshold if `above`, else feature < threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = features()[self.feature]
        return f >= self.threshold if self.above else f < self.threshold

    def rows(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold


Rule = tuple[Condition, ...]


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], bins: int = 48) -> list[Rule]:
    """Ordered rules that find the rows of `bad` (booleans) among the rows of `x`; without both kinds of rows, none."""
    grow, prune = np.arange(len(x)) % 3 != 2, np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    cuts = {n: np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1))[1:-1]) for k, n in enumerate(names)} if len(x) else {}

    def covered(rule: Rule) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in rule:
            out &= c.rows(x, names)
        return out

    def precision(rule: Rule, among: np.ndarray) -> tuple[float, int]:
        n = covered(rule) & among
        return (bad[n].sum() + 1) / (n.sum() + 2), int(bad[n].sum())

    while len(rules) < MAX_RULES and (bad & left & grow).any():
        inside, rule = left & grow, ()
        while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
            p0, n0 = int((bad & inside).sum()), int(inside.sum())
            best = (0.0, None)
            for k, name in enumerate(names):
                v = x[inside, k]
                for t in cuts[name]:
                    for above in (True, False):
                        m = v >= t if above else v < t
                        p, n = int(bad[inside][m].sum()), int(m.sum())
                        if p >= MIN_COVER and n < n0:
                            gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                            best = max(best, (gain, (name, above, float(t))), key=lambda b: b[0])
            if best[1] is None:
                break
            rule += (Condition(*best[1]),)
            inside &= rule[-1].rows(x, names)
        held = left & prune
        while len(rule) > 1 and precision(rule[:-1], held)[0] >= precision(rule, held)[0]:
            rule = rule[:-1]
        if not rule or precision(rule, left)[0] < MIN_PRECISION or precision(rule, left)[1] < MIN_COVER:
            break
        rules.append(rule)
        left &= ~covered(rule)
    return rules


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, bad) of the labelled sample, one row for each id; rows without doc_id or quality don't count, of repeated labels the lowest does, and of rows that share an id those with the least features."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = hash_sample(chosen, "doc_id", sample_rows)
    x = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id")
    x = x.select("doc_id", "quality", F.struct(*[v.alias(k) for k, v in features().items()]).alias("x"))
    rows = x.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("doc_id", "quality", "x.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    values = np.array([list(r)[2:] for r in rows], float).reshape(-1, len(FEATURES))
    return values, np.array([r.quality == 0 for r in rows], bool)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number (from 1) of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        holds = F.lit(True)
        for c in rules[k - 1]:
            holds &= c.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def judge_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics, base_failed, rule and kept for every row of `docs`.

    base_failed: under 50 words, or more than half of them repeated. kept: false if base_failed, else whether no learned
    rule holds. Null and empty texts fail the base; null and repeated doc_ids are kept, one row each; without labels there
    are no rules. One pass over the texts and no shuffle of them.
    """
    rules = learn_rules(*labelled_features(docs, labels, sample_rows), list(FEATURES))
    s = statistics(docs)
    s = s.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    x = judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
