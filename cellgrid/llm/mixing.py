"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domains, languages and sources. At each node it is divided among the children by weight;
a child that cannot use its share (tokens times the epochs allowed) takes what it can, and the shortage goes to its siblings
by weight; what all siblings together cannot use was never given to their parent, since a node's capacity is the sum of its
leaves', so ancestors' siblings receive it. A leaf reads its documents in seeded epochs, each in an order of its own, and
takes the prefix of exactly its budget: some full epochs, then a prefix of the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_few_parts, settled, table, whole, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Weights are positive integers, given as SQL over the level's own key; domain_sql derives the domain from the source."""

    domain_sql: str = "CASE WHEN regexp_like(source, '[0-9]$') THEN concat('domain', CAST(CAST(substr(source, length(source), 1) AS INT) % 4 AS STRING)) ELSE 'other' END"
    domain_weight_sql: str = "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END"
    lang_weight_sql: str = "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"
    source_weight_sql: str = "1 + length(source) % 2"
    #: Share of the corpus's tokens to draw, in percent, and how often a document may be used.
    budget_percent: int = 100
    max_epochs: int = 4
    seed: str = "mix-1"


def water_fill(nodes: DataFrame, parents: list[str], budget: str, cap: str, weight: str, name: str, out: str) -> DataFrame:
    """Divides each parent's `budget` among its nodes by weight, none above its `cap`, all integers, adding up exactly.

    Nodes are taken in order of cap/weight. While a node's cap is below its weighted share of what is left, it is filled;
    the others share the rest by weight, rounded down, and the tokens lost by rounding go one each to the first of them.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col(cap) / F.col(weight), name)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = nodes.withColumn("_before", F.sum(cap).over(upto) - F.col(cap)).withColumn("_from", F.sum(weight).over(by) - F.sum(weight).over(upto) + F.col(weight))
    x = x.withColumn("_full", F.col(cap) * F.col("_from") <= (F.col(budget) - F.col("_before")) * F.col(weight))
    left = F.col(budget) - F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0)).over(by)
    x = x.withColumn("_left", left).withColumn("_share", F.sum(F.when(F.col("_full"), 0).otherwise(F.col(weight))).over(by))
    x = x.withColumn("_part", F.when(F.col("_full"), F.col(cap)).otherwise(F.expr(f"(_left * {weight}) div _share")))
    x = x.withColumn("_odd", F.col(budget) - F.sum("_part").over(by)).withColumn("_nth", F.row_number().over(by.orderBy("_full", F.col(cap) / F.col(weight), name)))
    x = x.withColumn(out, F.col("_part") + F.when(~F.col("_full") & (F.col("_nth") <= F.col("_odd")), 1).otherwise(0))
    return x.drop("_before", "_from", "_full", "_left", "_share", "_part", "_odd", "_nth")


def leaf_budgets(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """Each leaf (domain, lang, source, leaf_tokens) with its budget, full epochs and the tokens of its last, partial epoch."""
    w = {"domain": mix.domain_weight_sql, "lang": mix.lang_weight_sql, "source": mix.source_weight_sql}
    x = leaves.where("leaf_tokens > 0").withColumn("cap3", F.col("leaf_tokens") * mix.max_epochs)
    x = x.select("*", *[F.expr(f"CAST({sql} AS BIGINT)").alias(f"w_{k}") for k, sql in w.items()])
    langs = x.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap3").alias("cap2"), F.sum("leaf_tokens").alias("tokens2"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("cap2").alias("cap1"), F.sum("tokens2").alias("tokens1"))
    top = Window.partitionBy(F.lit(0))
    domains = domains.withColumn("budget0", F.least(F.expr(f"(sum(tokens1) over (partition by 0) * {mix.budget_percent}) div 100"), F.sum("cap1").over(top)))
    domains = water_fill(domains, [], "budget0", "cap1", "w_domain", "domain", "budget1")
    langs = water_fill(langs.join(domains.select("domain", "budget1"), "domain"), ["domain"], "budget1", "cap2", "w_lang", "lang", "budget2")
    x = water_fill(x.join(langs.select("domain", "lang", "budget2"), ["domain", "lang"]), ["domain", "lang"], "budget2", "cap3", "w_source", "source", "leaf_budget")
    return x.select(*LEVELS, "leaf_tokens", "leaf_budget", F.expr("leaf_budget div leaf_tokens").alias("full_epochs"), (F.col("leaf_budget") % F.col("leaf_tokens")).alias("rest"))


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def _tokens(docs: DataFrame, *own: Column) -> DataFrame:
    """A number n of each row, doc_id, domain, lang, source and tokens, besides the columns `own`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    leaf = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*own, F.monotonically_increasing_id().alias("n"), F.col("doc_id").cast("bigint").alias("doc_id"), *leaf, tokens.alias("tokens"))


def _turn(mix: Mixture) -> Column:
    """Where a document comes in the leaf's last epoch."""
    return _md5(mix.seed, F.col("full_epochs").cast("string"), "doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _taken(tokens: DataFrame, mix: Mixture) -> DataFrame:
    """The rows of the written table `tokens` (n, doc_id, lang, source, tokens) that the budget draws, with what it takes of each.

    A leaf's documents are ordered with those of all leaves by ranges, ties by the row's number, and written; tokens are
    added up range by range, and a range starts where the ranges before it end. So no task orders a whole leaf, and no id,
    be it that of a third of all rows, is ordered in one task.
    """
    d = tokens.where("tokens > 0").withColumn("domain", F.expr(mix.domain_sql))
    leaves = leaf_budgets(d.groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens")), mix).where("leaf_budget > 0")
    x = d.join(leaves.drop("leaf_tokens"), list(LEVELS)).withColumn("turn", _turn(mix))
    x = written(x.repartitionByRange(*LEVELS, "turn", "tokens", "n").withColumn("part", F.spark_partition_id()), "turns")
    by = [*LEVELS, "part"]
    before = F.sum("part_tokens").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("part_tokens")
    parts = x.groupBy(*by).agg(F.sum("tokens").alias("part_tokens")).select(*by, before.alias("before"))
    upto = F.sum("tokens").over(Window.partitionBy(*by).orderBy("turn", "tokens", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.join(parts, by).withColumn("start", F.col("before") + upto - F.col("tokens"))
    x = x.withColumn("last_take", F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("start"))))
    return x.withColumn("taken", F.col("full_epochs") * F.col("tokens") + F.col("last_take")).where("taken > 0")


def mix_documents(docs: DataFrame, mix: Mixture | None = None) -> DataFrame:
    """The documents that the budget draws, one row each: doc_id, its leaf, tokens, full_epochs, last_take and taken.

    A token is a word. `taken` is full_epochs times the tokens, plus last_take: what the prefix of the leaf's last epoch
    reads of the document (the one that crosses the budget's end is read in part). In an epoch, a leaf's documents come in
    an order by a hash of doc_id, seeded by the epoch. A null lang or source counts as the empty string; documents
    without words (null and empty texts) take no budget and are not drawn; null doc_ids count as one id; repeated rows are
    drawn one by one. An empty table gives no rows.
    """
    x = _taken(written(_tokens(docs), "tokens"), mix or Mixture())  # the texts are read once
    return x.select("doc_id", *LEVELS, "tokens", "full_epochs", "last_take", "taken", "leaf_budget")


def drawn(docs: DataFrame, mix: Mixture | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, that the budget draws, be it in part: row by row, whatever their ids.

    What is drawn of a leaf is a prefix of its order, so each leaf's last drawn row tells for every row whether it is drawn.
    There is one such row a leaf, and they are written first, so that Spark sees whether they may be broadcast; then no text is
    shuffled.
    """
    mix = mix or Mixture()
    rows = written(in_few_parts(_tokens(docs, whole(docs))), "rows")
    place = lambda: F.struct("turn", "tokens", "n")

    def ends() -> DataFrame:
        return in_few_parts(_taken(rows.drop("row"), mix).groupBy(*LEVELS, "full_epochs").agg(F.max(place()).alias("last")))

    last = settled(ends, "last-drawn")
    x = rows.where("tokens > 0").withColumn("domain", F.expr(mix.domain_sql)).join(last, list(LEVELS)).withColumn("turn", _turn(mix))
    return x.where(place() <= F.col("last")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and the tokens of each that the default mixture draws."""
    return mix_documents(table(spark, sf_dir, "documents"))


def _fill_sql(source: str, parents: str, budget: str, cap: str, weight: str, name: str, out: str) -> str:
    by = f"PARTITION BY {parents}" if parents else "PARTITION BY 0"
    return f"""(SELECT * EXCLUDE (f_before, f_from, f_full, f_left, f_share, f_part, f_odd, f_nth), f_part + CASE WHEN NOT f_full AND f_nth <= f_odd THEN 1 ELSE 0 END AS {out} FROM
 (SELECT *, {budget} - SUM(f_part) OVER ({by}) AS f_odd, ROW_NUMBER() OVER ({by} ORDER BY f_full, {cap} / {weight}, {name}) AS f_nth FROM
 (SELECT *, CASE WHEN f_full THEN {cap} ELSE (f_left * {weight}) // NULLIF(f_share, 0) END AS f_part FROM
 (SELECT *, {budget} - SUM(CASE WHEN f_full THEN {cap} ELSE 0 END) OVER ({by}) AS f_left, SUM(CASE WHEN f_full THEN 0 ELSE {weight} END) OVER ({by}) AS f_share FROM
 (SELECT *, {cap} * f_from <= ({budget} - f_before) * {weight} AS f_full FROM
 (SELECT *, SUM({cap}) OVER ({by} ORDER BY {cap} / {weight}, {name} ROWS UNBOUNDED PRECEDING) - {cap} AS f_before,
  SUM({weight}) OVER ({by} ORDER BY {cap} / {weight}, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f_from FROM {source}))))))"""


def oracle_sql(mix: Mixture | None = None) -> str:
    """DuckDB SQL with the rows of op1_mixing, up to the size of the types."""
    m = mix or Mixture()
    domain = m.domain_sql.replace("regexp_like", "regexp_matches").replace("AS STRING", "AS VARCHAR")
    weights = {k: v for k, v in (("domain", m.domain_weight_sql), ("lang", m.lang_weight_sql), ("source", m.source_weight_sql))}
    return f"""WITH d0 AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
d AS (SELECT *, {domain} AS domain, COALESCE(CAST(doc_id AS VARCHAR), '') AS k FROM d0 WHERE tokens > 0),
leaves AS (SELECT *, leaf_tokens * {m.max_epochs} AS cap3, CAST({weights["domain"]} AS BIGINT) AS w_domain, CAST({weights["lang"]} AS BIGINT) AS w_lang, CAST({weights["source"]} AS BIGINT) AS w_source
  FROM (SELECT domain, lang, source, SUM(tokens) AS leaf_tokens FROM d GROUP BY ALL)),
langs AS (SELECT domain, lang, w_domain, w_lang, SUM(cap3) AS cap2, SUM(leaf_tokens) AS tokens2 FROM leaves GROUP BY ALL),
doms0 AS (SELECT domain, w_domain, SUM(cap2) AS cap1, SUM(tokens2) AS tokens1 FROM langs GROUP BY ALL),
doms1 AS (SELECT *, LEAST(SUM(tokens1) OVER () * {m.budget_percent} // 100, SUM(cap1) OVER ()) AS budget0 FROM doms0),
doms AS (SELECT * FROM {_fill_sql("doms1", "", "budget0", "cap1", "w_domain", "domain", "budget1")}),
langs1 AS (SELECT langs.*, budget1 FROM langs JOIN doms USING (domain)),
langs2 AS (SELECT * FROM {_fill_sql("langs1", "domain", "budget1", "cap2", "w_lang", "lang", "budget2")}),
leaves1 AS (SELECT leaves.*, budget2 FROM leaves JOIN langs2 USING (domain, lang)),
leaves2 AS (SELECT *, leaf_budget // leaf_tokens AS full_epochs, leaf_budget % leaf_tokens AS rest FROM {_fill_sql("leaves1", "domain, lang", "budget2", "cap3", "w_source", "source", "leaf_budget")}),
x AS (SELECT d.*, full_epochs, rest, leaf_budget, SUM(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{m.seed}:' || CAST(full_epochs AS VARCHAR) || ':doc:' || k), tokens ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM d JOIN leaves2 USING (domain, lang, source)),
y AS (SELECT *, GREATEST(0, LEAST(tokens, rest - start)) AS last_take FROM x)
SELECT doc_id, domain, lang, source, tokens, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(last_take AS BIGINT) AS last_take,
  CAST(full_epochs * tokens + last_take AS BIGINT) AS taken, CAST(leaf_budget AS BIGINT) AS leaf_budget FROM y WHERE full_epochs * tokens + last_take > 0"""
