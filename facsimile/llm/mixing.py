"""Mixing sources to target weights through a domain-language-source tree.

Every level of the tree shares its budget out among its children by weight. A
child can give at most ``max_epochs`` times the tokens below it; what it
cannot give goes to its siblings, by weight, and only if all of them are
exhausted does the rest go up, to the siblings of the parent. For children
with weight w and capacity c this is min(c, level * w), with the one level that
spends the budget; with children in the order of c / w it is the largest of

    (budget - capacity before) / (weight not before)

over the children, so each level of the tree is one window over its siblings.

A leaf with target T and A tokens is read T // A times whole. The partial epoch
takes the documents in a seeded order of that epoch (md5 of seed, epoch, id and
text digest) until T is reached: a document is taken if the tokens before it
are less than the target. The place where a leaf's order is cut is found by
digits of that digest: token sums of at most 256 digit pairs per leaf say which
pair holds the cut, the rows of that pair are split by the next pair, and so
on until few are left, which are put in order. No leaf is ever sorted whole,
however large it is.

Tokens of a document are its words and one end. Null level names count as the
name ``unknown``, null text as empty. Rows equal in id and text share their
place in an epoch and are taken together. Null ids are ordered by their text.
Weights that are not listed are 1, weights of 0 take nothing. An empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm.common import free_name, text_of, words_of, written

LEVELS = ("domain", "language", "origin")
FEW = 512  # documents that are put in order in one task

# Production parameters: the tree's weights by name, at each level; others are 1.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"crawl": 0.5, "curated": 0.5}, "language": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "origin": {}}
CRAWL = ["src0"]  # sources that belong to the domain crawl
BUDGET = 1.0  # tokens of the mixture for each token of the corpus
MAX_EPOCHS = 4
SEED = 7


def document_levels(lang_col: str = "lang", source_col: str = "source") -> dict[str, Column]:
    """The tree's level names of a document."""
    source = F.col(f"`{source_col}`")
    return {
        "domain": F.when(source.isin(CRAWL), "crawl").when(source.isNull(), "unknown").otherwise("curated"),
        "language": F.coalesce(F.col(f"`{lang_col}`"), F.lit("unknown")),
        "origin": F.coalesce(source, F.lit("unknown")),
    }


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, float(w)).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: float, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (levels, tokens) with each leaf's ``target`` in tokens."""
    out = leaves.withColumn("capacity", F.col("tokens") * float(max_epochs)).withColumn("budget", F.lit(float(total)))
    for depth, level in enumerate(LEVELS):
        parents, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        # A subtree of weight 0 gives nothing, so it has no capacity for its ancestors either.
        usable = F.lit(1.0)
        for below in LEVELS[depth:]:
            usable = usable * F.when(_weight(below, weights) > 0, 1.0).otherwise(0.0)
        nodes = out.groupBy(*path, "budget").agg(F.sum(F.col("capacity") * usable).alias("c")).withColumn("w", _weight(level, weights))
        first = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        order = first.orderBy((F.col("c") / F.when(F.col("w") > 0, F.col("w"))).asc_nulls_last(), level).rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
        level_at = (F.col("budget") - before("c")) / F.when(F.sum("w").over(first) - before("w") > 1e-12, F.sum("w").over(first) - before("w"))
        shared = nodes.withColumn("share", level_at).withColumn("share", F.max("share").over(first))
        given = shared.select(*path, F.greatest(F.lit(0.0), F.least("c", F.coalesce("share", F.lit(0.0)) * F.col("w"))).alias("budget"))
        out = out.drop("budget").join(given, path)
    return out.select(*LEVELS, "tokens", *[c for c in leaves.columns if c not in (*LEVELS, "tokens")], F.col("budget").alias("target"))


def _order_key(seed: int, epoch: Column, id_: Column, digest: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("")), digest).cast("binary"))


def _cuts(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Per leaf: whole epochs, and the last order key of the partial epoch (null: none)."""
    whole = F.floor(F.col("target") / F.col("tokens") + 1e-9).cast("bigint")
    state = leaves.select(*LEVELS, "docs", whole.alias("whole"), (F.col("target") - whole * F.col("tokens")).alias("left")).withColumn("prefix", F.lit(""))
    state = written(state, "leaves")
    largest = state.agg(F.max("docs")).first()[0] or 0
    keyed = written(
        rows.join(state.filter("left > 1e-6").select(*LEVELS, "whole"), list(LEVELS)).select(*LEVELS, "tokens", _order_key(seed, F.col("whole"), F.col("id"), F.col("digest")).alias("key")),
        "keys",
    )
    in_leaf = Window.partitionBy(*LEVELS)

    def step(parts: DataFrame, by: str) -> DataFrame:
        """The last part of each leaf that begins before the target."""
        running = parts.withColumn("before", F.col("running") - F.col("tokens"))
        return running.filter(F.col("before") < F.col("left") - 1e-6).groupBy(*LEVELS).agg(F.max_by(F.struct(by, "before"), by).alias("last"))

    open_ = state.filter("left > 1e-6")
    rounds = max(0, math.ceil(math.log(max(1, largest) / FEW, 256)))
    for n in range(1, rounds + 1):
        inside = keyed.join(open_.select(*LEVELS, "prefix", "left"), list(LEVELS)).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy(*LEVELS, "left", F.substring("key", 1, 2 * n).alias("part")).agg(F.sum("tokens").alias("tokens"))
        last = step(sums.withColumn("running", F.sum("tokens").over(in_leaf.orderBy("part"))), "part")
        open_ = written(open_.join(last, list(LEVELS)).select(*LEVELS, F.col("last.part").alias("prefix"), (F.col("left") - F.col("last.before")).alias("left")), "parts")
    inside = keyed.join(open_.select(*LEVELS, "prefix", "left"), list(LEVELS)).filter(F.col("key").startswith(F.col("prefix")))
    few = inside.groupBy(*LEVELS, "left", "key").agg(F.sum("tokens").alias("tokens"))
    last = step(few.withColumn("running", F.sum("tokens").over(in_leaf.orderBy("key"))), "key").select(*LEVELS, F.col("last.key").alias("last_key"))
    return written(state.select(*LEVELS, "whole").join(last, list(LEVELS), "left"), "cuts")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    levels: Mapping[str, Column] | None = None,
    weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
    carry: bool = True,
) -> DataFrame:
    """One row per document and epoch it is read in.

    With ``carry`` the columns of ``docs``, else (id, levels, tokens, target of
    the leaf, epoch). ``budget`` is the size of the mixture in tokens for each
    token of ``docs``.
    """
    levels = dict(levels or document_levels())
    digest = F.md5(text_of(text_col).cast("binary"))
    rows = written(
        docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), digest.alias("digest"), (F.size(words_of(text_of(text_col))) + 1).cast("bigint").alias("tokens"), *[levels[x].alias(x) for x in LEVELS]),
        "mix-rows",
    )
    leaves = written(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-leaves")
    total = budget * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    targets = written(budgets(leaves, total, weights, max_epochs), "targets")
    cuts = _cuts(rows, targets, seed)

    def times(id_: Column, text_digest: Column, whole: Column, last: Column) -> Column:
        """Epochs of a document, from 0."""
        partial = F.coalesce(_order_key(seed, whole, id_, text_digest) <= last, F.lit(False))
        n = whole + F.when(partial, 1).otherwise(0)
        return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))

    if not carry:
        joined = rows.join(cuts.join(targets.select(*LEVELS, "target"), list(LEVELS)), list(LEVELS))
        return joined.select("id", *LEVELS, "tokens", "target", F.explode(times(F.col("id"), F.col("digest"), F.col("whole"), F.col("last_key"))).alias("epoch"))
    names = {x: free_name(docs, f"_mix_{x}") for x in (*LEVELS, "whole", "last", "epoch")}
    cuts = cuts.select(*[F.col(x).alias(names[x]) for x in LEVELS], F.col("whole").alias(names["whole"]), F.col("last_key").alias(names["last"]))
    joined = docs.withColumns({names[x]: levels[x] for x in LEVELS}).join(cuts, [names[x] for x in LEVELS])
    epochs = times(F.col(f"`{id_col}`").cast("bigint"), digest, F.col(names["whole"]), F.col(names["last"]))
    return joined.withColumn(names["epoch"], F.explode(epochs)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sql() -> str:
    """The same rows in SQL, over the table documents."""

    def case(level):
        whens = " ".join(f"WHEN {level} = '{n}' THEN CAST({w} AS DOUBLE)" for n, w in WEIGHTS[level].items())
        return f"CASE {whens} ELSE 1.0 END" if whens else "CAST(1.0 AS DOUBLE)"

    crawl = ", ".join(f"'{s}'" for s in CRAWL)
    sql = f"""WITH r AS (
  SELECT doc_id AS id, md5(coalesce(text, '')) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS BIGINT) AS tokens,
    CASE WHEN source IN ({crawl}) THEN 'crawl' WHEN source IS NULL THEN 'unknown' ELSE 'curated' END AS domain,
    coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin FROM documents),
leaf AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL),
b0 AS (SELECT *, {BUDGET} * CAST((SELECT sum(tokens) FROM leaf) AS DOUBLE) AS budget FROM leaf)"""
    for depth, level in enumerate(LEVELS):
        path, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]) or "1"
        sql += f""",
n{depth} AS (SELECT {path}, budget, sum(tokens) * {float(MAX_EPOCHS)} AS c, {case(level)} AS w FROM b{depth} GROUP BY {path}, budget),
o{depth} AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY {parents} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  coalesce(sum(w) OVER (PARTITION BY {parents} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER (PARTITION BY {parents}) AS wa FROM n{depth}),
s{depth} AS (SELECT *, max((budget - cb) / (wa - wb)) OVER (PARTITION BY {parents}) AS share FROM o{depth}),
b{depth + 1} AS (SELECT t.domain, t.language, t.origin, t.tokens, least(s.c, s.share * s.w) AS budget FROM b{depth} t JOIN s{depth} s USING ({path}))"""
    return sql + f""",
t AS (SELECT domain, language, origin, budget AS target, CAST(floor(budget / tokens + 1e-9) AS BIGINT) AS whole, budget - floor(budget / tokens + 1e-9) * tokens AS part FROM b{len(LEVELS)}),
k AS (SELECT r.*, t.target, t.whole, t.part, md5('{SEED}|' || CAST(t.whole AS VARCHAR) || '|' || coalesce(CAST(r.id AS VARCHAR), '') || '|' || r.digest) AS key FROM r JOIN t USING (domain, language, origin)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY key) - tokens AS before FROM k),
e AS (SELECT *, whole + CASE WHEN before < part - 1e-6 THEN 1 ELSE 0 END AS n FROM p)
SELECT id AS doc_id, domain, language, origin, tokens, round(target, 3) AS target, unnest(range(n)) AS epoch FROM e WHERE n > 0"""
