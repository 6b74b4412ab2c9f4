"""Quality rules as a learned decision list (DataFrame functions only).

``text_statistics`` measures every whole text with column functions.
``fit_decision_list`` learns from labelled rows by sequential covering: a rule
is grown one threshold condition at a time by information gain on the growing
rows, pruned back to the prefix with the best (p - n) / (p + n) on the pruning
rows, and kept if it is precise there; the rows it covers are then set aside
and the next rule is grown. Where the best rule is not precise, the others are
tried; the list ends when none is precise and covers enough. Thresholds are quantiles of the labelled rows. The
counts behind each step are one aggregation over all labelled rows (no sample)
that returns at most features x thresholds rows. The list is applied as one
ordered CASE WHEN expression; a text that no rule covers is kept.

Null text counts as a text without words; it has zero statistics. Rows with
null or conflicting labels: null labels are left out, of several labels of an
id the smallest counts. Repeated rows and ids keep their rows. Without usable
labels the list is empty and only the base rule decides. Empty tables give
empty tables; columns of the input with clashing names are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import let, text_of, words_of, written

WINDOW = 8  # words in a repeated window
SYMBOLS = r"[^#*$%&|<>]+"  # everything but the counted symbols
QUANTILES = [0.001, 0.003, 0.01, 0.02, 0.04, 0.06, 0.08, *(k / 20 for k in range(2, 19)), 0.92, 0.94, 0.96, 0.98, 0.99, 0.997, 0.999]
FEATURES = ["symbol_rate", "word_length", "repeat_rate", "dup_line_rate", "variety", "letter_rate", "upper_rate", "words"]


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose digest occurs twice or more.

    Sorting (digest, place) puts equal windows side by side; the places that
    have an equal neighbour, sorted again, cover 8 words each less overlaps.
    """
    def places(s):
        same = F.transform(
            s,
            lambda x, i: F.when(((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]), x["at"]),
        )
        return F.sort_array(F.filter(same, lambda x: x.isNotNull()))

    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def covered(p):
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda a, b: a + b)

    return let(ranked, lambda s: let(places(s), covered)).cast("bigint")


def text_statistics(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the statistics of each text in a struct ``q``."""
    held = [c.alias(f"k{i}") for i, c in enumerate(keep)]
    base = docs.select(*held, text_of(text_col).alias("t"))
    words = base.withColumn("w", words_of(F.col("t"))).withColumn("n", F.size("w"))
    digest = F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    hashed = words.withColumn("h", F.when(F.col("n") >= WINDOW, digest)).withColumn("line", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.col("n").cast("bigint")
    repeated = F.size("h") > F.size(F.array_distinct("h"))
    counts = hashed.select(
        *[f"k{i}" for i in range(len(held))],
        n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        (F.size("line") - F.size(F.array_distinct("line"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeated, _repeat_words(F.col("h"))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("line").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.length(F.regexp_replace("t", r"[^\p{L}]+", "")).alias("n_letters"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("n_upper"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    fields = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("word_chars", "n_words").alias("word_length"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        # Distinct words on a logarithmic scale: long texts repeat words without being worse.
        F.when(F.col("n_words") > 1, F.log(F.col("n_distinct")) / F.log(F.col("n_words"))).otherwise(1.0).alias("variety"),
        rate("n_letters", "word_chars").alias("letter_rate"),
        rate("n_upper", "n_letters").alias("upper_rate"),
        F.col("n_words").cast("double").alias("words"),
    ]
    return counts.select(*[f"k{i}" for i in range(len(held))], F.struct(*fields).alias("q"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # the value is over the threshold, else at most the threshold
    threshold: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions that rejects a text, with its counts."""

    conditions: tuple[Condition, ...]
    rejected: int  # pruning rows of label 0 it covered
    wrong: int  # pruning rows of label 1 it covered

    def column(self, stats: str) -> Column:
        out = self.conditions[0].column(stats)
        for c in self.conditions[1:]:
            out = out & c.column(stats)
        return out


def thresholds(labelled: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """The distinct quantiles of each statistic over the labelled rows."""
    row = labelled.agg(*[F.percentile_approx(f"q.{f}", QUANTILES, 10_000).alias(f) for f in features]).first()
    return {f: [float(c) for c in sorted(set(row[f] or []))] for f in features}


def for_pruning(id_col: Column) -> Column:
    """Whether a row takes part in the pruning and not in the growing of rules."""
    return F.pmod(F.xxhash64(F.lit("prune"), id_col), F.lit(3)) == 0


def fit_decision_list(labelled: DataFrame, features: list[str] = FEATURES, max_conditions: int = 4, min_precision: float = 0.97, min_covered: int = 8, min_share: float = 0.005) -> list[Rule]:
    """Ordered rejecting rules from rows (id, label, q).

    ``label`` 1 is good, 0 is bad. A third of the ids (by hash) is the pruning
    part. A rule covers at least ``min_covered`` bad rows of the growing part and
    the share ``min_share`` of them, and has ``min_precision`` on both parts
    together. A grown rule that is not precise sets its first condition's
    statistic and direction aside until the next rule is found (a narrower
    condition on them can still be its second one), and the list ends when none
    of the others gives a rule.
    """
    cuts = thresholds(labelled, features)
    if not any(cuts.values()):
        return []

    def bin_of(f):  # number of thresholds below the value
        value = F.col(f"q.{f}")
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]).cast("array<double>"), lambda c: c < value)).cast("short").alias(f)

    part = F.when(for_pruning(F.col("id")), "p").otherwise("g")
    rows = written(labelled.select("label", part.alias("part"), *[bin_of(f) for f in features]), "labelled")
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("bin")) for i, f in enumerate(features)])
    tally = [F.count(F.when((F.col("part") == p) & (F.col("label") == y), 1)).alias(f"{p}{y}") for p in "gp" for y in (0, 1)]

    def holds(rule):
        out = F.lit(True)
        for f, above, k in rule:
            out = out & ((F.col(features[f]) > k) if above else (F.col(features[f]) <= k))
        return out

    def histogram(left, rule) -> dict[int, dict[int, list[int]]]:
        """Growing and pruning rows by label, for each statistic and bin, of the rows left that the rule covers."""
        out: dict[int, dict[int, list[int]]] = {}
        for r in rows.filter(left & holds(rule)).select("label", "part", F.inline(cells)).groupBy("f", "bin").agg(*tally).collect():
            out.setdefault(r.f, {})[r.bin] = [r.g0, r.g1, r.p0, r.p1]
        return out

    def best_condition(by, total, aside):
        """(gain, condition, its counts) of the condition with most information gain."""
        before = math.log2(total[0] / (total[0] + total[1]))
        best = (0.0, None, None)
        for f, hist in sorted(by.items()):
            low = [0, 0, 0, 0]
            for k in range(len(cuts[features[f]])):
                low = [a + b for a, b in zip(low, hist.get(k, (0, 0, 0, 0)))]
                for above in (False, True):
                    c = [t - a for t, a in zip(total, low)] if above else low
                    if (f, above) not in aside and c[0] >= least and c[0] + c[1] < total[0] + total[1]:
                        gain = c[0] * (math.log2(c[0] / (c[0] + c[1])) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, above, k), list(c))
        return best

    def grow(left, first, aside):
        """Conditions in order, and the counts [g0, g1, p0, p1] after each."""
        rule, counts, by = [], [], first
        while len(rule) < max_conditions and by:
            total = [sum(v[k] for v in by[0].values()) for k in range(4)]
            if total[0] < least or total[1] == 0:
                break
            _, condition, c = best_condition(by, total, aside if not rule else ())
            if condition is None:
                break
            rule.append(condition)
            counts.append(c)
            if c[1] == 0:
                break
            by = histogram(left, rule) if len(rule) < max_conditions else {}
        return rule, counts

    def pruned(counts) -> int | None:
        """Number of conditions to keep: the best prefix on the pruning rows, else the shortest precise one."""
        worth = lambda c: (c[2] - c[3]) / max(1, c[2] + c[3])
        precise = lambda c: (c[0] + c[2]) / max(1, sum(c)) >= min_precision and c[2] >= c[3]
        keep = max(range(len(counts)), key=lambda i: (worth(counts[i]), -i))
        return keep + 1 if precise(counts[keep]) else next((i + 1 for i, c in enumerate(counts) if precise(c)), None)

    rules: list[Rule] = []
    left = F.lit(True)
    first = histogram(left, [])
    bad = sum(v[0] for v in first[0].values()) if first else 0
    least = max(min_covered, math.ceil(min_share * bad))
    aside: set[tuple[int, bool]] = set()
    while True:
        rule, counts = grow(left, first, aside)
        if not rule:
            return rules
        keep = pruned(counts)
        if keep is None:
            aside.add(rule[0][:2])
            continue
        rules.append(Rule(tuple(Condition(features[f], above, cuts[features[f]][k]) for f, above, k in rule[:keep]), counts[keep - 1][2], counts[keep - 1][3]))
        left = left & ~holds(rule[:keep])
        first, aside = histogram(left, []), set()


def verdict(rules: list[Rule], stats: str = "q") -> Column:
    """The list as an ordered conditional: number of the rejecting rule, or 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = (F.when if out is None else out.when)(rule.column(stats), i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_rows(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(id, label, q) of the rows of ``stats`` (k0 is the id) that have a label."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    return stats.join(usable.groupBy("id").agg(F.min("label").alias("label")), F.col("k0") == F.col("id")).select("id", "label", "q")


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(id, statistics struct ``q``, rule, kept) of every document, and the list."""
    stats = written(text_statistics(docs, [F.col(f"`{id_col}`").cast("bigint")], text_col), "statistics")
    rules = fit_decision_list(labelled_rows(stats, labels))
    judged = stats.select(F.col("k0").alias("id"), "q", verdict(rules).alias("rule"))
    return judged.withColumn("kept", ~F.col("q.base_failed") & (F.col("rule") == 0)), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rule nor the list rejects.

    The texts are measured twice, once for the fit and once in the pass that
    filters, so that they are neither shuffled nor written.
    """
    _, rules = assess(docs, labels, id_col, text_col)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = text_statistics(docs, [whole], text_col)
    # Not a filter: that would be pushed below the statistics, which would then be computed many times over.
    good = ~F.col("q.base_failed") & (verdict(rules) == 0)
    return judged.select(F.inline(F.when(good, F.array("k0"))))
