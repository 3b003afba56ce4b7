"""Quality rules as a learned decision list.

``learn`` covers the labelled bad documents one rule at a time: a rule grows by
the threshold that gains most, is pruned on rows held out from growing, and is
kept only if it hardly ever hits a good document. ``verdict`` turns the list into one
ordered Spark conditional expression over the statistics of a text, which are
DataFrame expressions too. Learning alone reads a bounded sample of labelled
rows (``MAX_LABELLED``); statistics and verdicts cover every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpointed, read_table

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MAX_LABELLED = 20_000     # labelled rows that learning reads at most
CUTS = 48                 # candidate thresholds of a feature
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_COVERED = 5           # bad rows a rule must hit
MIN_PRECISION = 0.99      # share of bad rows among those that a rule hits

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. A text without equal windows, the
    usual case, is done after one pass; else windows are sorted with their
    places and the lengths of the places' union are added up.
    """
    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def same(x, k):
                return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(
                F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(let(ordered, places), start, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def statistics(text: Column) -> Column:
    """Struct of the five statistics (long) of a text; null counts as empty."""
    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        by_line = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
        return let(by_word, lambda w: F.struct(
            w["n"].cast("long").alias("n_words"),
            (F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            by_line.cast("long").alias("n_dup_lines"),
            w["r"].cast("long").alias("n_repeat_words")))
    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (
        F.lit(100) * s["n_repeat_words"] > F.lit(MAX_REPEAT_PERCENT) * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What thresholds are set on; all are defined for texts without words."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "symbols_per_word": s["n_symbols"] / n,
        "repeated_share": s["n_repeat_words"] / n,
        "dup_lines_per_100_words": s["n_dup_lines"] * 100.0 / n,
        "chars_per_word": s["word_chars"] / n,
        "n_words": s["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, sign, threshold); sign is '>' or '<='."""

    conditions: tuple[tuple[str, str, float], ...]

    def hits(self, row: dict[str, float]) -> bool:
        return all((row[f] > t) if sign == ">" else (row[f] <= t) for f, sign, t in self.conditions)

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, sign, t in self.conditions:
            out = out & ((of[f] > t) if sign == ">" else (of[f] <= t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {sign} {t:.6g}" for f, sign, t in self.conditions)


def _cuts(values: list[float]) -> list[float]:
    """Thresholds half way between neighbouring values, spread over the ranks."""
    distinct = sorted(set(values))
    step = max(1, len(distinct) // CUTS)
    return [(a + b) / 2 for a, b in zip(distinct[:-1:step], distinct[1::step])]


def _grow(rows: list[tuple[dict, bool]], names: list[str]) -> Rule:
    """Add the threshold of the largest FOIL gain until no good row is hit."""
    rule = Rule(())
    while len(rule.conditions) < MAX_CONDITIONS:
        bad = sum(b for _, b in rows)
        if not bad or bad == len(rows):
            break
        before, best = math.log2(bad / len(rows)), (0.0, None)
        for f in names:
            for t in _cuts([r[f] for r, _ in rows]):
                above = [b for r, b in rows if r[f] > t]
                for sign, p, n in ((">", sum(above), len(above)),
                                   ("<=", bad - sum(above), len(rows) - len(above))):
                    if p:
                        gain = p * (math.log2(p / n) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, sign, t))
        if best[1] is None:
            break
        rule = Rule((*rule.conditions, best[1]))
        rows = [x for x in rows if rule.hits(x[0])]
    return rule


def _counts(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[int, int]:
    hit = [b for r, b in rows if rule.hits(r)]
    return sum(hit), len(hit)


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> Rule:
    """Drop last conditions where that doesn't lower precision on held-out rows."""
    def worth(r: Rule) -> float:
        p, n = _counts(r, rows)
        return (p + 1) / (n + 2)
    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        short = Rule(rule.conditions[:k])
        if worth(short) >= worth(best):
            best = short
    return best


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Sequential covering over (features, is_bad) rows; two of three rows grow
    rules, the third prunes them. No rows, or rows of one kind: no rules."""
    if not rows:
        return []
    names = sorted(rows[0][0])
    left, rules = list(enumerate(rows)), []
    while len(rules) < MAX_RULES:
        grow, prune = [x for i, x in left if i % 3], [x for i, x in left if i % 3 == 0]
        rule = _grow(grow, names)
        if not rule.conditions:
            break
        rule = _prune(rule, prune)
        rest = [x for _, x in left]
        p, n = _counts(rule, rest)
        if p < MIN_COVERED or p < MIN_PRECISION * n:
            break
        rules.append(rule)
        left = [(i, x) for i, x in left if not rule.hits(x[0])]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from the labelled documents; at most ``max_labelled`` of them, by a
    hash of their id. Labels that are null or contradict each other don't count.
    Rows that the base rules reject teach nothing, as they go anyway."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad"))
    # bounded by max_labelled rows of two short columns; an id that repeats teaches once, by its least text
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(
        F.broadcast(sample), "_id").groupBy("_id", "_bad").agg(F.min("_t").alias("_t"))
    some = checkpointed(some.select("_id", "_bad", statistics(F.col("_t")).alias("_s")))
    of = features(F.col("_s"))
    got = some.where(~base_failed(F.col("_s"))).select(
        "_id", "_bad", *[c.alias(f) for f, c in of.items()]).collect()
    got = sorted(got, key=lambda r: tuple(r))
    return learn([({f: r[f] for f in of}, r["_bad"]) for r in got])


def verdict(rules: list[Rule], s: Column) -> Column:
    """What rejects a text: 'base', the first rule that hits, or null."""
    out, of = F.when(base_failed(s), F.lit("base")), features(s)
    for rule in rules:
        out = out.when(rule.column(of), F.lit(str(rule)))
    return out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, the five statistics, base_failed, kept and the rule that rejects.

    One row per row; other columns are ignored. Null, empty or blank texts have
    no words and fail the base rules.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), statistics(F.col(text_col)).alias("_s"))
    s = F.col("_s")
    rule = verdict(rules, s)
    return rows.select("doc_id", *[s[c].alias(c) for c in STATS], base_failed(s).alias("base_failed"),
                       rule.isNull().alias("kept"), rule.alias("rule"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, whole."""
    return docs.where(let(statistics(F.col(text_col)), lambda s: verdict(rules, s).isNull()))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, learn_rules(docs, read_table(spark, sf_dir, "labels")))
