"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

Every text gets a row of statistics. From labelled rows, rules are learned one after the other: conditions (a
statistic at or beyond a threshold) are added while they raise the information gain on two thirds of the rows
(growing), and dropped again where that helps on the last third (pruning). A rule must be nearly pure to enter the
list; the rows it covers are set aside and the next rule is learned from the others. Only counts per statistic,
quantile bin and label come to the driver. What no rule rejects is kept.

All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.text import all_columns, id_column, own_name
from tabsight.sources.files import materialised

# fixed values
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"

BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5

FEATURES = ("n_words", "word_length", "symbols_per_word", "exclaims_per_word", "pipes_per_word", "upper_share", "dup_line_share",
            "repeat_share", "distinct_share", "words_per_line")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str = "") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the FEATURES) of every whole text.

    ``carry`` names a column to take along, for instance a struct of all columns. A null text counts as empty. Three-word windows are compared by 96-bit hash within their text.
    """
    text = F.col("__text")
    keys = [id_col, *[carry] * bool(carry)]
    d = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.withColumn("__words", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, _SPACE, " " * len(_SPACE)))) > 0))
    word = lambda i: F.get("__words", i)
    at = F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("__grams", F.transform(at, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    sort = F.sort_array(F.transform(at, lambda i: F.struct(F.get("__grams", i).alias("g"), F.hash(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i"))))
    d = d.withColumn("__sorted", F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), sort))
    same = lambda x, y: (x["g"] == y["g"]) & (x["h"] == y["h"])
    near = F.filter("__sorted", lambda x, k: F.coalesce(same(x, F.get("__sorted", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("__sorted", k + 1)), F.lit(False)))
    d = d.withColumn("__first", F.transform(near, lambda x: x["i"]))
    d = d.withColumn("__hit", F.array_distinct(F.concat("__first", F.transform("__first", lambda i: i + 1), F.transform("__first", lambda i: i + 2))))
    without = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    n_words = F.size("__words")
    d = d.select(
        *keys, n_words.cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("__first").isNotNull(), F.size("__hit")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"), F.size(F.array_distinct("__words")).alias("__distinct"), without("!").alias("__exclaims"),
        without("|").alias("__pipes"), (F.length(text) - F.length(F.translate(text, _UPPER, ""))).alias("__uppers"))
    per = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    return d.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", per("word_chars", "n_words").alias("word_length"),
        per("n_symbols", "n_words").alias("symbols_per_word"), per("__exclaims", "n_words").alias("exclaims_per_word"), per("__pipes", "n_words").alias("pipes_per_word"),
        per("__uppers", "word_chars").alias("upper_share"), per("n_dup_lines", "__n_lines").alias("dup_line_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"), per("__distinct", "n_words").alias("distinct_share"), per("n_words", "__n_lines").alias("words_per_line"))


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True, order=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1; null where none does (the text is kept)."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(covers(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def learn(labelled: DataFrame, label: str, key: str, features: tuple[str, ...] = FEATURES, bins: int = BINS, max_rules: int = MAX_RULES,
          max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Rules for rows of label 0, learned from statistics with a label of 0 or 1; rows without a label are left out.

    Without rows of both labels there are no rules. Thresholds are quantiles of the statistics of label 0.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(key, F.col(label).alias("__y"), *features)
    rows = materialised(rows.withColumn("__prune", F.pmod(F.xxhash64(key), F.lit(3)) == 0))
    share = [k / bins for k in range(bins + 1)]
    got = rows.filter("__y = 0").agg(*(F.percentile_approx(f, share, 10_000).alias(f) for f in features)).first()
    if got[features[0]] is None:
        return []
    edges = {f: sorted(set(map(float, got[f]))) for f in features}
    rows = materialised(rows.withColumns({f"__bin_{f}": _place(f, edges[f]) for f in features}))
    place = [F.struct(F.lit(f).alias("f"), F.col(f"__bin_{f}").alias("b")) for f in features]
    rules: list[Rule] = []
    while len(rules) < max_rules:
        open_rows = rows.filter(~covers_any(rules)) if rules else rows
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = _counts(open_rows.filter(~F.col("__prune")).filter(covers(rule)), place)
            best = _best(counts, edges, rule)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        rule = _pruned(open_rows.filter("__prune"), rule)
        bad, good = _covered(open_rows, [rule])[0]
        if bad < min_cover or (bad + 1) / (bad + good + 2) < min_precision:
            break
        rules.append(rule)
    return rules


def covers_any(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | covers(rule)
    return out


def _place(feature: str, edges: list[float]) -> Column:
    """The number of edges below a value, doubled, plus one at an edge: conditions in both directions read off it."""
    cuts = F.array(*(F.lit(e) for e in edges))
    return (2 * F.size(F.filter(cuts, lambda e: e < F.col(feature))) + F.array_contains(cuts, F.col(feature).cast("double")).cast("int")).cast("int")


def _counts(rows: DataFrame, place: list[Column]) -> dict[str, dict[int, list[int]]]:
    """Rows of label 0 and 1 per statistic and bin; at most two bins per edge come to the driver."""
    cells = rows.select("__y", F.explode(F.array(*place)).alias("c")).groupBy("c.f", "c.b", "__y").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, dict[int, list[int]]] = {}
    for r in cells.collect():
        out.setdefault(r["f"], {}).setdefault(r["b"], [0, 0])[r["__y"]] = r["n"]
    return out


def _best(counts: dict[str, dict[int, list[int]]], edges: dict[str, list[float]], rule: Rule) -> Condition | None:
    """The condition with the largest information gain; None where none gains."""
    found: list[tuple[float, Condition]] = []
    for f in sorted(counts):
        bad0, good0 = (sum(n[y] for n in counts[f].values()) for y in (0, 1))
        if not bad0 or not good0:
            return None
        for k, e in enumerate(edges[f]):
            for at_least in (True, False):
                inside = [n for b, n in counts[f].items() if (b >= 2 * k + 1 if at_least else b <= 2 * k + 1)]
                bad, good = sum(n[0] for n in inside), sum(n[1] for n in inside)
                if bad and bad + good < bad0 + good0:
                    gain = bad * (log2(bad / (bad + good)) - log2(bad0 / (bad0 + good0)))
                    if gain > 1e-9:
                        found.append((gain, Condition(f, at_least, e)))
    if not found:
        return None
    top = max(g for g, _ in found)
    return min(c for g, c in found if g >= top - 1e-9)


def _covered(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    row = rows.agg(*(F.count_if(covers(r) & (F.col("__y") == y)).alias(f"c{i}_{y}") for i, r in enumerate(rules) for y in (0, 1))).first()
    return [(row[f"c{i}_0"], row[f"c{i}_1"]) for i in range(len(rules))]


def _pruned(rows: DataFrame, rule: Rule) -> Rule:
    """The shortest head of the rule with the best (bad - good) / (bad + good) on rows not used for growing."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in _covered(rows, heads)]
    return heads[max(range(len(heads)), key=lambda k: (worth[k], -k))] if max(worth) > -1 else rule


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, the statistics, base_failed, rule, kept) for every document; rule is the number of the rule that fired.

    Null, empty and blank texts have no words and fail the base rules; null ids are judged, but have no label;
    repeated rows are judged alike, and repeated labels count as often as they stand; an empty table of documents
    or labels gives no rows or no learned rules. Clashing columns of either table are not read.
    """
    stats = materialised(statistics(id_column(docs, id_col), id_col, text_col))
    return judged(stats, _learned(stats, labels, id_col, label_col))


def _learned(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> list[Rule]:
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    return learn(stats.join(known, F.col(id_col) == F.col("__id")), "__label", id_col)


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule and kept to statistics."""
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents, with all their columns, that neither the base rules nor a learned rule rejects.

    The learned list is applied to the rows as they are read, so that no text is shuffled.
    """
    rules = _learned(materialised(statistics(docs, id_col, text_col)), labels, id_col, label_col)
    row, at = own_name(docs, "__row"), own_name(docs, "__at")
    whole = docs.withColumn(row, F.struct(*all_columns(docs)))
    # a column that is not deterministic keeps the filter above the statistics: pushed below, it would repeat them per word
    stats = statistics(whole, id_col, text_col, row).withColumn(at, F.monotonically_increasing_id())
    return judged(stats, rules).filter(F.col("kept") & (F.col(at) >= 0)).select(f"{row}.*")
