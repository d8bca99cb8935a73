"""URL filter: allow and block rules, and for urls without a rule a character language-model ratio.

Urls that a rule allows are the accepted text, those that a rule blocks the rejected text. For each there is a
variable-order Markov model: the chance of a character after up to four others is its relative count, smoothed with
the chance after one character fewer in proportion to how many different characters follow the context (Witten and
Bell); contexts never seen leave it to the shorter one. A url's score is the difference of its log-likelihoods,
divided by its length. The threshold is calibrated on rule-judged urls of a fold that is not counted.

All of it is DataFrame functions. Models cover every counted url; a model is a table that grows with the urls and
is joined, never broadcast by hint or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.text import id_column
from tabsight.sources.files import materialised

ORDER = 4
#: Chance of any character before anything is known.
UNIFORM = 1 / 256
FOLDS = 5
#: Width of the threshold's steps, in millionths of a nat per character, and their bound.
STEP = 20_000
REACH = 1_250

# fixed values
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"

#: (verdict, rule); a rule is a host and the start of a path.
Rules = Sequence[tuple[str, str]]


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)).otherwise("")


def matched_rule(rules: Rules) -> Column:
    """The longest rule that fits host and path, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character, and the end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    chars = F.slice(F.split(padded, ""), F.lit(1), F.length(padded))
    return chars, F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.concat(*(F.get("__chars", i + k) for k in range(order + 1))))


def _with_grams(df: DataFrame) -> DataFrame:
    chars, each = grams(F.col("text"))
    return df.withColumn("__chars", chars).withColumn("gram", F.explode(each)).drop("__chars")


def gram_scores(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) from (gram, accepted, rejected): ln of the accepted over the rejected chance, in millionths."""
    tables = [counts]
    for k in range(order, 0, -1):
        tables.append(tables[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    known = None
    for k, table in enumerate(reversed(tables)):
        after = Window.partitionBy(F.substring("gram", 1, k))
        level = table.select("gram", *(x for c in ("accepted", "rejected") for x in (
            F.col(c), F.sum(c).over(after).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("long")).over(after).alias(f"{c}_kinds"))))
        if known is None:
            level = level.withColumns({"accepted_p": F.lit(UNIFORM), "rejected_p": F.lit(UNIFORM)})
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(known, "shorter")
        p = {c: F.when(F.col(f"{c}_all") == 0, F.col(f"{c}_p")).otherwise(
            (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))) for c in ("accepted", "rejected")}
        known = level.select(F.col("gram").alias("shorter"), *(v.alias(f"{c}_p") for c, v in p.items()))
    ratio = F.floor((F.log("accepted_p") - F.log("rejected_p")) * 1e6 + 0.5).cast("long")
    return known.select(F.col("shorter").alias("gram"), ratio.alias("ratio"))


def threshold(held: DataFrame) -> int:
    """The step with the best balanced accuracy for (mean, judged) of held-out urls; 0 without both verdicts."""
    step = F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.col("mean") / STEP)))
    cells = held.groupBy(step.cast("int").alias("s")).agg(F.count_if(F.col("judged") == "allow").alias("a"), F.count_if(F.col("judged") == "block").alias("b")).collect()
    accepted, rejected = sum(c["a"] for c in cells), sum(c["b"] for c in cells)
    if not accepted or not rejected:
        return 0
    worth = {t: sum(c["a"] for c in cells if c["s"] >= t) * rejected + sum(c["b"] for c in cells if c["s"] < t) * accepted for t in range(-REACH, REACH + 1)}
    return min(worth, key=lambda t: (-worth[t], abs(t), t))


def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every page; score is the mean log ratio per
    character, in millionths of a nat.

    A null url, or one without "://", has an empty host and path and is judged by the model from these. Null ids
    are kept; repeated rows are judged alike and counted as often as they stand; without urls under both kinds of
    rules every score counts from the same start and the threshold is 0. Other columns are not read.
    """
    verdict = F.create_map(*(F.lit(x) for v, r in rules for x in (r, v)))
    url = F.coalesce(F.col(url_col), F.lit(""))
    held = F.pmod(F.conv(F.substring(F.md5(url.cast("binary")), 1, 4), 16, 10).cast("long"), F.lit(FOLDS)) == 0
    d = id_column(pages, id_col).select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), held.alias("held"))
    d = materialised(d.withColumn("rule", matched_rule(rules)).withColumn("judged", verdict[F.col("rule")]).withColumn("text", F.concat("host", "path")))
    texts = d.groupBy("text").agg(*(F.count_if(~F.col("held") & (F.col("judged") == v)).alias(c) for v, c in (("allow", "accepted"), ("block", "rejected"))))
    each = _with_grams(texts)
    ratios = gram_scores(each.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")))
    total = each.select("text", "gram").join(ratios, "gram").groupBy("text").agg(F.sum("ratio").alias("total"))
    scored = materialised(d.join(total, "text").withColumn("mean", F.col("total") / (F.length("text") + 1)))
    least = threshold(scored.filter("held and judged is not null").select("mean", "judged"))
    by_model = F.when(F.col("mean") >= F.lit(float(least * STEP)), "allow").otherwise("block")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("judged", by_model).alias("verdict"), F.col("mean").alias("score"))


def oracle(rules: Rules) -> str:
    """The same in SQL for pages (page_id, url)."""
    lower = f"'{_UPPER}', '{_LOWER}'"
    case = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND prefix(path, '/{r.partition('/')[2]}') THEN '{r}'"
                    for _, r in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True))
    judged = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in rules)
    levels = [f"t{ORDER} AS (SELECT gram, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected FROM e GROUP BY gram)"]
    levels += [f"t{k} AS (SELECT substr(gram, 2) AS gram, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(rejected) AS BIGINT) AS rejected FROM t{k + 1} GROUP BY 1)"
               for k in range(ORDER - 1, -1, -1)]
    for k in range(ORDER + 1):
        shorter = f"JOIN p{k - 1} s ON s.gram = substr(t.gram, 2)" if k else ""
        p = [f"CASE WHEN {c}_all = 0 THEN {c}_s ELSE ({c} + {c}_kinds * {c}_s) / ({c}_all + {c}_kinds) END AS {c}_p" for c in ("accepted", "rejected")]
        sums = ", ".join(f"t.{c}, CAST(sum(t.{c}) OVER (PARTITION BY substr(t.gram, 1, {k})) AS DOUBLE) AS {c}_all, "
                         f"CAST(sum(CAST(t.{c} > 0 AS INT)) OVER (PARTITION BY substr(t.gram, 1, {k})) AS DOUBLE) AS {c}_kinds, "
                         + (f"s.{c}_p" if k else f"CAST({UNIFORM} AS DOUBLE)") + f" AS {c}_s" for c in ("accepted", "rejected"))
        levels.append(f"p{k} AS (SELECT gram, {', '.join(p)} FROM (SELECT t.gram, {sums} FROM t{k} t {shorter}))")
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS mark FROM pages),
r AS (SELECT page_id, url, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
m AS (SELECT page_id, host, path, host || path AS body, CASE {case} END AS rule, CAST('0x' || substr(md5(url), 1, 4) AS INT) % {FOLDS} = 0 AS held FROM h),
d AS (SELECT *, CASE rule {judged} END AS judged FROM m),
x AS (SELECT body, count(*) FILTER (NOT held AND judged = 'allow') AS accepted, count(*) FILTER (NOT held AND judged = 'block') AS rejected FROM d GROUP BY body),
e AS (SELECT body, accepted, rejected, substr(repeat(chr(2), {ORDER}) || body || chr(3), CAST(i AS BIGINT), {ORDER + 1}) AS gram
      FROM (SELECT *, unnest(range(1, length(body) + 2)) AS i FROM x)),
{", ".join(levels)},
s AS (SELECT body, sum(CAST(floor((ln(accepted_p) - ln(rejected_p)) * 1e6 + 0.5) AS BIGINT)) AS total FROM e JOIN p{ORDER} USING (gram) GROUP BY body),
z AS (SELECT d.*, CAST(total AS DOUBLE) / (length(body) + 1) AS mean FROM d JOIN s USING (body)),
c AS (SELECT greatest(-{REACH}, least({REACH}, CAST(floor(mean / {STEP}) AS INT))) AS step, count(*) FILTER (judged = 'allow') AS a, count(*) FILTER (judged = 'block') AS b
      FROM z WHERE held AND judged IS NOT NULL GROUP BY 1),
w AS (SELECT t, sum(CASE WHEN step >= t THEN a ELSE 0 END) * (SELECT sum(b) FROM c) + sum(CASE WHEN step < t THEN b ELSE 0 END) * (SELECT sum(a) FROM c) AS worth
      FROM c, range(-{REACH}, {REACH} + 1) AS g(t) GROUP BY t),
l AS (SELECT coalesce((SELECT t FROM w WHERE (SELECT min(x) FROM (SELECT sum(a) AS x FROM c UNION ALL SELECT sum(b) FROM c)) > 0 ORDER BY worth DESC, abs(t), t LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN mean >= least * {STEP} THEN 'allow' ELSE 'block' END) AS verdict, CAST(floor(mean) AS BIGINT) AS score FROM z, l
"""
