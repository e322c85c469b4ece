"""URL filters: rules by host and path, and a character language-model ratio for what no rule fits.

Two smoothed variable-order Markov models (orders 0 to 2, interpolated by Witten-Bell) are counted from the
URLs that rules allow and block. A URL without a rule is judged by the mean over its characters of
``log p_allow - log p_block``; the cut is calibrated on the fifth of the ruled URLs (by hash) that the models
did not see, where it balances the two error rates.

Counting, scoring and calibration are SQL functions. Characters fold to ``len(ALPHABET) + 3`` symbols, so the
table of log ratios has a fixed size whatever the input (``SYMBOLS ** 3`` small integers); it becomes an array
literal of the scoring expression, and judging needs neither join nor shuffle.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by the
models (a null url as the empty string); if no ruled URL of either kind exists, the models say allow. Repeated
rows are judged separately and alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.llm.common import settle

#: (verdict, host, path), as given.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_?=&%:#~+"
OTHER, BEGIN, END = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2
SYMBOLS = len(ALPHABET) + 3
#: Log ratios are kept as whole thousandths.
SCALE = 1000
#: Bins of the calibration histogram, of 0.02 each around 0.
BINS = 400


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Codes of the URL's characters after two begin marks and before an end mark."""
    low = F.lower(F.coalesce(url, F.lit("")))
    code = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c) - 1).otherwise(OTHER))
    return F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), code, F.array(F.lit(END)))


def grams(codes: Column) -> Column:
    """Of each character after the begin marks: its index into the table, by the two before it."""
    return F.transform(F.array(codes), lambda s: F.transform(F.sequence(F.lit(2), F.size(s) - 1), lambda i: (s[i - 2] * SYMBOLS + s[i - 1]) * SYMBOLS + s[i]))[0]


def log_ratios(counts: list[tuple[int, int, int]]) -> list[int]:
    """Thousandths of log p_allow - log p_block for each of SYMBOLS ** 3 grams, from rows (gram, allowed, blocked)."""
    n = SYMBOLS
    models = []
    for side in (1, 2):
        by = [defaultdict(lambda: defaultdict(int)) for _ in range(3)]
        for row in counts:
            (two, c), k = divmod(row[0], n), row[side]
            if k:
                for order, context in enumerate((0, two % n, two)):
                    by[order][context][c] += k

        def smooth(seen: dict, lower: list[float]) -> list[float]:
            total, kinds = sum(seen.values()), len(seen)
            return [(seen.get(c, 0) + kinds * lower[c]) / (total + kinds) for c in range(n)] if total else lower

        zero = smooth(by[0].get(0, {}), [1 / n] * n)
        one = [smooth(by[1].get(a, {}), zero) for a in range(n)]
        models.append([p for a in range(n) for b in range(n) for p in smooth(by[2].get(a * n + b, {}), one[b])])
    return [round(SCALE * (math.log(p) - math.log(q))) for p, q in zip(*models, strict=True)]


def scorer(ratios: list[int]):
    """Column function: mean log ratio over the characters of a URL. The table is folded into one literal."""
    table = f"cast(split('{','.join(map(str, ratios))}', ',') as array<int>)"

    def score(url: Column) -> Column:
        total = F.aggregate(grams(symbols(url)), F.lit(0).cast("long"), lambda a, g: a + F.get(F.expr(table), g).cast("long"))
        return total / (SCALE * (F.length(F.coalesce(url, F.lit(""))) + 1))

    return score


def cut_of(histogram: list[tuple[int, int, int]]) -> float:
    """From rows (bin, allowed, blocked): the lower edge of the bin where the two error rates sum to the least."""
    allowed, blocked = max(1, sum(r[1] for r in histogram)), max(1, sum(r[2] for r in histogram))
    best, cut, missed, caught = 1.0, 0, 0, 0
    if not sum(r[1] for r in histogram) or not sum(r[2] for r in histogram):
        return 0.0
    rows = {r[0]: r for r in histogram}
    for b in range(-BINS // 2, BINS // 2 + 1):
        loss = missed / allowed + 1 - caught / blocked
        if loss < best or (loss == best and abs(b) < abs(cut)):
            best, cut = loss, b
        missed, caught = missed + rows.get(b, (0, 0, 0))[1], caught + rows.get(b, (0, 0, 0))[2]
    return cut * 0.02


def fit(ruled: DataFrame) -> tuple[list[int], float] | None:
    """From rows (url, verdict): the table of log ratios and the cut; None if a side has no URL."""
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    good, bad = F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)), F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0))
    urls = settle(ruled.groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("n")), "urls-ruled")
    seen = urls.where(~held).select("verdict", "n", F.explode(grams(symbols(F.col("url")))).alias("g"))
    counts = [tuple(r) for r in seen.groupBy("g").agg(good.alias("a"), bad.alias("b")).collect()]  # SYMBOLS ** 3 rows at most
    if not sum(r[1] for r in counts) or not sum(r[2] for r in counts):
        return None
    ratios = log_ratios(counts)
    b = F.least(F.greatest(F.floor(scorer(ratios)(F.col("url")) / 0.02), F.lit(-BINS // 2)), F.lit(BINS // 2))
    return ratios, cut_of([tuple(r) for r in urls.where(held).groupBy(b.alias("bin")).agg(good.alias("a"), bad.alias("b")).collect()])  # BINS rows at most


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score), one for each row; score is null where a rule decides."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.select("*", rule.alias("rule"), verdict.alias("said"))
    model = fit(parts.where("said is not null").select("url", F.col("said").alias("verdict")))
    if model is None:
        return parts.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ratios, cut = model
    scored = parts.withColumn("score", F.when(F.col("said").isNull(), scorer(ratios)(F.col("url"))))
    verdict = F.coalesce(F.col("said"), F.when(F.col("score") < cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
