"""URL filter: rules first, else the ratio of two character models. DataFrame functions only.

URLs that rules decide are the labelled text: accepted and rejected URLs train one smoothed variable-order
Markov model each. A URL without a rule is judged by its log-likelihood difference per character against a
threshold calibrated on the labelled URLs. Characters are folded to a small alphabet, so that all model
tables have at most SYMBOLS ** (ORDER + 1) rows however many URLs there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits the host and its subdomains if the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

ORDER = 2
#: Begin and end marks, letters, digits folded to 0, and punctuation of URLs; all else is one symbol, 0.
BEGIN, END = "\x02", "\x03"
ALPHABET = BEGIN + END + "abcdefghijklmnopqrstuvwxyz0-._~/?#&=%+:@"
SYMBOLS = len(ALPHABET) + 1
#: A context seen fewer times passes its whole weight to the next shorter one.
LEAST_CONTEXT = 4
BIN = 0.01  # resolution of the threshold
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; of equally long ones, the first in order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=False):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where lambdas of the body use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(text: Column) -> Column:
    """Codes of a text's ORDER + 1 grams, begin and end marks included: at least one."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), "0123456789" + BEGIN + END, "0" * 10 + "\x01\x01")
    codes = F.transform(F.split(F.concat(F.lit(BEGIN * ORDER), folded, F.lit(END)), ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def gram(codes: Column, i: Column) -> Column:
        return sum((F.get(codes, i - back) * SYMBOLS**back for back in range(1, ORDER + 1)), F.get(codes, i))

    return _let(codes, lambda codes: F.transform(F.sequence(F.lit(ORDER), F.size(codes) - 1), lambda i: gram(codes, i)))


def _level(seen: DataFrame, order: int, below: DataFrame) -> DataFrame:
    """Smoothed probability of each symbol after each context of `order` symbols.

    Witten-Bell: a context passes on the weight of its distinct followers, and a rare context all of its weight.
    """
    spark = seen.sparkSession
    grid = spark.range(SYMBOLS ** (order + 1)).select(
        F.expr(f"id div {SYMBOLS}").cast("int").alias("ctx"), (F.col("id") % SYMBOLS).cast("int").alias("c"), F.col("id").cast("int").alias("gram")
    )
    n = seen.groupBy((F.col("gram") % SYMBOLS ** (order + 1)).cast("int").alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    ctx = n.groupBy(F.expr(f"gram div {SYMBOLS}").cast("int").alias("ctx")).agg(
        *(F.sum(k).alias(f"n_{k}") for k in ("yes", "no")), *(F.count_if(F.col(k) > 0).alias(f"kinds_{k}") for k in ("yes", "no"))
    )
    out = grid.join(n, "gram", "left").join(ctx, "ctx", "left")
    if order:
        out = out.withColumn("below", (F.col("gram") % SYMBOLS**order).cast("int")).join(below.select(F.col("gram").alias("below"), "p_yes", "p_no"), "below")
    else:
        out = out.select("*", *(F.lit(1.0 / SYMBOLS).alias(f"p_{k}") for k in ("yes", "no")))

    def p(k: str) -> Column:
        total, kinds, prior = F.coalesce(f"n_{k}", F.lit(0)), F.coalesce(f"kinds_{k}", F.lit(0)), F.col(f"p_{k}")
        return F.when(total < LEAST_CONTEXT, prior).otherwise((F.coalesce(F.col(k), F.lit(0)) + kinds * prior) / (total + kinds))

    return out.select("gram", p("yes").alias("p_yes"), p("no").alias("p_no"))


def train(labelled: DataFrame) -> DataFrame:
    """Log-likelihood ratio of every gram: columns gram, ratio. `labelled` has url and accepted (boolean).

    Counts run over all rows. Without a row of one kind that model is uniform.
    """
    seen = (
        labelled.select(F.explode(grams(F.col("url"))).alias("gram"), "accepted")
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    )
    p = None
    for order in range(ORDER + 1):
        p = _level(seen, order, p)
    return p.select("gram", F.round(F.ln("p_yes") - F.ln("p_no"), 6).alias("ratio"))


def ratio_score(url: Column, ratios: str) -> Column:
    """Mean ratio over a URL's characters, to six digits below; `ratios` lists millionths for each gram in order.

    Whole numbers add up to the same sum in any order.
    """
    values = F.split(F.lit(ratios), ",").cast("array<bigint>")

    def mean(codes: Column) -> Column:
        return F.floor(F.aggregate(codes, F.lit(0).cast("long"), lambda a, g: a + F.get(values, g)) / F.size(codes)) / F.lit(1e6)

    return _let(grams(url), mean)


def threshold(scored: DataFrame) -> float:
    """Score that splits accepted from rejected URLs with the best balanced accuracy; the middle of equally good ones.

    Scores are counted in bins, so what is gathered is bounded.
    """
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).orderBy("bin").collect()
    yes, no = sum(b.yes for b in bins), sum(b.no for b in bins)
    if not yes or not no:
        return 0.0
    below_yes = below_no = 0
    best: list[tuple[float, float]] = []
    for b, after in zip(bins, [*bins[1:], None], strict=True):
        below_yes, below_no = below_yes + b.yes, below_no + b.no
        if after is not None:
            best.append((round((yes - below_yes) / yes + below_no / no, 12), (b.bin + 1 + after.bin) / 2 * BIN))
    top = max((g for g, _ in best), default=0)
    ties = [t for g, t in best if g == top]
    return ties[len(ties) // 2] if ties else 0.0


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Host, path, rule and verdict of each page; `pages` has page_id and url, other columns are ignored.

    Rows are kept as they are, repeated ones included. A null URL has an empty host and path, no rule, and is judged
    as an empty text. An empty table gives no rows. Three passes read the url column alone; nothing but gram and
    bin counts is shuffled, after partial sums, so a hot host costs nothing.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", rule.alias("rule"), decided.alias("decided"))
    labelled = judged.where(F.col("decided").isNotNull()).select("url", (F.col("decided") == "allow").alias("accepted"))
    model = train(labelled).collect()  # SYMBOLS ** (ORDER + 1) rows whatever the input
    ratios = ",".join(str(round(r.ratio * 1e6)) for r in sorted(model, key=lambda r: r.gram))
    score = ratio_score(F.col("url"), ratios)
    least = threshold(labelled.select(score.alias("score"), "accepted"))
    verdict = F.coalesce("decided", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return judged.withColumn("score", score).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(least).alias("threshold"))
