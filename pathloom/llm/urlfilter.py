"""URL filter by a character language-model ratio, in DataFrame functions only.

Two variable-order Markov models of characters, one of accepted and one of rejected URLs, interpolate orders 1 to
``ORDER`` by Witten-Bell weights. A URL's score is the mean over its characters of the log-likelihood difference;
the cut is calibrated on labelled URLs held out of the counts, at the least balanced error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.workspace import Scratch, saved

ORDER = 4
BROADCAST_GRAMS = 500_000  #: a larger gram table is joined by shuffle
SALTS = 16  #: parts of a frequent gram in that join
STEPS = 200  #: calibration histogram: steps to one unit of the score
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  #: (block or allow, host, path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://' or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name (host + path) and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _grams(judged: DataFrame, *keep: str) -> DataFrame:
    """One row per character (and end mark) of a URL: the ORDER-gram that ends there."""
    text = F.lower(F.regexp_replace("url", r"^[^:/?#]*://", ""))
    pad = F.array_repeat(F.lit("\u0002"), ORDER - 1)
    chars = F.concat(pad, F.array_remove(F.split(text, ""), ""), F.array(F.lit("\u0003")))
    at = judged.where("url is not null").withColumn("chars", chars).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("chars") - ORDER)))
    return at.select(*keep, F.concat(*(F.col("chars")[F.col("at") + k] for k in range(ORDER))).alias("gram"))


def _suffix(n: int) -> Column:
    return F.substr("gram", F.lit(ORDER - n + 1), F.lit(n))


def _differences(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(gram, weight): log P(accepted) - log P(rejected) of each target gram's last character after the others."""
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"N{c}") for c in "ar"), F.count_distinct(_suffix(1)).alias("V"))
    row = total.first()
    out = targets.withColumn("pa", F.lit(None).cast("double")).withColumn("pr", F.lit(None).cast("double"))
    for n in range(1, ORDER + 1):
        level = counts.groupBy(_suffix(n).alias("g")).agg(F.sum("a").cast("double").alias("a"), F.sum("r").cast("double").alias("r"))
        out = out.withColumn("g", _suffix(n)).join(level, "g", "left").na.fill(0.0, ["a", "r"])
        if n == 1:
            for c in "ar":
                out = out.withColumn(f"p{c}", (F.col(c) + 0.5) / (row[f"N{c}"] + 0.5 * (row["V"] + 1)))
        else:
            context = level.groupBy(F.substr("g", F.lit(1), F.lit(n - 1)).alias("ctx")).agg(*(x for c in "ar" for x in (F.sum(c).alias(f"n{c}"), F.sum((F.col(c) > 0).cast("double")).alias(f"t{c}"))))
            out = out.withColumn("ctx", F.substr("g", F.lit(1), F.lit(n - 1))).join(context, "ctx", "left").na.fill(0.0, ["na", "nr", "ta", "tr"])
            for c in "ar":
                mixed = (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))
                out = out.withColumn(f"p{c}", F.when(F.col(f"n{c}") > 0, mixed).otherwise(F.col(f"p{c}")))
        out = out.select("gram", "pa", "pr")
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("weight"))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of ``pages``.

    The longest fitting rule gives the verdict. URLs under allow and block rules are the accepted and rejected
    samples (four fifths count, one fifth by the id's crc32 calibrates); the models judge all other URLs: allow
    where the mean log-likelihood difference reaches the cut. A null URL scores 0. Without samples on both sides
    nothing speaks against a URL and the verdict is allow. Repeated rows are judged alike; a null id is kept. An
    empty table gives an empty result. Other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    source = source.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = source.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"), (F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0).alias("held"))
    sides = [F.sum(((F.col("ruled") == side) & ~F.col("held")).cast("long")).alias(c) for side, c in (("allow", "a"), ("block", "r"))]
    scratch = Scratch(pages.sparkSession)
    counted = scratch.saved(_grams(judged, "ruled", "held").groupBy("gram").agg(*(F.coalesce(s, F.lit(0)).alias(c) for s, c in zip(sides, "ar", strict=True))), "grams")
    weights = scratch.saved(_differences(counted.where("a + r > 0"), counted.select("gram")), "weights")
    numbered = scratch.saved(judged.withColumn("row", F.monotonically_increasing_id()), "urls")
    rows = _grams(numbered, "row")
    if weights.count() <= BROADCAST_GRAMS:
        weighed = rows.join(F.broadcast(weights), "gram")
    else:  # frequent grams are split, so that no task gets all rows of one
        split = weights.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        weighed = rows.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(split, ["gram", "salt"])
    means = weighed.groupBy("row").agg(F.avg("weight").alias("score"))
    scored = numbered.drop("url").join(means, "row", "left").drop("row").na.fill(0.0, ["score"])
    scored = saved(scored.select("page_id", "host", "path", "rule", "ruled", "held", "score"), "scores")
    scratch.clear()
    bins = scored.where("held and ruled is not null").groupBy(F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * STEPS).cast("int").alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("r"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # a cut at this bin loses the accepted below it and lets the rejected from it on through
    error = F.coalesce(F.sum("a").over(upto), F.lit(0)) / F.sum("a").over(every) + 1 - F.coalesce(F.sum("r").over(upto), F.lit(0)) / F.sum("r").over(every)
    best = bins.where(f"bin between {-20 * STEPS} and {20 * STEPS}").withColumns({"error": error, "before": F.lag("bin").over(Window.orderBy("bin"))}).where("error is not null").orderBy("error", "bin").first()
    # in the middle of the gap below the best bin
    cut = None if best is None else ((best["bin"] - 1 if best["before"] is None else best["before"]) + best["bin"]) / 2 / STEPS
    known = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", known).alias("verdict"), "score")
