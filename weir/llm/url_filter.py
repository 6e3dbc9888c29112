"""URL filters by a character language-model ratio, in DataFrame functions only.

Rules (host, path, verdict) judge the URLs they fit; those URLs also teach two smoothed variable-order Markov
models, of accepted and of rejected URLs. A character's probability after k others is
(n + SMOOTH * probability after k - 1) / (t + SMOOTH), with n how often the character and t how often anything
followed those k, from k = 0 to ORDER; below that all characters are equally likely. A URL's score is
its mean log-likelihood difference a character; the threshold is calibrated on URLs that the counts leave out.

Everything is counted by windows of ORDER + 1 characters: URLs are cut into windows, equal windows are summed
before a shuffle, and each distinct window's log ratio is worked out once, in whole millionths, so that sums are the
same in any order. What is broadcast at once holds SMALL rows at most, all tables together: counts of the shortest
windows first, and of the log ratios those of windows that are more frequent than one in SMALL characters (so there are
fewer than SMALL). The rest is joined by a shuffle, in which no window is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.shared import written

ORDER, SMOOTH = 4, 2.0
#: Rows that may be broadcast at once (each a window and two numbers: 100 bytes at most).
SMALL = 150_000
#: Ruled URLs whose MD5 begins with one of these calibrate the threshold instead of being counted.
APART = ["0", "1", "2"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Null or no ://: both empty."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one text, and its verdict; both null if none fits. Of equals, block wins."""
    if len(rules) > 500:
        raise ValueError("rules are written into the plan: 500 at most")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def windows(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of column `spelling` and for its end, with the window of the `order` characters before it."""
    padded = urls.withColumn("_s", F.concat(F.lit("\u0002" * order), "spelling", F.lit("\u0003")))
    return padded.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("spelling") + 1))).withColumn("window", F.substring("_s", F.col("_i"), F.lit(order + 1))).drop("_s", "_i")


def ratios(seen: DataFrame, order: int, smooth: float, small: int) -> DataFrame:
    """(window, n, llr in millionths) for each distinct window of `seen` (window, n, a, r: counts in all, accepted and rejected URLs)."""
    length = order + 1
    grams = None
    for k in range(order + 1):
        counted = seen.where("a + r > 0")
        gram = counted.groupBy(F.lit(k).alias("k"), F.lit("n").alias("kind"), F.substring("window", length - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = counted.groupBy(F.lit(k).alias("k"), F.lit("t").alias("kind"), F.substring("window", length - k, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        grams = gram.unionByName(context) if grams is None else grams.unionByName(gram).unionByName(context)
    grams = written(grams, "grams")
    sizes = {(x["k"], x["kind"]): x["count"] for x in grams.groupBy("k", "kind").count().collect()}  # 2 * (order + 1) rows
    letters, room, few = sizes.get((0, "n"), 0) + 1, small, set()
    for table in sorted(sizes, key=sizes.get):
        room -= sizes[table]
        if room >= 0:
            few.add(table)
    out, p_a, p_r = seen.select("window", "n"), F.lit(1.0 / letters), F.lit(1.0 / letters)
    for k in range(order + 1):
        for kind, begin, n in (("n", length - k, k + 1), ("t", length - k, k)):
            own = grams.where((F.col("k") == k) & (F.col("kind") == kind)).select(F.col("gram").alias(f"g_{kind}{k}"), F.col("a").alias(f"a_{kind}{k}"), F.col("r").alias(f"r_{kind}{k}"))
            out = out.join(F.broadcast(own) if (k, kind) in few else own, F.substring("window", begin, n) == F.col(f"g_{kind}{k}"), "left").drop(f"g_{kind}{k}")
        of = lambda c, kind, k=k: F.coalesce(F.col(f"{c}_{kind}{k}"), F.lit(0))
        out = out.withColumns({f"p_a{k}": (of("a", "n") + smooth * p_a) / (of("a", "t") + smooth), f"p_r{k}": (of("r", "n") + smooth * p_r) / (of("r", "t") + smooth)})
        out = out.drop(*(f"{c}_{kind}{k}" for c in "ar" for kind in "nt"))
        p_a, p_r = F.col(f"p_a{k}"), F.col(f"p_r{k}")
    return out.select("window", "n", F.floor((F.log(p_a) - F.log(p_r)) * 1e6 + 0.5).alias("llr"))


def threshold_of(scores: DataFrame) -> float:
    """The score that best parts accepted from rejected URLs (mean of both shares right), by hundredths; 0 if a class is absent.

    Of equals the middle. Counts by hundredth come to the driver: a probability ratio is bounded, so a few thousand rows at most.
    """
    binned = [(x["b"], x["a"], x["r"]) for x in scores.groupBy(F.floor(F.col("score") * 100).alias("b")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).orderBy("b").collect()]
    a, r = sum(x[1] for x in binned), sum(x[2] for x in binned)
    if not a or not r:
        return 0.0
    best, below_a, below_r = [(a * r, binned[0][0])], 0, 0
    for b, n_a, n_r in binned:
        below_a, below_r = below_a + n_a, below_r + n_r
        best.append(((a - below_a) * r + below_r * a, b + 1))
    good = [t for s, t in best if s == max(x[0] for x in best)]
    return (good[0] + good[-1]) / 200


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER, smooth: float = SMOOTH, small: int = SMALL) -> DataFrame:
    """page_id, host, path, rule, verdict, score: the rule's verdict, or the model's (allow at the threshold and above).

    Every row is judged: null, empty and repeated URLs and ids too (an empty URL has one window, its end). If the
    rules fit no URL, or only of one verdict, the models say nothing and the rest is allowed. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said}).withColumn("spelling", F.concat("host", "path"))
    ruled = written(ruled.withColumn("apart", F.md5(F.encode("spelling", "UTF-8")).substr(1, 1).isin(APART)).withColumn("row", F.monotonically_increasing_id()), "urls")
    counted = ~F.col("apart") & F.col("said").isNotNull()
    a, r = ((counted & (F.col("said") == v)).cast("long") for v in ("allow", "block"))
    seen = written(windows(ruled.select("spelling", a.alias("a"), r.alias("r")), order).groupBy("window").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("r").alias("r")), "windows")
    llr = written(ratios(seen, order, smooth, small), "llr")
    keys = ["row", "page_id", "host", "path", "rule", "said", "apart"]
    total = llr.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    each = windows(ruled, order)
    if total["rows"] <= small:
        known = each.join(F.broadcast(llr.drop("n")), "window")
    else:
        often = F.col("n") * small > total["n"]
        hot, cold = llr.where(often).drop("n"), llr.where(~often).drop("n")
        known = each.join(F.broadcast(hot), "window").select(*keys, "llr").unionByName(each.join(F.broadcast(hot.select("window")), "window", "left_anti").join(cold, "window").select(*keys, "llr"))
    scored = known.groupBy(*keys).agg((F.sum("llr") / F.count("llr") / 1e6).alias("score"))
    scored = written(scored, "scored")
    both = seen.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")).first()
    if both["a"] and both["r"]:
        limit = threshold_of(scored.where(F.col("apart") & F.col("said").isNotNull()).select("score", (F.col("said") == "allow").alias("accepted")))
        model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    else:
        model = F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"), "score")


