"""URL filters: rules first, then a likelihood ratio of two character language models, with DataFrame functions only.

A rule names a host and a path prefix; it fits that host and its subdomains, and the longest fitting rule decides. The URLs that rules
accept and reject are the training text of two variable-order Markov models over characters: each order's estimate is smoothed
towards the next shorter one in proportion to how many different characters followed its context (Witten and Bell), down to a
uniform one. Any other URL is judged by the mean over its characters of the log ratio of the two models, against a cut
calibrated on decided URLs that the models were not fitted on (``held`` of every ten, by a hash of the URL).

Counts of the grams of all orders are in one table, and what a gram is worth in another. The latter is broadcast in slices of at most
``BROADCAST`` bytes, one pass over the URLs for each: characters are never shuffled, only a partial sum a URL and slice is. Equal URLs
are scored once.

Rows and nulls: a URL that is null or has no ``://`` has empty host and path, fits no rule and is judged by the models on its whole text; a
null or empty one is allowed. Repeated rows are judged alike. Without decided URLs of both kinds every other URL is allowed. A very
long URL is one row until its characters are joined. Columns named host, path, rule or verdict are replaced, all others stay; names
that start with ``__`` are reserved. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, scratch, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 4  # characters of an n-gram: three of context and one that follows
BROADCAST = 64 << 20  # bytes; a row of a gram and its worth takes about ROW of them in a hash table
ROW = 128
START, END = "\x02", "\x03"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written host and path, and its verdict; nulls if none fits."""
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    pick = lambda what: reduce(lambda rest, r: F.when(fits(r[0], r[1]), what(r)).otherwise(rest), reversed(by_length), F.lit(None).cast("string"))
    return pick(lambda r: r[0] + r[1]), pick(lambda r: r[2])


def symbols(url: Column) -> Column:
    """What the models read: the URL in lower case after its scheme, or all of it."""
    return F.lower(F.coalesce(after_scheme(url), url))


def grams(urls: DataFrame) -> DataFrame:
    """``urls`` with a row for each character and for the end: gram is the character after its context."""
    padded = F.concat(F.lit(START * (ORDER - 1)), F.col("symbols"), F.lit(END))
    each = F.transform(F.sequence(F.lit(1), F.length("symbols") + 1), lambda i: F.substring(padded, i.cast("int"), F.lit(ORDER)))
    return urls.select(*[c for c in urls.columns if c != "symbols"], F.explode(each).alias("gram"))


def log_ratios(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each of the ``wanted`` grams the log of the accepting over the rejecting model's probability.

    An order's part of a gram is its last characters, and their context all of those but the last; a context's length is its order's.
    """
    ends = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda n: F.struct(n.alias("n"), F.right("gram", n).alias("g")))
    of_orders = lambda df, *more: df.select("gram", *more, F.explode(ends).alias("e")).select("gram", *more, "e.n", "e.g")
    one = lambda c: F.sum(c.cast("long"))
    full = grams(train).groupBy("gram").agg(one(F.col("accepted")).alias("a"), one(~F.col("accepted")).alias("r"))
    seen = materialize(of_orders(full, "a", "r").groupBy("n", "g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "seen")
    context = seen.groupBy("n", F.expr("left(g, n - 1)").alias("c")).agg(
        F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
    )
    asked = of_orders(wanted.select("gram")).withColumn("c", F.expr("left(g, n - 1)"))
    found = asked.join(seen, ["n", "g"], "left").join(materialize(context, "context"), ["n", "c"], "left")
    counts = ["a", "r", "na", "nr", "ta", "tr"]
    packed = found.groupBy("gram").agg(*[F.max(F.when(F.col("n") == n, F.col(k))).alias(f"{k}{n}") for n in range(1, ORDER + 1) for k in counts])
    zero = lambda k, n: F.coalesce(F.col(f"{k}{n}"), F.lit(0))

    def smooth(p: Column, n: int, kind: str) -> Column:
        whole = zero(f"n{kind}", n) + zero(f"t{kind}", n)
        return F.when(whole > 0, (zero(kind, n) + zero(f"t{kind}", n) * p) / whole).otherwise(p)

    result = packed.withColumns({"p0a": F.lit(1.0 / 256), "p0r": F.lit(1.0 / 256)})
    for n in range(1, ORDER + 1):
        result = result.withColumns({f"p{n}{kind}": smooth(F.col(f"p{n - 1}{kind}"), n, kind) for kind in "ar"})
    return result.select("gram", F.log(F.col(f"p{ORDER}a") / F.col(f"p{ORDER}r")).alias("ratio"))


def scores(urls: DataFrame, train: DataFrame, most: int = BROADCAST) -> DataFrame:
    """url, score: the mean log ratio over the characters of each distinct url."""
    each = grams(urls)
    ratios = materialize(log_ratios(train, materialize(each.select("gram").distinct(), "wanted")), "ratios")
    passes = -(-ratios.count() * ROW // most)
    slice_of = F.pmod(F.xxhash64("gram"), F.lit(max(1, passes)))
    sums = [each.join(F.broadcast(ratios.filter(slice_of == k)), "gram").groupBy("url").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("n")) for k in range(max(1, passes))]
    if passes <= 1:
        return sums[0].select("url", (F.col("ratio") / F.col("n")).alias("score"))
    every = reduce(DataFrame.unionByName, [materialize(x, "sums") for x in sums])
    return every.groupBy("url").agg((F.sum("ratio") / F.sum("n")).alias("score"))


def calibrate(scored: DataFrame, bins: int = 1024, span: float = 8.0) -> float:
    """The cut with the best mean of both kinds' hit rates, from a histogram of fixed size; the middle of the best run of cuts."""
    place = F.least(F.greatest(F.floor((F.col("score") + span) / (2 * span) * bins), F.lit(0)), F.lit(bins - 1))
    counts = scored.groupBy(place.alias("bin")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect()
    a, r = ({x["bin"]: x[k] for x in counts} for k in "ar")
    all_a, all_r = max(1, sum(a.values())), max(1, sum(r.values()))
    below_a = below_r = 0
    rates = []
    for b in range(bins + 1):
        rates.append((1 - below_a / all_a + below_r / all_r) / 2)
        below_a += a.get(b, 0)
        below_r += r.get(b, 0)
    best = [b for b, rate in enumerate(rates) if rate == max(rates)]
    return -span + 2 * span * best[len(best) // 2] / bins


def judge(pages: DataFrame, rules=RULES, held: int = 2) -> DataFrame:
    """``pages`` with host, path, rule, verdict."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = F.col("__host"), F.col("__path")
    rule, said = ruled(host, path, rules)
    parted = pages.select(*keep, host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"))
    parted = parted.withColumns({"__rule": rule, "__said": said})
    done = lambda rows, verdict: rows.select(*keep, host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"))
    with scratch(pages.sparkSession) as hold:
        urls = parted.filter(F.length("url") > 0).groupBy("url").agg(F.first("__said").alias("said"))
        urls = materialize(urls.withColumn("symbols", symbols(F.col("url"))), "urls")
        apart = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 10 < held
        decided = urls.filter("said is not null").withColumn("accepted", F.col("said") == "allow").select("url", "symbols", "accepted")
        kinds = {x["accepted"] for x in decided.select("accepted").distinct().collect()}  # two values at most
        if len(kinds) < 2:
            return done(parted, F.coalesce("__said", F.lit("allow")))
        train, check = decided.filter(~apart), decided.filter(apart)
        asked = urls.filter(F.col("said").isNull() | apart).select("url", "symbols")
        scored = hold(materialize(scores(asked, train), "scored"))
        cut = calibrate(scored.join(check.select("url", "accepted"), "url"))
    open_ = F.coalesce(F.col("__said").isNull() & (F.length("url") > 0), F.lit(False))
    verdicts = scored.select(F.col("url").alias("__url"), F.when(F.col("score") >= cut, "allow").otherwise("block").alias("__judged"))
    rest = parted.filter(open_).join(verdicts, F.col("url") == F.col("__url"))
    return done(parted.filter(~open_), F.coalesce("__said", F.lit("allow"))).unionByName(done(rest, F.col("__judged")))


def op6_urls(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql(rules=RULES) -> str:
    by_length = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in by_length) + " END"
    orders = range(1, ORDER + 1)
    seen = ", ".join(f"s{n} AS (SELECT right(gram, {n}) AS g, sum(a) AS a, sum(r) AS r FROM f GROUP BY 1), c{n} AS (SELECT left(g, {n - 1}) AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM s{n} GROUP BY 1)" for n in orders)
    smooth = lambda p, n, k: f"CASE WHEN coalesce(n{k}, 0) + coalesce(t{k}, 0) > 0 THEN (coalesce(s{n}.{k}, 0) + coalesce(t{k}, 0) * {p}) / (coalesce(n{k}, 0) + coalesce(t{k}, 0))::DOUBLE ELSE {p} END"
    steps = ", ".join(f"p{n} AS (SELECT gram, {smooth('pa', n, 'a')} AS pa, {smooth('pr', n, 'r')} AS pr FROM p{n - 1} LEFT JOIN s{n} ON s{n}.g = right(gram, {n}) LEFT JOIN c{n} ON c{n}.c = left(right(gram, {n}), {n - 1}))" for n in orders)
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{ASCII_UPPER}', '{ASCII_LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
d AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS said FROM h),
q AS (SELECT url, any_value(said) AS said, lower(coalesce(any_value(rest), url)) AS symbols, ('0x' || substr(md5(url), 1, 8))::BIGINT % 10 < 2 AS apart FROM d WHERE length(url) > 0 GROUP BY url),
g AS (SELECT url, said, apart, substr(repeat(chr(2), {ORDER - 1}) || symbols || chr(3), i::BIGINT, {ORDER}) AS gram FROM (SELECT *, unnest(range(1, length(symbols) + 2)) AS i FROM q)),
f AS (SELECT gram, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM g WHERE said IS NOT NULL AND NOT apart GROUP BY 1),
{seen}, p0 AS (SELECT DISTINCT gram, 1 / 256::DOUBLE AS pa, 1 / 256::DOUBLE AS pr FROM g WHERE said IS NULL OR apart), {steps},
sc AS (SELECT url, any_value(said) AS said, sum(ln(pa / pr)) / count(*) AS score FROM g JOIN p{ORDER} USING (gram) GROUP BY 1),
b AS (SELECT least(greatest(floor((score + 8) / 16 * 1024), 0), 1023)::INT AS bin, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM sc WHERE said IS NOT NULL GROUP BY 1),
k AS (SELECT k.bin, coalesce(sum(a) FILTER (b.bin < k.bin), 0) AS below_a, coalesce(sum(r) FILTER (b.bin < k.bin), 0) AS below_r, sum(a) AS all_a, sum(r) AS all_r FROM (SELECT unnest(range(1025)) AS bin) k, b GROUP BY 1),
e AS (SELECT bin, (1 - below_a / all_a::DOUBLE + below_r / all_r::DOUBLE) / 2 AS rate FROM k),
m AS (SELECT list(bin ORDER BY bin) AS best FROM e WHERE rate = (SELECT max(rate) FROM e)),
x AS (SELECT -8 + 16 * best[len(best) // 2 + 1] / 1024::DOUBLE AS cut FROM m)
SELECT page_id, host, path, rule, coalesce(d.said, CASE WHEN sc.score < cut THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN sc ON d.url = sc.url, x
"""


OP6_SQL = _sql()
