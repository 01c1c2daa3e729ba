"""Mixing sources to target weights: hash-random order, prefix sums of sizes, a cut at each source's budget.

Order within a source is by a hash of the row's id and text, so a range of the hash is a fair bucket: the order needs no sampling, a
hot source is spread over as many buckets as it needs, and a rerun gives the same mix. Words are counted once, into a narrow table.
Sums of its buckets say in which bucket a source's budget ends; only that bucket is summed row by row. What a row gives then
follows from its own key and its source's cut, so texts are never shuffled.

Rows and nulls: a null text has size 0 and is never taken; a null source is a source of its own, last in order; a null doc_id is
hashed as the word ``null``. Only rows with the same id and text have the same key; they are counted and not sorted, and where a cut
falls among them, as many of them are taken as it says. A very long text is one row like any other. An empty table gives an empty mix.
Other columns pass through ``mix_documents`` only; ``mix`` names its own result columns, so names of the input can't clash with
them. Names that start with ``__mix`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import buckets_for, copies, materialize, numbered, scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str) -> Column:
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))


def source_key() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("long")


def before(*keys: str):
    return Window.partitionBy(*keys)


UP_TO = (Window.unboundedPreceding, -1)


def ranked(sources: DataFrame) -> DataFrame:
    """``k``: a source's number from 1 by code points, null last; in two levels, for sources may be as many as hosts."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*UP_TO)), F.lit(0)).alias("base"))  # one row a partition
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(base), "part").withColumn("k", F.col("base") + at).drop("part", "base")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``; one row a source.

    Each source gets its weight's part of ``share`` of all words, but ``most`` times its own size at most; what that leaves is
    dealt to the rest by weight. Each round finds the sources whose part is above their cap and sums what is left and
    who shares it; parts only grow, so a round finds no fewer than the last, and the search ends when it finds no more.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = materialize(ranked(sizes).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)), "caps")
    whole = t.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    budget = (whole["size"] or 0) * share
    left, rest, found = budget, whole["w"] or 0.0, 0
    full = lambda: F.lit(left) * F.col("w") > F.col("cap") * F.lit(rest)
    while True:
        now = t.filter(full()).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("w").alias("w")).first()
        if now["n"] <= found:
            break
        found, left, rest = now["n"], budget - now["cap"], whole["w"] - now["w"]
    target = F.when(full(), F.col("cap")).otherwise(F.col("w") * F.lit(left) / F.lit(rest)) if rest else F.col("cap")
    return t.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, buckets: int, weights, share: float, most: float) -> DataFrame:
    """Of each source: size and target, the passes that take it whole, and the last pass's cut: the key of the rows that it
    falls among (null if nothing is left for it), how many of them it takes whole, and the words that it takes of the next."""
    sums = materialize(sized.groupBy("src", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source")), "sums")
    sizes = sums.groupBy("src").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most).withColumn("src", source_key())
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0).cast("long"))
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal, "goal")
    base = sums.select("src", "bucket", "words", F.coalesce(F.sum("words").over(before("src").orderBy("bucket").rowsBetween(*UP_TO)), F.lit(0)).alias("base"))
    last = base.join(goal.select("src", "rest"), "src").filter((F.col("base") <= F.col("rest")) & (F.col("rest") < F.col("base") + F.col("words")) & (F.col("rest") > 0))
    rows = sized.join(last.select("src", "bucket", "base", "rest"), ["src", "bucket"]).filter("size > 0")
    keys = rows.groupBy("src", "key", "base", "rest", "size").agg(F.count("*").alias("n"))  # one bucket a source
    at = F.col("base") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(before("src").orderBy("key").rowsBetween(*UP_TO)), F.lit(0))
    keys = keys.withColumn("over", F.col("rest") - at).filter((F.col("over") >= 0) & (F.col("over") < F.col("n") * F.col("size")))
    cut = keys.select("src", F.col("key").alias("cut"), F.expr("over div size").alias("whole"), F.expr("over % size").alias("part"), "n")
    return materialize(goal.join(cut, "src", "left"), "plan")


def measure(docs: DataFrame, size: Column, seed: str) -> tuple[DataFrame, int]:
    """doc_id, source, size, key, src, bucket of each row, written once; how many buckets there are."""
    buckets = buckets_for(docs.count())
    rows = docs.select("doc_id", "source", size.alias("size"), order_key(seed).alias("key"))
    return materialize(rows.withColumn("src", source_key()).withColumn("bucket", bucket_of(F.col("key"), buckets)), "sized"), buckets


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, epochs.

    ``taken`` counts the words that the mix takes of the document: ``epochs`` whole passes of its source, and in the last,
    unfinished pass what lies before the cut.
    """
    with scratch(docs.sparkSession) as keep:
        sized, buckets = measure(docs, word_count(F.col("text")) if size is None else size, seed)
        goal = keep(plan(sized, buckets, weights, share, most))
        keep(sized)
    rows = sized.select("doc_id", "size", "src", "key").join(goal, "src")
    extra = F.when(F.col("key") < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    other = rows.filter(F.col("cut").isNull() | (F.col("key") != F.col("cut"))).withColumn("extra", extra)
    # rows at the cut are alike in all that is returned
    alike = rows.filter(F.col("key") == F.col("cut")).groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    nth = F.when(F.col("copy") < F.col("whole"), F.col("size")).when(F.col("copy") == F.col("whole"), F.col("part")).otherwise(F.lit(0))
    alike = copies(alike, "rows").withColumn("extra", nth)
    columns = ["doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "epochs"]
    return other.select(*columns).unionByName(alike.select(*columns))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix as documents with the columns of ``docs``: a document stands once for each whole pass that takes it, and
    the one at its source's cut once more with the words before the cut. Each row is judged by itself."""
    names = docs.columns
    with scratch(docs.sparkSession) as keep:
        sized, buckets = measure(docs, word_count(F.col("text")), seed)
        goal = keep(plan(sized, buckets, weights, share, most))
        mine = [F.col(c).alias(f"__mix_{c}") for c in ("src", "epochs", "cut", "whole", "part")]
        keyed = docs.withColumn("__mix_src", source_key()).withColumn("__mix_key", order_key(seed))
        rows = keyed.join(goal.select(*mine), "__mix_src")
        at_cut = F.coalesce(F.col("__mix_key") == F.col("__mix_cut"), F.lit(False))
        few = keep(materialize(rows.filter(at_cut).withColumn("__mix_row", F.monotonically_increasing_id()), "cut"))  # rows with one id and text for each source
        nth = numbered(few, ["__mix_src"], F.col("__mix_row"), "__mix_nth")
    has_words = F.col("text").rlike(WORD)
    often = (F.col("__mix_epochs") + F.coalesce(F.col("__mix_key") < F.col("__mix_cut"), F.lit(False)).cast("long"))
    other = rows.filter(~at_cut & has_words).withColumn("__mix_n", often).select(*names, "__mix_n")
    whole = nth.withColumn("__mix_n", F.col("__mix_epochs") + (F.col("__mix_nth") < F.col("__mix_whole")).cast("long")).select(*names, "__mix_n")
    every = other.unionByName(whole)
    every = every.withColumn("__mix_n", F.explode(F.array_repeat(F.lit(0), F.col("__mix_n").cast("int")))).select(*names)
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("__mix_part").cast("int")), "")
    parts = nth.filter((F.col("__mix_nth") == F.col("__mix_whole")) & (F.col("__mix_part") > 0))
    return every.unionByName(parts.select(*[head.alias(c) if c == "text" else F.col(f"`{c}`") for c in names]))


def op3_mix(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'), ':', md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
), w AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM k
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w
), f AS (
  SELECT *, (budget - caps) * w > cap * ws AS is_full FROM r
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap
         ELSE w * (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT is_full THEN w END) OVER () END AS target
  FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words - (words // source_size) * source_size - pos)) END::BIGINT AS taken
FROM p
"""
