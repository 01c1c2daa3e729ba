"""Each operator as a query on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import boxes as B
from lectern.operators import collate as C
from lectern.operators import context, evaluate, mcq, pages, segment, worklist
from lectern.sources import readers, sinks
from lectern.streaming.incremental import process_new
from lectern.workdir import work_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- evaluation


def _questions(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("aoi_count"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("course"), (F.col("o_orderstatus") == "F").alias("ok"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


_Q_SQL = """WITH q AS (SELECT o_orderpriority AS course, o_orderstatus = 'F' AS ok, c AS aoi_count FROM orders
JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE c > 1) """


@query(_Q_SQL + "SELECT course, " + ", ".join(f"count(*) FILTER (aoi_count >= {k}) AS questions_{k}, count(*) FILTER (aoi_count >= {k} AND ok) AS correct_{k}" for k in (2, 3, 4, 5)) + " FROM q GROUP BY 1")
def q01_eval_thresholds(spark, sf):
    return evaluate.thresholds(_questions(spark, sf))


@query(_Q_SQL + "SELECT round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS acc FROM q")
def q02_eval_summary(spark, sf):
    return evaluate.summary(evaluate.thresholds(_questions(spark, sf))).select(F.round("acc", 6).alias("acc"))


# ---- work lists


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def q03_missing(spark, sf):
    return worklist.missing(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing FROM documents")
def q03_missing_counts(spark, sf):
    return worklist.counts(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def q04_matched_pairs(spark, sf):
    return worklist.matched(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q29_todo_set(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return worklist.missing(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("""WITH p AS (SELECT d.source AS page, d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND d.source < 'src5'), f AS (SELECT source AS page, doc_id FROM documents)
SELECT page, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT * FROM p UNION ALL SELECT * FROM f WHERE page NOT IN (SELECT page FROM p)) GROUP BY 1""")
def q19_source_precedence(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("page"), "doc_id")
    good = docs.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id").filter("page < 'src5'").select("page", "doc_id")
    return worklist.whole_source(good, docs, ["page"]).groupBy("page").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


# ---- segmentation and pages


def _frames(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    before = Window.partitionBy("event_type").orderBy("ts", "event_id")
    made = events.withColumn("pash", F.floor(F.abs(F.col("value") - F.lag("value").over(before)))).withColumn("ssim", F.col("k") / 100.0)
    return made.withColumn("cut", segment.is_cut(F.col("pash"), F.col("ssim"), 120, 0.1))


_FRAMES = """WITH e AS (SELECT event_type, ts, event_id, floor(abs(value - lag(value) OVER w))::BIGINT AS pash, json_extract(props, '$.k')::INT / 100.0::DOUBLE AS ssim
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
c AS (SELECT *, coalesce(pash >= 120 OR (pash IS NOT NULL AND ssim < 0.1::DOUBLE), false) AS cut FROM e),
p AS (SELECT *, (1 + sum(cut::INT) OVER (PARTITION BY event_type ORDER BY ts, event_id))::INT AS page FROM c),
n AS (SELECT event_type, page, max(event_id) AS page_end FROM p GROUP BY 1, 2) """


@query(_FRAMES + "SELECT event_id, coalesce(pash, -1) AS pash, cut FROM c")
def q05_cut_flag(spark, sf):
    return _frames(spark, sf).select("event_id", F.coalesce("pash", F.lit(-1)).alias("pash"), "cut")


def _ends(spark, sf) -> DataFrame:
    return segment.page_ends(segment.number_pages(_frames(spark, sf), ["event_type"], ["ts", "event_id"]), ["event_type"], "event_id")


@query(_FRAMES + "SELECT * FROM n")
def q06_page_split(spark, sf):
    return _ends(spark, sf)


@query(_FRAMES + "SELECT c.event_id, arg_min(n.page, n.page_end) AS page FROM c JOIN n ON c.event_type = n.event_type AND n.page_end >= c.event_id GROUP BY 1")
def q07_page_asof(spark, sf):
    return pages.page_asof(table(spark, sf, "events").select("event_type", "event_id"), _ends(spark, sf), ["event_type"], "event_id").select("event_id", "page")


@query(_FRAMES.replace("WITH e AS", "WITH RECURSIVE e AS") + """, s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
f AS (SELECT event_type, 0::BIGINT AS r, NULL::BIGINT AS event_id, 1 AS page FROM (SELECT DISTINCT event_type FROM s)
UNION ALL SELECT s.event_type, s.r, s.event_id, CASE WHEN s.event_id > n.page_end THEN f.page + 1 ELSE f.page END
FROM f JOIN s ON s.event_type = f.event_type AND s.r = f.r + 1 LEFT JOIN n ON n.event_type = f.event_type AND n.page = f.page)
SELECT event_type, event_id, page FROM f WHERE r > 0""")
def q08_page_fold(spark, sf):
    some = table(spark, sf, "events").select("event_type", "event_id")
    return pages.page_fold(some, _ends(spark, sf), ["event_type"], "event_id")


# ---- context runs


def _runs(spark, sf, order: list[str]) -> DataFrame:
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    cues = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(ms).alias("mid"), "ts", "user_id", "event_id")
    cues = cues.withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy(*order)))
    runs = context.context_runs(cues, ["day"], 900_000)
    return runs.select(
        "day", "i", F.size("previous").alias("n_prev"), F.size("next").alias("n_next"),
        F.coalesce(F.try_element_at("previous", F.lit(1))["i"], F.lit(-1)).alias("first_j"), F.coalesce(F.try_element_at("next", F.lit(-1))["i"], F.lit(-1)).alias("last_j"),
    )


def _runs_sql(order: str) -> str:
    return f"""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, epoch_ms(ts) AS mid, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY {order})::INT AS i FROM events),
p AS (SELECT a.day, a.i, b.i AS j, abs(a.mid - b.mid) <= 900000 AS ok FROM c a LEFT JOIN c b ON a.day = b.day AND a.i <> b.i),
l AS (SELECT day, i, coalesce(max(j) FILTER (j < i AND NOT ok), -1) AS lo, coalesce(min(j) FILTER (j > i AND NOT ok), 1000000000) AS hi FROM p GROUP BY 1, 2)
SELECT p.day, p.i, (count(*) FILTER (ok AND j > lo AND j < p.i))::INT AS n_prev, (count(*) FILTER (ok AND j < hi AND j > p.i))::INT AS n_next,
coalesce(min(j) FILTER (ok AND j > lo AND j < p.i), -1) AS first_j, coalesce(max(j) FILTER (ok AND j < hi AND j > p.i), -1) AS last_j
FROM p JOIN l ON p.day = l.day AND p.i = l.i GROUP BY 1, 2"""


@query(_runs_sql("ts, event_id"))
def q09_context_run(spark, sf):
    return _runs(spark, sf, ["ts", "event_id"])


@query(_runs_sql("user_id, event_id"))
def q10_context_run_nonmono(spark, sf):
    return _runs(spark, sf, ["user_id", "event_id"])


@query("""SELECT conv_id, turn, coalesce('[-2]' || lag(text, 2) OVER w, '') || coalesce('[-1]' || lag(text) OVER w, '') || '[0]' || text
|| coalesce('[1]' || lead(text) OVER w, '') || coalesce('[2]' || lead(text, 2) OVER w, '') AS subtitle FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def q11_context_subtitle(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    around = lambda a, b: F.collect_list("text").over(w.rowsBetween(a, b))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.subtitle(around(-2, -1), F.col("text"), around(1, 2)).alias("subtitle"))


# ---- boxes


def _boxes(spark, sf) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    made = table(spark, sf, "embeddings").select(
        F.col("label").alias("page"), F.col("vec_id").alias("det_idx"), (500 + 1000 * e(0)).alias("cx"), (500 + 1000 * e(1)).alias("cy"),
        (20 + 400 * F.abs(e(2))).alias("w"), (20 + 400 * F.abs(e(3))).alias("h"), F.least(F.lit(1.0), F.abs(e(4)) * 5).alias("score"),
    )
    half = lambda c, s: F.col(c) - F.col(s) / 2
    return made.select("page", "det_idx", "score", half("cx", "w").alias("x1"), half("cy", "h").alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))


_BOXES = """WITH b0 AS (SELECT label AS page, vec_id AS det_idx, 500 + 1000 * embedding[1]::DOUBLE AS cx, 500 + 1000 * embedding[2]::DOUBLE AS cy,
20 + 400 * abs(embedding[3]::DOUBLE) AS w, 20 + 400 * abs(embedding[4]::DOUBLE) AS h, least(1::DOUBLE, abs(embedding[5]::DOUBLE) * 5) AS score FROM embeddings),
b AS (SELECT page, det_idx, score, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM b0) """


@query(_BOXES + """, g AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM b WHERE score > 0.5::DOUBLE)
SELECT page, det_idx, row_number() OVER (PARTITION BY page ORDER BY det_idx)::INT - 1 AS aoi_idx FROM g a WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.page = a.page AND o.det_idx <> a.det_idx AND a.area < o.area AND a.area > 0
AND greatest(0::DOUBLE, least(a.x2, o.x2) - greatest(a.x1, o.x1)) * greatest(0::DOUBLE, least(a.y2, o.y2) - greatest(a.y1, o.y1)) / a.area >= 0.7::DOUBLE)""")
def q12_overlap_suppress(spark, sf):
    return B.reindex(B.suppress_contained(_boxes(spark, sf), ["page"]), ["page"]).select("page", "det_idx", "aoi_idx")


@query(_BOXES + """, pt AS (SELECT page, det_idx AS pt, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py FROM b),
h AS (SELECT pt.page, pt.pt, b.det_idx, sqrt((px - (x1 + x2) / 2) * (px - (x1 + x2) / 2) + (py - (y1 + y2) / 2) * (py - (y1 + y2) / 2)) AS d
FROM pt JOIN b ON pt.page = b.page AND pt.pt <> b.det_idx AND px BETWEEN x1 - (x2 - x1) * 0.2::DOUBLE AND x2 + (x2 - x1) * 0.2::DOUBLE AND py BETWEEN y1 - (y2 - y1) * 0.2::DOUBLE AND y2 + (y2 - y1) * 0.2::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY page, pt ORDER BY d, det_idx) AS r FROM h)
SELECT pt.page, pt.pt, coalesce(r.det_idx, -1)::BIGINT AS ans FROM pt LEFT JOIN r ON pt.page = r.page AND pt.pt = r.pt AND r.r = 1""")
def q13_laser_nearest(spark, sf):
    held = _boxes(spark, sf).withColumnRenamed("det_idx", "aoi_idx")
    px, py = G.centre(G.Box.named())
    points = held.select("page", F.col("aoi_idx").alias("pt"), px.alias("px"), py.alias("py"))
    return B.nearest_box(points, held, ["page"], ["pt"], exclude=F.col("aoi_idx") != F.col("pt")).select("page", "pt", "ans")


@query("""SELECT vec_id, list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)[-1] AS last_conf, list_max(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)) AS top_conf FROM embeddings""")
def q14_last_positive(spark, sf):
    conf = F.transform("embedding", lambda x: x.cast("double"))
    found = B.zip_detections(conf, F.transform(conf, lambda x: F.array(x)), conf)
    return table(spark, sf, "embeddings").select("vec_id", B.last_positive(found)["conf"].alias("last_conf"), B.strongest(found)["conf"].alias("top_conf"))


@query("SELECT name, count(*) AS n FROM embeddings JOIN (SELECT unnest(range(6)) AS k, unnest(['image', 'math', 'plot', 'table', 'text', 'title']) AS name) ON vec_id % 6 = k GROUP BY 1")
def q15_box_class_count(spark, sf):
    classes = spark.createDataFrame(list(enumerate(schemas.CLASSES)), "k long, name string")
    return table(spark, sf, "embeddings").select((F.col("vec_id") % 6).alias("k")).join(F.broadcast(classes), "k").groupBy("name").agg(F.count("*").alias("n"))


@query(_BOXES + "SELECT det_idx, round_even(x1, 0)::BIGINT AS x1, round_even(y1, 0)::BIGINT AS y1, round_even(x2, 0)::BIGINT AS x2, round_even(y2, 0)::BIGINT AS y2 FROM b")
def q16_bround_boxes(spark, sf):
    b = G.rounded(G.Box.named())
    return _boxes(spark, sf).select("det_idx", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"))


@query("SELECT a.vec_id, bit_count(xor(a.vec_id, a.vec_id * 2654435761 % 4294967296))::INT AS hamming FROM embeddings a")
def q30_phash_hamming(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", G.hamming(F.col("vec_id"), F.col("vec_id") * 2654435761 % 4294967296).alias("hamming"))


# ---- descriptions


def _raw(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    body = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") % 2 == 1), "").otherwise(F.col("text"))
    chunk = F.concat(F.lit("\n\nImage "), (F.col("turn") % 2).cast("string"), F.lit(": **"), body, F.lit("**\n[END]"))
    parts = F.array_sort(F.collect_list(F.struct("turn", chunk.alias("c"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("raw"))


_FOUND = r"""WITH f AS (SELECT conv_id, (turn % 2)::INT AS k, arg_max(regexp_replace(regexp_replace(regexp_replace('**' || CASE WHEN conv_id % 7 = 0 AND turn % 2 = 1 THEN '' ELSE text END || '**', '^\s+|\s+$', '', 'g'), '^\*+|\*+$', '', 'g'), '^\s+|\s+$', '', 'g'), turn) AS body
FROM conversations GROUP BY 1, 2) """


@query(_FOUND + "SELECT conv_id, k, body FROM f")
def q17_desc_extract(spark, sf):
    return _raw(spark, sf).select("conv_id", F.explode(T.descriptions(F.col("raw"))).alias("d")).select("conv_id", F.col("d.k").alias("k"), F.col("d.body").alias("body"))


@query(_FOUND + ", p AS (SELECT conv_id, count(*) = 2 AND count(*) FILTER (body = '') = 0 AS ok FROM f GROUP BY 1) SELECT count(*) AS pages, (2 * count(*))::BIGINT AS boxes, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (NOT ok) / count(*)::DOUBLE AS ratio FROM p")
def q18_desc_audit(spark, sf):
    return evaluate.audit(_raw(spark, sf).select("conv_id", T.descriptions(F.col("raw")).alias("found"), F.lit(2).alias("expected")))


@query(_FOUND + ", p AS (SELECT conv_id, count(*) AS n, min(k) FILTER (body = '') AS e FROM f GROUP BY 1) SELECT conv_id, CASE WHEN n = 2 THEN e END AS aoi_key FROM p WHERE n <> 2 OR e IS NOT NULL")
def q18_desc_errors(spark, sf):
    return evaluate.audit_errors(_raw(spark, sf).select("conv_id", T.descriptions(F.col("raw")).alias("found"), F.lit(2).alias("expected")), "conv_id")


# ---- multiple choice


def _options(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("aoi_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    made = mcq.gathered(turns, ["conv_id"], "text").filter("gapless")
    made = made.withColumn("label", (F.col("conv_id") % F.size("options")).cast("int")).withColumn("split", F.when(F.col("conv_id") % 4 == 0, "valid").otherwise("train"))
    return made.withColumn("shown", mcq.reorder(F.col("options"), F.col("conv_id"), F.col("split") == "train")).withColumn("moved", mcq.relabel(F.col("options"), F.col("label"), F.col("shown")).cast("int"))


_OPTIONS = """WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 4 = 0 THEN 0 ELSE (conv_id * 7919 + i * 104729) % 1000003 END, i) - 1 AS o FROM t),
o AS (SELECT conv_id, any_value(n)::INT AS n, list(text ORDER BY i) AS options, list(text ORDER BY o) AS shown FROM s GROUP BY 1),
m AS (SELECT *, (conv_id % n)::INT AS label, list_position(shown, options[(conv_id % n)::INT + 1])::INT - 1 AS moved, CASE WHEN conv_id % 4 = 0 THEN 'valid' ELSE 'train' END AS split FROM o) """


@query(_OPTIONS + "SELECT conv_id, n AS n_options, label, moved, shown[1] AS first_option FROM m")
def q20_mcq_options(spark, sf):
    return _options(spark, sf).select("conv_id", F.size("options").alias("n_options"), "label", "moved", F.col("shown")[0].alias("first_option"))


_quote = lambda s: "'" + s.replace("'", "''") + "'"


@query(_OPTIONS + f""", l AS (SELECT s.conv_id, string_agg(chr(10) || o || ':"' || text || '"', '' ORDER BY o) AS lines FROM s GROUP BY 1)
SELECT m.conv_id, md5({_quote(mcq.PROMPT_HEAD)} || options[1] || {_quote(mcq.PROMPT_TAIL)} || lines) AS prompt_md5, {_quote(T.ANSWER_HEAD)} || moved || '"' AS answer, split FROM m JOIN l USING (conv_id) WHERE n > 1""")
def q21_mcq_prompt(spark, sf):
    some = _options(spark, sf).filter(F.size("options") > 1)
    return some.select("conv_id", F.md5(mcq.prompt(F.col("options")[0], F.col("shown"))).alias("prompt_md5"), T.answer(F.col("moved")).alias("answer"), "split")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 7 END::INT AS label FROM documents")
def q22_answer_parse(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    said = F.when(F.col("doc_id") % 5 == 0, F.lit('最可能對應的是:"none"')).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(T.ANSWER_HEAD + " "), F.col("doc_id") % 7, F.lit(' "'))).otherwise(T.answer(F.col("doc_id") % 7))
    return docs.select("doc_id", T.parse_answer(said).alias("label"))


# ---- scalars


@query("""WITH s AS (SELECT DISTINCT l_quantity, l_quantity * 37.123::DOUBLE AS s FROM lineitem),
c AS (SELECT l_quantity, floor(s)::BIGINT AS w, floor((s - floor(s)) * 1000)::BIGINT AS ms FROM s)
SELECT l_quantity, printf('%02d:%02d:%02d,%03d', w // 3600, w % 3600 // 60, w % 60, ms) AS code, w * 1000 + ms AS ms, (w * 1000 + ms + 4001) // 2 AS mid, (w * 1000 + ms + 4001) // 2000 AS second, greatest(0, w * 1000 + ms - 15000) AS shifted FROM c""")
def q23_timecodes(spark, sf):
    made = table(spark, sf, "lineitem").select("l_quantity").distinct().withColumn("code", tc.format_seconds(F.col("l_quantity") * 37.123)).withColumn("ms", tc.parse_ms(F.col("code")))
    return made.select("l_quantity", "code", "ms", tc.midpoint_ms(F.col("ms"), F.lit(4001)).alias("mid"), tc.screenshot_second(F.col("ms"), F.lit(4001)).alias("second"), tc.shift_ms(F.col("ms"), -15).alias("shifted"))


@query(r"""WITH u AS (SELECT page_id, url, translate(url, '|/\.:', '') AS clean, split_part(url, '/', -1) AS base FROM pages)
SELECT page_id, clean, split_part(base, '.', 1) AS stem, regexp_replace(base, '\.[^.]*$', '') AS stem_last, base, NOT (contains(clean, 'QA') OR contains(clean, 'TA') OR contains(clean, 'Homework') OR contains(clean, '助教') OR contains(clean, 'Guest')) AS allowed FROM u""")
def q24_titles(spark, sf):
    base = T.basename(F.col("url"))
    return table(spark, sf, "pages").select("page_id", T.sanitize_title(F.col("url")).alias("clean"), T.stem_first(base).alias("stem"), T.stem_last(base).alias("stem_last"), base.alias("base"), T.allowed_title(F.col("url")).alias("allowed"))


@query(r"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS i, turn * 1500 AS start_ms, turn * 1500 + 1250 AS end_ms, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations""")
def q25_srt_render_parse(spark, sf):
    flat = F.regexp_replace("text", r"\s+", " ")
    cues = table(spark, sf, "conversations").select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("i"), (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.25).alias("end"), flat.alias("text"))
    return readers.parse_cues(sinks.render_srt(cues, "conv_id"), "conv_id")


def _codes(spark, sf) -> DataFrame:
    pages_ = table(spark, sf, "pages")
    return pages_.select("page_id", F.transform(F.filter(F.split("url", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")).alias("ids"))


@query("""WITH c AS (SELECT page_id // 8 AS batch, list_transform(string_split(url, ''), lambda x: unicode(x)::BIGINT) AS ids FROM pages),
b AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM c)
SELECT batch, max(longest)::INT AS longest, count(*)::INT AS n_rows, sum(list_sum(ids))::BIGINT AS total, sum(len(ids))::BIGINT AS kept, sum(longest - len(ids))::BIGINT AS padding FROM b GROUP BY 1""")
def q26_pad_collate(spark, sf):
    made = C.collate(_codes(spark, sf).withColumn("batch", F.expr("page_id div 8")), "batch", "page_id")
    flat, mask = F.flatten("input_ids"), F.flatten("attention_mask")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return made.select("batch", "longest", F.size("input_ids").alias("n_rows"), total(flat).alias("total"), total(mask).alias("kept"), (F.size(flat).cast("bigint") - total(mask)).alias("padding"))


@query("""WITH c AS (SELECT page_id, list_transform(string_split(url, ''), lambda x: unicode(x)::BIGINT) AS ids, (page_id % 60)::INT AS p FROM pages),
l AS (SELECT page_id, p, list_concat(list_transform(range(p), lambda x: -100::BIGINT), ids)[1:50] AS labels FROM c)
SELECT page_id, len(labels)::INT AS n, CASE WHEN p >= 50 THEN 49 * -100 + 50256 ELSE list_sum(labels) END::BIGINT AS total FROM l""")
def q27_label_mask(spark, sf):
    made = _codes(spark, sf).select("page_id", C.labels((F.col("page_id") % 60).cast("int"), F.col("ids"), F.lit(50256), 50).alias("labels"))
    return made.select("page_id", F.size("labels").alias("n"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


@query("SELECT lang, round(avg((CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END = lang)::INT), 6) AS acc FROM documents GROUP BY 1")
def q28_vlm_accuracy(spark, sf):
    noisy = F.when(F.col("doc_id") % 3 == 0, F.lit("XX")).otherwise(F.concat(F.lit(" \t"), F.upper("lang"), F.lit("\n")))
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(evaluate.accuracy(noisy, F.col("lang")), 6).alias("acc"))


@query("SELECT conv_id, turn, role, length(text)::INT AS n FROM conversations")
def q31_nested_roundtrip(spark, sf):
    nested = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items"))
    text = nested.select(sinks.to_document("conv_id", "items").alias("value"))
    back = text.select(F.from_json("value", "conv_id bigint, items array<struct<turn:bigint,role:string,text:string>>").alias("d"))
    return back.select("d.conv_id", F.explode("d.items").alias("x")).select("conv_id", "x.turn", "x.role", F.length("x.text").alias("n"))


@query("SELECT event_id, event_type, value FROM events")
def q32_incremental(spark, sf):
    out, mark = work_path(spark, "incremental"), work_path(spark, "incremental-state")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.read.parquet(f"{sf}/events.parquet").inputFiles()
    one_file = len(source) == 1 and source[0].endswith("events.parquet")
    folder = sf if one_file else f"{sf}/events.parquet"
    step = lambda d: d.select("event_id", "event_type", "value")
    for _ in range(2):  # the second run finds nothing new
        process_new(spark, folder, "events.parquet" if one_file else "*.parquet", schema, out, mark, step)
    return spark.read.schema("event_id bigint, event_type string, value double").parquet(out)


# ---- breadth beyond the reference: plain Spark on the star schema


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def z01_pricing_summary(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def z02_shipping_priority(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.round(F.sum("net"), 2).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def z03_forecast(spark, sf):
    return table(spark, sf, "lineitem").filter("l_discount between 0.05D and 0.07D and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def z04_nation_balance(spark, sf):
    nations = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def z05_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, coalesce(p_size, -1) AS p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def z06_cube(spark, sf):
    return table(spark, sf, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n")).withColumn("p_size", F.coalesce("p_size", F.lit(-1)))


@query("""SELECT * FROM (SELECT p_brand, p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INT AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INT AS d FROM part) WHERE r <= 3""")
def z07_rank(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return table(spark, sf, "part").select("p_brand", "p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d")).filter("r <= 3")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def z08_except(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def z09_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def z10_tumbling(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def z11_pivot(spark, sf):
    made = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return made.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) SELECT user_id, k::BIGINT AS session, count(*) AS events FROM k GROUP BY 1, 2""")
def z12_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    made = table(spark, sf, "events").withColumn("new", F.when(gap > 6 * 3600, 1).when(gap.isNull(), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return made.groupBy("user_id", "session").agg(F.count("*").alias("events"))
