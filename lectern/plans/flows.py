"""More operators as queries on the driver's tables: file layouts as round trips, predicates, text functions, model seams, stages."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import boxes as B
from lectern.operators import collate as C
from lectern.operators import mcq, models, pages, samples, segment, worklist
from lectern.plans import pipeline
from lectern.plans.catalogue import _BOXES, _FRAMES, _boxes, _ends, _frames, query, table
from lectern.sources import readers, sinks
from lectern.workdir import work_path

# ---- sources and sinks as round trips


@query("SELECT n_nationkey, n_name FROM nation")
def q33_csv_roundtrip(spark, sf):
    path = work_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return readers.csv(spark, path, "n_nationkey int, n_name string")


@query("SELECT 'r_regionkey,r_name' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region UNION ALL SELECT n_nationkey || ',' || n_name FROM nation")
def q34_csv_append(spark, sf):
    path = work_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "region").select("r_regionkey", "r_name"), path)
    sinks.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, append=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT conv_id, turn, length(text)::INT AS n FROM conversations")
def q35_json_documents(spark, sf):
    path = work_path(spark, "documents")
    nested = table(spark, sf, "conversations").groupBy((F.col("conv_id") % 16).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("items"))
    sinks.write_texts(nested.select("bucket", sinks.to_document("items").alias("value")).coalesce(1), path, "bucket")
    back = readers.documents(spark, path, "items array<struct<conv_id:bigint,turn:bigint,text:string>>")
    return back.select(F.explode("items").alias("x")).select("x.conv_id", "x.turn", F.length("x.text").alias("n"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q36_json_array(spark, sf):
    with tempfile.TemporaryDirectory() as folder:  # the exporter's file is the driver's
        path = os.path.join(folder, "a.json")
        sinks.export_array(table(spark, sf, "nation"), path)
        with open(path, encoding="utf-8") as f:
            rows = [(x["n_nationkey"], x["n_name"], x["n_regionkey"]) for x in json.load(f)]
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")


def _of_path(name: str):
    return F.regexp_extract("path", f"{name}=([^/]*)", 1).alias(name)


@query(_FRAMES + "SELECT event_type, page, page_end::INT AS page_end FROM n")
def q37_page_map(spark, sf):
    path = work_path(spark, "pages")
    sinks.write_texts(sinks.page_map(_ends(spark, sf), "event_type").coalesce(1), path, "event_type")
    return readers.page_ends(spark, path).select(_of_path("event_type"), "page", "page_end")


@query(_FRAMES + "SELECT event_type, event_id::INT AS screenshot_id, pash, ssim FROM c WHERE pash IS NOT NULL")
def q38_compare_map(spark, sf):
    path = work_path(spark, "compare")
    rows = _frames(spark, sf).filter("pash is not null").withColumnRenamed("event_id", "screenshot_id")
    sinks.write_texts(sinks.compare_map(rows, "event_type").coalesce(1), path, "event_type")
    back = readers.map_rows(spark, path, "struct<pash:bigint,ssim:double>")
    return back.select(_of_path("event_type"), F.col("key").alias("screenshot_id"), "value.pash", "value.ssim")


@query(_BOXES + "SELECT page, row_number() OVER (PARTITION BY page ORDER BY det_idx)::INT - 1 AS aoi_idx, x1, y2, score, page % 6 AS class FROM b")
def q39_aoi_document(spark, sf):
    path = work_path(spark, "aoi")
    rows = B.reindex(_boxes(spark, sf), ["page"]).withColumn("class", (F.col("page") % 6).cast("int")).withColumn("shape", F.array(F.lit(1), F.lit(2)))
    sinks.write_texts(sinks.aoi_document(rows, "page").coalesce(1), path, "page")
    back = readers.aoi(spark, path)
    return back.select(_of_path("page").cast("int").alias("page"), "aoi_idx", F.col("boxes")[0].alias("x1"), F.col("boxes")[3].alias("y2"), "score", "class")


@query("SELECT doc_id, lang, quality, coalesce(CASE WHEN doc_id % 2 = 0 THEN quality END, toxic) AS toxic FROM documents JOIN labels USING (doc_id)")
def q40_update_in_place(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    new = old.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("quality")).alias("toxic"))
    return sinks.updated(old, new, ["doc_id"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN n_name END AS value FROM nation")
def q41_text_or_missing(spark, sf):
    path = work_path(spark, "texts")
    nations = table(spark, sf, "nation")
    sinks.write_texts(nations.filter("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("value")).coalesce(1), path, "n_nationkey")
    found = readers.whole_text(spark, path).select(_of_path("n_nationkey").cast("int").alias("n_nationkey"), T.strip(F.col("value")).alias("value"))
    return readers.with_missing(nations.select("n_nationkey"), found, ["n_nationkey"])


_LAYOUT = "WITH d AS (SELECT DISTINCT 'c=' || s_nationkey AS course, 'v=' || s_suppkey % 3 AS video FROM supplier) "


def _layout(spark, sf) -> str:
    path = work_path(spark, "layout")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c"), (F.col("s_suppkey") % 3).alias("v"), F.col("s_name").alias("value"))
    sinks.write_texts(rows.coalesce(1), path, "c", "v")
    return path


@query(_LAYOUT + "SELECT course, count(*) AS files FROM d GROUP BY 1")
def q42_scan_cardinality(spark, sf):
    return readers.cardinality(readers.scan(spark, _layout(spark, sf), "*.txt"), "course")


@query(_LAYOUT + "SELECT course, video FROM d WHERE course IN (SELECT course FROM d WHERE video = 'v=0')")
def q43_entities_with_sibling(spark, sf):
    files = readers.ending(readers.entities(spark, _layout(spark, sf)), ".txt")
    return readers.folders(readers.beside(files, files.filter("video = 'v=0'"), ["course"]))


@query("SELECT 0::BIGINT AS n")
def q44_missing_root(spark, sf):
    return readers.entities(spark, work_path(spark, "nowhere")).agg(F.count("*").alias("n"))


@query(_LAYOUT + "SELECT course, video, row_number() OVER (ORDER BY course, video)::INT AS r FROM d")
def q45_names_in_order(spark, sf):
    files = readers.by_name(readers.scan(spark, _layout(spark, sf), "*.txt"))
    return files.select("course", "video", F.row_number().over(Window.orderBy("course", "video", "name")).alias("r"))


@query("SELECT 'screenshot_' || event_id || '.jpg' AS name, event_id::INT AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS r FROM events")
def q46_numbers_in_names(spark, sf):
    named = table(spark, sf, "events").select("event_type", F.concat(F.lit("screenshot_"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("name"))
    number = T.trailing_number(F.col("name"))
    return named.select("name", number.alias("id"), F.row_number().over(Window.partitionBy("event_type").orderBy(number)).alias("r"))


@query("SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def q47_routed(spark, sf):
    path = work_path(spark, "routed")
    sinks.routed(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("course"), "o_orderkey"), path, ("1-URGENT",))
    return spark.read.schema("course string, o_orderkey bigint, split string").json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT s.n_nationkey || '' AS name, upper(s.n_name) AS title FROM nation s WHERE NOT (contains(n_name, 'QA') OR contains(n_name, 'TA') OR contains(n_name, 'Homework') OR contains(n_name, '助教') OR contains(n_name, 'Guest'))")
def q48_playlist(spark, sf):
    names = {str(r["n_nationkey"]): r["n_name"] for r in table(spark, sf, "nation").collect()}  # 25 rows
    listing = models.fake(lambda url: [{"title": f"{names[url]}.|", "url": url}])
    found = readers.playlist(spark, [(k, k) for k in names], listing)
    return found.select(F.col("course").alias("name"), F.upper("title").alias("title"))


# ---- filters and joins


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0")
def q49_with_screenshot(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return worklist.existing(events, events.filter("event_id % 7 <> 0"), ["event_id"])


@query("SELECT page_id FROM pages WHERE contains(url, '.org')")
def q50_contains_suffix(spark, sf):
    return table(spark, sf, "pages").filter(F.col("url").contains(".org")).select("page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 - 1 ELSE doc_id % 5 - 1 END::INT AS ans FROM documents WHERE CASE WHEN doc_id % 4 = 0 THEN doc_id % 3 - 1 ELSE doc_id % 5 - 1 END <> -1")
def q51_answerable(spark, sf):
    docs = table(spark, sf, "documents")
    new = docs.select("doc_id", (F.col("doc_id") % 5 - 1).cast("int").alias("ans"))
    old = docs.filter("doc_id % 4 = 0").select("doc_id", (F.col("doc_id") % 3 - 1).cast("int").alias("ans"))
    return sinks.updated(new, old, ["doc_id"]).filter(F.col("ans") != -1)


@query(_BOXES + "SELECT det_idx, x1 >= 300 AND y1 >= 300 AND x2 <= 700 AND y2 <= 700 AS fits FROM b")
def q52_box_in_box(spark, sf):
    outer = G.Box(*map(F.lit, (300.0, 300.0, 700.0, 700.0)))
    return _boxes(spark, sf).select("det_idx", G.holds_box(outer, G.Box.named()).alias("fits"))


@query("""WITH r AS (SELECT conv_id, string_agg('Image ' || turn || ': ' || CASE WHEN turn % 5 = 4 THEN '' ELSE text END || CASE WHEN turn % 2 = 0 THEN ' [END]' ELSE '[END]' END, chr(10) ORDER BY turn) AS raw, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, (len(string_split(raw, 'Image ')) - 1)::DOUBLE AS chunks, len(string_split(raw, 'Image ')) - 1 = n AND NOT contains(raw, ': [END]') AS ok FROM r""")
def q53_model_output_validity(spark, sf):
    body = F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text"))
    chunk = F.concat(F.lit("Image "), F.col("turn").cast("string"), F.lit(": "), body, F.when(F.col("turn") % 2 == 0, " [END]").otherwise("[END]"))
    parts = F.array_sort(F.collect_list(F.struct("turn", chunk.alias("c"))))
    made = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["c"]), "\n").alias("raw"), F.count("*").alias("n"))
    return made.select("conv_id", T.occurrences(F.col("raw"), "Image ").alias("chunks"), T.valid_model_output(F.col("raw"), F.col("n")).alias("ok"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q54_not_detected_yet(spark, sf):
    done = table(spark, sf, "labels").filter("quality = 1")
    return pipeline.without(table(spark, sf, "documents").select("doc_id"), {"detections": done}, "detections", ["doc_id"])


@query("SELECT conv_id, turn, 'system' AS first_role, text AS question FROM conversations")
def q55_messages(spark, sf):
    made = table(spark, sf, "conversations").select("conv_id", "turn", pipeline.messages_of(F.col("text")).alias("m"))
    back = F.from_json("m", "array<struct<role:string,content:string>>")
    return made.select("conv_id", "turn", back[0]["role"].alias("first_role"), back[1]["content"].alias("question"))


@query("""WITH e AS (SELECT event_type, event_id, event_id % 3 AS shape, lag(event_id % 3) OVER (PARTITION BY event_type ORDER BY event_id) AS before, event_id % 64 AS pash FROM events),
f AS (SELECT *, CASE WHEN shape <> before THEN -1 WHEN before IS NOT NULL THEN pash END AS p FROM e)
SELECT event_id, coalesce(p, -2)::BIGINT AS pash, coalesce(p <> -1 AND p >= 20, false) AS cut FROM f""")
def q56_shape_change_never_cuts(spark, sf):
    before = Window.partitionBy("event_type").orderBy("event_id")
    shape = F.col("event_id") % 3
    made = table(spark, sf, "events").withColumn("last", F.lag(shape).over(before))
    p, s = segment.compared(F.col("event_id") % 64, F.lit(0.9), shape, F.col("last"))
    made = made.withColumn("p", p.cast("bigint")).withColumn("s", s)
    return made.select("event_id", F.coalesce("p", F.lit(-2)).cast("bigint").alias("pash"), segment.is_cut(F.col("p"), F.col("s")).alias("cut"))


@query(_FRAMES.replace("WITH e AS", "WITH b1 AS (SELECT unnest(range(1, 5)) AS k UNION ALL SELECT 2), e AS") + "SELECT n.event_type, n.page, CASE WHEN n.page_end % 2 = 0 THEN 's' || n.page_end END AS path, (SELECT count(*) FROM b1 WHERE b1.k = n.page)::INT AS crops FROM n")
def q57_page_images_and_crops(spark, sf):
    ends = _ends(spark, sf)
    seen = table(spark, sf, "events").filter("event_id % 2 = 0").select("event_type", F.col("event_id").alias("screenshot_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("path"))
    shown = pages.link_pages(ends, seen, ["event_type"])
    crops = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (3, 0, "d"), (4, 0, "e")], "page int, aoi_idx int, path string")
    return pages.with_crops(shown, crops, ["page"]).select("event_type", "page", "path", F.size("crops").alias("crops"))


@query("""WITH l AS (SELECT conv_id, list(text ORDER BY turn) AS texts, count(*)::INT AS n FROM conversations GROUP BY 1)
SELECT conv_id, (CASE WHEN n > 1 THEN '[-1]' || texts[1] ELSE '' END) || '[0]' || texts[least(n, 2)] || (CASE WHEN n > 2 THEN '[1]' || texts[3] ELSE '' END) AS subtitle FROM l""")
def q58_text_by_ordinal(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("turn", "text")))
    made = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(items, lambda x: x["text"]).alias("texts"))
    one = lambda k, there: F.when(there, F.array(F.struct(F.lit(k).alias("text_id")))).otherwise(F.array().cast("array<struct<text_id:int>>"))
    n = F.size("texts")
    made = made.withColumn("previous", one(0, n > 1)).withColumn("current", F.least(n, F.lit(2)) - 1).withColumn("next", one(2, n > 2))
    return made.select("conv_id", mcq.subtitles(made).alias("subtitle"))


# ---- windows and aggregates


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS mid, lag(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS before FROM events),
d AS (SELECT event_id, mid - before AS ms, abs(mid - before) AS a FROM e WHERE before IS NOT NULL)
SELECT event_id, CASE WHEN ms < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d,%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) AS time FROM d""")
def q59_signed_times(spark, sf):
    w = Window.partitionBy("event_type").orderBy("user_id", "event_id")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    made = table(spark, sf, "events").withColumn("mid", ms).withColumn("before", F.lag("mid").over(w)).filter("before is not null")
    return made.select("event_id", tc.format_ms(F.col("mid") - F.col("before")).alias("time"))


@query("SELECT role AS course, count(DISTINCT conv_id)::INT AS videos, count(*)::INT AS contexts FROM conversations GROUP BY 1")
def q60_nested_courses(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("role").alias("course"), F.col("conv_id").alias("video"), F.col("turn").cast("int").alias("screenshot_id"), "text", F.length("text").alias("current"))
    texts = pipeline.texts_of(rows.withColumnRenamed("screenshot_id", "i"))
    made = pipeline.courses(pipeline.nested(rows.drop("text"), texts))
    total = F.aggregate(F.transform("videos", lambda v: F.size(v["result"]["context_list"])), F.lit(0), lambda a, b: a + b)
    return made.select("course", F.size("videos").alias("videos"), total.alias("contexts"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 10007 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def q61_best_stream(spark, sf):
    streams = table(spark, sf, "events").select("user_id", "event_id", F.struct((F.col("event_id") * 7919 % 10007).alias("rate"), "event_id").alias("bitrate"))
    return worklist.best_stream(streams, ["user_id"]).select("user_id", "event_id")


@query("SELECT source, count(*) AS files, count(*) FILTER (doc_id % 5 <> 0) AS done FROM documents GROUP BY 1 HAVING count(*) <> count(*) FILTER (doc_id % 5 <> 0)")
def q62_incomplete_folders(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    wanted, have = readers.cardinality(docs, "source"), readers.cardinality(docs.filter("doc_id % 5 <> 0"), "source").withColumnRenamed("files", "done")
    return readers.with_missing(wanted, have, ["source"]).withColumn("done", F.coalesce("done", F.lit(0))).filter("files <> done")


# ---- text


@query("""WITH u AS (SELECT page_id, url, url || '.mp4.json' AS name FROM pages)
SELECT page_id, replace(name, '.mp4', '') AS no_mp4, left(name, length(name) - 4) AS cut, replace('Describe :' || url || 'Describe :', 'Describe :', '') AS told, replace(url || '|end|>', '|end|>', '') AS said, rtrim(url || 'xt|>', '<|endoftext>') AS trimmed FROM u""")
def q63_suffixes(spark, sf):
    url = F.col("url")
    name = F.concat(url, F.lit(".mp4.json"))
    return table(spark, sf, "pages").select(
        "page_id", T.drop_anywhere(name, ".mp4").alias("no_mp4"), T.cut_end(name, 4).alias("cut"), T.drop_literal(F.concat(F.lit(T.DESCRIBE), url, F.lit(T.DESCRIBE)), T.DESCRIBE).alias("told"),
        T.clean_output(F.concat(url, F.lit(T.STOP))).alias("said"), T.rstrip_chars(F.concat(url, F.lit("xt|>")), T.END_OF_TEXT).alias("trimmed"),
    )


@query("""WITH l AS (SELECT conv_id, string_agg('Image ' || r || ':' || text || '[END]' || chr(10), '' ORDER BY r) || '|end|><|endoftext|>' AS answer, string_agg('<|image_' || (r + 2) || '|>', '' ORDER BY r) AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations) GROUP BY 1) SELECT * FROM l""")
def q64_answer_and_tags(spark, sf):
    items = F.array_sort(F.collect_list(F.struct("turn", "text")))
    made = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(items, lambda x: x["text"]).alias("texts"))
    return made.select("conv_id", T.model_answer(F.col("texts")).alias("answer"), T.image_tags(F.size("texts")).alias("tags"))


# ---- numbers and arrays


@query("SELECT part.p_partkey, CASE WHEN p_size * 40 > 480 THEN 480.0::DOUBLE / (p_size * 40) ELSE 1.0::DOUBLE END AS factor, p_size + p_retailprice / 2 AS x, p_size * 2.0::DOUBLE + 7 AS y FROM part")
def q65_scale_and_anchor(spark, sf):
    xywh = F.array(F.col("p_size").cast("double"), F.col("p_size") * 2.0, F.col("p_retailprice"), F.lit(7.0))
    x, y = G.laser_anchor(xywh)
    return table(spark, sf, "part").select("p_partkey", G.scale_to(F.col("p_size") * 40, 480).alias("factor"), x.alias("x"), y.alias("y"))


@query("SELECT conv_id % 4 AS g, max(l)::INT AS longest, count(*)::INT AS n, sum(l)::BIGINT AS kept FROM (SELECT conv_id, least(turn, 9) + 1 AS l FROM conversations) GROUP BY 1")
def q66_stacked_batches(spark, sf):
    ids = F.array_repeat(F.lit(1).cast("bigint"), (F.least(F.col("turn"), F.lit(9)) + 1).cast("int"))
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("g"), "conv_id", F.col("turn").alias("o"), ids.alias("ids"))
    batches = C.collate(rows.withColumn("b", F.col("conv_id")), "b", "o").join(rows.select("g", F.col("conv_id").alias("b")).distinct(), "b")
    made = C.stack(batches.select("g", F.col("b").alias("o"), "input_ids"), "g", "o")
    flat = F.flatten("input_ids")
    return made.select("g", "longest", F.size("input_ids").alias("n"), F.aggregate(flat, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("kept"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r FROM conversations),
l AS (SELECT conv_id, count(*)::INT AS n, string_agg('Image ' || r || ':' || text || '[END]' || chr(10), '' ORDER BY r) || '|end|><|endoftext|>' AS answer, '<|image_1|>' || string_agg('<|image_' || (r + 2) || '|>', '' ORDER BY r) || 'Please describe these ' || count(*) || ' images.' AS prompt FROM t GROUP BY 1)
SELECT conv_id, n AS crops, least(length(prompt) + length(answer), 300)::INT AS ids, least(length(prompt), 300)::INT AS masked FROM l""")
def q67_page_samples(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("aoi_idx", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("int"))
    index = turns.select("conv_id", F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("image")).distinct()
    crops = turns.select("conv_id", "aoi_idx", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("path"))
    made = samples.page_samples(index, crops, turns.select("conv_id", "aoi_idx", F.col("text").alias("text_1")), ["conv_id"], models.fake(lambda s: [ord(c) for c in s]), 50256, longest=300)
    masked = F.size(F.filter("labels", lambda x: x == C.IGNORE)) + F.when(F.element_at("labels", -1) == 50256, 1).otherwise(0)
    return made.select("conv_id", F.size("crops").alias("crops"), F.size("input_ids").alias("ids"), masked.alias("masked"))


# ---- model seams, by deterministic stand-ins


@query("SELECT doc_id, upper(lang) AS output FROM documents WHERE doc_id % 11 <> 0")
def q68_model_seam(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").filter("doc_id % 11 <> 0")
    return models.apply_model(docs, models.fake(str.upper), "lang", "output", "string").select("doc_id", "output")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id * 2 END AS output, CASE WHEN doc_id % 4 = 0 THEN 'invalid output' END AS error FROM documents")
def q69_validated_retries(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return models.apply_model(docs, models.fake(lambda x: int(x) * 2), "doc_id", "output", "bigint", retries=2, valid=lambda out, row: row["doc_id"] % 4 != 0).select("doc_id", "output", "error")


@query("SELECT i AS id, CASE WHEN i < 990 THEN 30 ELSE 10 END AS n FROM (SELECT unnest(range(1000)) AS i)")
def q70_mini_batches(spark, sf):
    rows = spark.range(0, 1000, 1, 1)
    made = models.apply_model(rows, lambda: lambda batch: [len(batch)] * len(batch), "id", "n", "int", batch=30)
    return made.select("id", "n")


def _lectures(spark, sf) -> tuple[dict, pipeline.Config]:
    """Events as cues of one video a type, every third frame missing, with stand-ins for the models."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    events = table(spark, sf, "events").filter("event_id < 2000").select(F.lit("c").alias("course"), F.col("event_type").alias("video"), "event_id", ms.alias("ms"))
    numbered = events.withColumn("i", (F.row_number().over(Window.partitionBy("video").orderBy("event_id")) - 1).cast("int"))
    cues = numbered.select("course", "video", "i", F.col("ms").alias("start_ms"), (F.col("ms") + 2000).alias("end_ms"), F.concat(F.lit("t"), F.col("i").cast("string")).alias("text"))
    seen = cues.filter("i % 3 <> 1").select("course", "video", (F.col("i") + 1).alias("screenshot_id"), F.concat_ws("/", "video", (F.col("i") + 1).cast("string")).alias("path"))
    compare = seen.select("course", "video", "screenshot_id", F.when(F.col("screenshot_id") % 10 == 0, 30).otherwise(1).alias("pash"), F.lit(0.9).alias("ssim"))
    tables = {"cues": cues, "screenshots": seen, "compare": compare}
    found = [{"boxes": [0.0, 0.0, 10.0, 10.0], "score": 0.9, "class": 1}, {"boxes": [20.0, 20.0, 40.0, 40.0], "score": 0.8, "class": 4}]

    def point(path: str) -> dict:
        at = int(path.split("/")[1])
        return {"cls": [0.0], "xywh": [[24.0, 20.0, 4.0, 10.0] if at % 2 else [900.0, 900.0, 1.0, 1.0]], "conf": [0.5]} if at % 5 else {"cls": [], "xywh": [], "conf": []}

    tell = lambda key: "".join(f"\n\nImage {i}: Describe :d{i} [END]" for i in range(json.loads(key)["n"]))
    # the stand-in takes the line that is written first in the question, whatever it says
    say = lambda key: T.ANSWER_HEAD + '0"'
    return tables, pipeline.Config(band_ms=600_000, models={"det": models.fake(lambda p: found), "vlm": models.fake(tell), "laser": models.fake(point), "answer": models.fake(say)})


def _described(spark, tables: dict, config: pipeline.Config, *stages: str) -> dict:
    """After det and vlm, whose results are written, the stages."""
    out = work_path(spark, "lectures")
    for stage in ("det", "vlm"):
        tables = pipeline.run(stage, tables, config, out)
    for stage in stages:
        tables = pipeline.run(stage, tables, config)
    return tables


_CUES = """WITH e AS (SELECT event_type AS video, epoch_ms(ts) + 1000 AS mid, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::INT AS i FROM events WHERE event_id < 2000),
k AS (SELECT * FROM e WHERE i % 3 <> 1), """


@query(_CUES + """s AS (SELECT video, i + 1 AS id FROM k), g AS (SELECT *, 1 + sum((id % 10 = 0)::INT) OVER (PARTITION BY video ORDER BY id) AS page FROM s)
SELECT video, page::INT AS page, max(id)::INT AS page_end FROM g GROUP BY 1, 2""")
def q71_stage_det(spark, sf):
    tables, config = _lectures(spark, sf)
    return pipeline.run("det", tables, config)["page_ends"].select("video", "page", "page_end")


@query(_CUES + """s AS (SELECT video, i + 1 AS id FROM k), g AS (SELECT *, 1 + sum((id % 10 = 0)::INT) OVER (PARTITION BY video ORDER BY id) AS page FROM s)
SELECT video, id::INT AS screenshot_id, CASE WHEN id % 5 = 0 OR id % 2 = 0 THEN -1 ELSE 1 END AS ans FROM g""")
def q72_stage_answers(spark, sf):
    tables, config = _lectures(spark, sf)
    return _described(spark, tables, config, "dataset")["answers"].select("video", "screenshot_id", "ans")


@query(_CUES + "n AS (SELECT video, count(*)::INT AS contexts FROM k GROUP BY 1), a AS (SELECT video, count(*)::INT AS texts FROM e GROUP BY 1) SELECT * FROM n JOIN a USING (video)")
def q73_stage_base(spark, sf):
    tables, config = _lectures(spark, sf)
    made = _described(spark, tables, config, "dataset")["base"]
    return made.select("video", F.size("context_list").alias("contexts"), F.size("texts").alias("texts"))


@query(_CUES + "s AS (SELECT video, i + 1 AS id FROM k) SELECT 'c' AS course, count(*) AS questions_2, count(*) FILTER ((id * 7919) % 1000003 > (id * 7919 + 104729) % 1000003) AS correct_2 FROM s WHERE id % 5 <> 0 AND id % 2 = 1")
def q74_stage_evaluate(spark, sf):
    tables, config = _lectures(spark, sf)
    return _described(spark, tables, config, "dataset", "evaluate")["report"].select("course", "questions_2", "correct_2")


@query("SELECT conv_id AS page, turn::INT AS aoi_idx, '<' || text || '>' AS chinese FROM conversations")
def q75_stage_translate(spark, sf):
    told = table(spark, sf, "conversations").select(F.lit("c").alias("course"), F.lit("v").alias("video"), F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("aoi_idx"), F.col("text").alias("body"))
    said = models.fake(lambda m: "<" + json.loads(m)[1]["content"].removeprefix(mcq.TRANSLATE_USER) + ">")
    return pipeline.run("translate", {"descriptions": told}, pipeline.Config(models={"translate": said}))["descriptions"].select("page", "aoi_idx", "chinese")


@query("SELECT conv_id AS page, turn::INT AS aoi_idx, lower('x') || turn AS body FROM conversations")
def q76_stage_region_descriptions(spark, sf):
    regions = table(spark, sf, "conversations").select(F.lit("c").alias("course"), F.lit("v").alias("video"), F.col("conv_id").alias("page"), F.col("turn").cast("int").alias("aoi_idx"))
    said = models.fake(lambda key: f"x{json.loads(key)['aoi_idx']}|end|>")
    return pipeline.run("vlm", {"aoi": regions}, pipeline.Config(models={"aoi": said}))["descriptions"].select("page", "aoi_idx", "body")


@query("SELECT n_nationkey || '' AS video, 0 AS i, (n_nationkey * 1000)::BIGINT AS start_ms, lower(n_name) AS text FROM nation WHERE n_nationkey % 2 = 1")
def q77_stage_asr(spark, sf):
    media = table(spark, sf, "nation").select(F.lit("c").alias("course"), F.col("n_nationkey").cast("string").alias("video"), F.concat_ws("/", F.col("n_nationkey").cast("string"), "n_name").alias("path"))
    done = media.filter("cast(video as int) % 2 = 0").select("course", "video")
    heard = models.fake(lambda p: [{"start": float(p.split("/")[0]), "end": 99.0, "text": f" {p.split('/')[1].lower()}\n"}])
    return pipeline.run("asr", {"media": media, "subtitles": done}, pipeline.Config(models={"asr": heard}))["cues"].select("video", "i", "start_ms", "text")


@query("SELECT n_nationkey || '' AS video, (n_nationkey % 4 + 1)::INT AS screenshot_id, (n_nationkey // 2)::BIGINT AS second FROM nation WHERE n_nationkey % 3 <> 0")
def q78_stage_frames(spark, sf):
    nations = table(spark, sf, "nation").select(F.lit("c").alias("course"), F.col("n_nationkey").cast("string").alias("video"), F.col("n_nationkey").alias("k"))
    cues = nations.select("course", "video", (F.col("k") % 4).cast("int").alias("i"), F.lit(0).cast("bigint").alias("start_ms"), (F.col("k") * 1000).cast("bigint").alias("end_ms"), F.lit("").alias("text"))
    have = cues.filter("cast(video as int) % 3 = 0").select("course", "video", (F.col("i") + 1).alias("screenshot_id"), F.lit("old").alias("path"))
    shoot = models.fake(lambda key: str(json.loads(key)["second"]))
    made = pipeline.shots({"cues": cues, "media": nations.select("course", "video", F.col("video").alias("path")), "screenshots": have}, pipeline.Config(models={"frames": shoot}))["screenshots"]
    return made.filter("path <> 'old'").select("video", "screenshot_id", F.col("path").try_cast("bigint").alias("second"))


@query()
def q79_perceptual_hash(spark, sf):
    """Of 8 x 8 images made of embeddings; the hash is Python's, held against a hand-made one in the tests."""
    import numpy as np

    seen = models.fake(lambda v: segment.signed(segment.perceptual_hash(np.asarray(v, np.float64).reshape(8, -1))))
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return models.apply_model(rows, seen, "v", "hash", "bigint").select("vec_id", "hash")

