"""The golden cases of FIXTURES.md, by number."""

from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions import text as T
from lectern.functions import timecode as tc
from lectern.operators import boxes as B
from lectern.operators import collate as C
from lectern.operators import context, evaluate, mcq, pages, segment


def one(spark, column, **values):
    names = list(values)
    return spark.range(1).select(*[F.lit(values[n]).alias(n) for n in names]).select(column.alias("x")).first()["x"]


def test_g1_context_run(spark):
    mids = [2000, 7000, 12000, 17500, 34500, 32000, 36000]
    cues = spark.createDataFrame([("v", i, m) for i, m in enumerate(mids)], "video string, i int, mid long")
    got = {r["i"]: ([p["i"] for p in r["previous"]], [n["i"] for n in r["next"]]) for r in context.context_runs(cues, ["video"]).collect()}
    assert got == {0: ([], [1, 2]), 1: ([0], [2, 3]), 2: ([0, 1], [3]), 3: ([1, 2], []), 4: ([], [5, 6]), 5: ([3, 4], [6]), 6: ([4, 5], [])}
    assert one(spark, tc.midpoint_ms(F.col("a"), F.col("b")), a=5000, b=9001) == 7000
    assert one(spark, tc.screenshot_second(F.col("a"), F.col("b")), a=14500, b=20500) == 17


def test_g1_band_edge_and_monotone_path(spark):
    cues = spark.createDataFrame([("v", 0, 12000), ("v", 1, 27000), ("v", 2, 27001)], "video string, i int, mid long")
    got = {r["i"]: [n["i"] for n in r["next"]] for r in context.context_runs(cues, ["video"]).collect()}
    assert got[0] == [1]


def test_context_runs_against_loop(spark):
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for v in range(6):
        mids = [rng.randrange(0, 200_000) for _ in range(25)]
        if v % 2:
            mids.sort()
        rows += [(f"v{v}", i, m) for i, m in enumerate(mids)]
        for i, m in enumerate(mids):
            before, after = [], []
            for j in range(i - 1, -1, -1):
                if abs(mids[j] - m) > 15000:
                    break
                before.insert(0, j)
            for j in range(i + 1, len(mids)):
                if abs(mids[j] - m) > 15000:
                    break
                after.append(j)
            want[f"v{v}", i] = (before, after)
    got = {(r["video"], r["i"]): ([p["i"] for p in r["previous"]], [n["i"] for n in r["next"]]) for r in context.context_runs(spark.createDataFrame(rows, "video string, i int, mid long"), ["video"]).collect()}
    assert got == want


def test_g2_segments(spark):
    rows = [("v", 1, None, None), ("v", 2, 3, 0.9), ("v", 3, 25, 0.95), ("v", 4, -1, -1.0), ("v", 5, 10, 0.69), ("v", 6, 19, 0.7), ("v", 8, 20, 0.99)]
    frames = spark.createDataFrame(rows, "video string, screenshot_id int, pash int, ssim double").withColumn("cut", segment.is_cut(F.col("pash"), F.col("ssim")))
    ends = segment.page_ends(segment.number_pages(frames, ["video"], ["screenshot_id"]), ["video"])
    assert {r["page"]: r["page_end"] for r in ends.collect()} == {1: 2, 2: 4, 3: 6, 4: 8}


def test_g3_pages(spark):
    ends = spark.createDataFrame([("v", p, e) for p, e in [(1, 4), (2, 5), (3, 9), (4, 12)]], "video string, page int, page_end int")
    sparse = spark.createDataFrame([("v", i) for i in (1, 9, 10, 12, 13)], "video string, screenshot_id int")
    asof = {r["screenshot_id"]: r["page"] for r in pages.page_asof(sparse, ends, ["video"]).collect()}
    assert asof == {1: 1, 9: 3, 10: 4, 12: 4}
    fold = {r["screenshot_id"]: r["page"] for r in pages.page_fold(sparse.filter("screenshot_id < 13"), ends, ["video"]).collect()}
    assert fold == {1: 1, 9: 2, 10: 3, 12: 4}
    dense = spark.createDataFrame([("v", i) for i in range(1, 13)], "video string, screenshot_id int")
    a = {r["screenshot_id"]: r["page"] for r in pages.page_asof(dense, ends, ["video"]).collect()}
    assert a == {r["screenshot_id"]: r["page"] for r in pages.page_fold(dense, ends, ["video"]).collect()}


def test_page_fold_against_loop(spark):
    import random

    rng = random.Random(3)
    ends, frames, want = [], [], {}
    for v in range(8):
        last = sorted(rng.sample(range(1, 60), 8))
        if v % 2:
            rng.shuffle(last)  # ends need not rise
        ends += [(f"v{v}", p + 1, e) for p, e in enumerate(last)]
        page = 1
        for i in sorted(rng.sample(range(1, 70), 25)):
            if page <= len(last) and i > last[page - 1]:
                page += 1
            frames.append((f"v{v}", i))
            want[f"v{v}", i] = page
    got = pages.page_fold(spark.createDataFrame(frames, "video string, screenshot_id int"), spark.createDataFrame(ends, "video string, page int, page_end int"), ["video"])
    assert {(r["video"], r["screenshot_id"]): r["page"] for r in got.collect()} == want


def test_g4_laser(spark):
    schema = "k int, cls array<double>, xywh array<array<double>>, conf array<double>"
    rows = [(1, [0.0, 0.0, 0.0], [[40.0, 40.0, 20.0, 10.0], [100.0, 100.0, 20.0, 20.0], [1.0, 1.0, 1.0, 1.0]], [0.9, 0.3, 0.0]), (2, [], [], []), (3, [0.0], [[1.0, 1.0, 1.0, 1.0]], [0.0])]
    found = B.zip_detections(F.col("cls"), F.col("xywh"), F.col("conf"))
    last = B.last_positive(found)["xywh"]
    x, y = G.laser_anchor(last)
    got = {r["k"]: (r["x"], r["y"]) for r in spark.createDataFrame(rows, schema).select("k", x.alias("x"), y.alias("y")).collect()}
    assert got == {1: (110.0, 120.0), 2: (None, None), 3: (None, None)}
    best = spark.createDataFrame(rows, schema).select("k", B.strongest(found)["conf"].alias("c"))
    assert {r["k"]: r["c"] for r in best.collect()} == {1: 0.9, 2: None, 3: None}


def test_g5_nearest(spark):
    held = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 50.0, 50.0, 150.0, 150.0), (1, 2, 300.0, 300.0, 400.0, 400.0), (1, 3, 0.0, 0.0, 100.0, 100.0)], "page int, aoi_idx int, x1 double, y1 double, x2 double, y2 double")
    want = {(50, 50): 0, (120, 120): 1, (121, 10): -1, (120, 50): 1, (75, 75): 0, (290, 280): 2, (279, 300): -1, (200, 200): -1}
    points = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(want)], "page int, pt int, px double, py double")
    got = {(r["px"], r["py"]): r["ans"] for r in B.nearest_box(points, held, ["page"], ["pt"]).collect()}
    assert got == {(float(x), float(y)): a for (x, y), a in want.items()}


def test_g6_suppression(spark):
    def survivors(coords):
        rows = [(1, i, 0.9, *map(float, c)) for i, c in enumerate(coords)]
        df = spark.createDataFrame(rows, "page int, det_idx int, score double, x1 double, y1 double, x2 double, y2 double")
        return sorted(r["det_idx"] for r in B.suppress_contained(df, ["page"]).collect())

    assert survivors([(0, 0, 100, 100), (10, 10, 20, 20), (0, 0, 100, 100), (95, 0, 105, 10), (93, 0, 103, 10)]) == [0, 2, 3]
    assert survivors([(0, 0, 10, 10), (0, 0, 20, 10), (6, 0, 40, 10)]) == [2]
    at_half = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 1.0, 1.0)], "page int, det_idx int, score double, x1 double, y1 double, x2 double, y2 double")
    assert B.suppress_contained(at_half, ["page"]).count() == 0


def test_g7_descriptions(spark):
    raw = "x\n\nImage 0: **aa**\n[END]\nImage 1:  bb\ncc [END] Image 0: zz*\n"
    assert {d["k"]: d["body"] for d in one(spark, T.descriptions(F.col("r")), r=raw)} == {0: "zz", 1: "bb\ncc"}
    assert one(spark, T.descriptions(F.col("r")), r="nothing") == []


def test_g8_timecode(spark):
    want = {0.0: "00:00:00,000", 1.9999: "00:00:01,999", 61.5: "00:01:01,500", 3661.001: "01:01:01,001", 59.9996: "00:00:59,999", 360000.25: "100:00:00,250"}
    got = {r["s"]: r["c"] for r in spark.createDataFrame([(s,) for s in want], "s double").select("s", tc.format_seconds(F.col("s")).alias("c")).collect()}
    assert got == want
    assert one(spark, tc.parse_ms(F.col("c")), c="01:01:01,001") == 3661001
    assert one(spark, tc.format_ms(F.lit(-1500)), c=1) == "-00:00:01,500"


def test_g9_answers(spark):
    want = {'最可能對應的是:"3"': 3, "3": 3, '最可能對應的是:" 4 "': 4, '"x"': -1, "": -1, '最可能對應的是:"3"。': -1, "1_0": -1}
    got = {r["a"]: r["n"] for r in spark.createDataFrame([(s,) for s in want], "a string").select("a", T.parse_answer(F.col("a")).alias("n")).collect()}
    assert got == want


def test_g10_thresholds(spark):
    rows = [("A", 2, True), ("A", 3, False), ("A", 5, True), ("A", 1, True), ("B", 7, False), ("B", 4, True)]
    report = evaluate.thresholds(spark.createDataFrame(rows, "course string, aoi_count int, ok boolean"))
    got = {r["course"]: ([r[f"questions_{k}"] for k in (2, 3, 4, 5)], [r[f"correct_{k}"] for k in (2, 3, 4, 5)]) for r in report.collect()}
    assert got == {"A": ([3, 2, 1, 1], [2, 1, 1, 1]), "B": ([2, 2, 2, 1], [1, 1, 1, 0])}
    assert evaluate.summary(report).first()["acc"] == 0.6
    assert evaluate.summary(report.limit(0)).first()["acc"] is None


def test_g11_titles(spark):
    assert one(spark, T.sanitize_title(F.col("t")), t="L1: Intro/ML v1.0 | DATA") == "L1 IntroML v10  DATA"
    assert one(spark, T.allowed_title(F.col("t")), t="L1: Intro/ML v1.0 | DATA") is False
    assert one(spark, T.trailing_number(F.col("t")), t="screenshot_12.jpg") == 12
    assert one(spark, T.stem_first(F.col("t")), t="a.b.c") == "a" and one(spark, T.stem_last(F.col("t")), t="a.b.c") == "a.b"
    assert one(spark, T.strip(F.col("t")), t="　 a\t") == "a"


def test_g12_options(spark):
    schema = "course string, video string, subtitle string, options array<string>, ans int, key long"
    rows = [("ML2022", "v", "[0]x", ["a", "b", "a"], 2, 5), ("C", "v", "[0]x", ["a"], 0, 5), ("C", "w", "[0]x", ["a", "b"], -1, 5), ("C", "y", "[0]x", ["p", "q", "r"], 1, 5)]
    made = {r["video"]: r for r in mcq.samples(spark.createDataFrame(rows, schema)).collect()}
    assert set(made) == {"v", "y"}
    assert made["v"]["conversations"][1]["value"] == '最可能對應的是:"0"' and made["v"]["split"] == "valid"
    human, gpt = (c["value"] for c in made["y"]["conversations"])
    label = int(gpt.split('"')[1])
    assert f'\n{label}:"q"' in human


def test_g13_padding(spark):
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3])], "b int, o int, ids array<bigint>")
    assert C.collate(df, "b", "o").first()["input_ids"] == [[1, 2], [3, 0]]
    assert C.collate(df, "b", "o", left=True).first()["input_ids"] == [[1, 2], [0, 3]]
    assert C.collate(df, "b", "o").first()["attention_mask"] == [[1, 1], [1, 0]]
    masked = df.select(C.labels(F.lit(3), F.col("ids"), F.lit(9), 3).alias("l")).first()["l"]
    assert masked == [-100, -100, 9]


def test_bround_and_geometry(spark):
    df = spark.createDataFrame([(0.5, 1.5, 2.5, 3.5)], "x1 double, y1 double, x2 double, y2 double")
    b = G.rounded(G.Box.named())
    assert tuple(df.select(*[c.alias(n) for c, n in zip(b, "abcd")]).first()) == (0, 2, 2, 4)
