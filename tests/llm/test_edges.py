"""The operators where data is adverse: used-up formats, hot keys, clashing names, many rounds, skewed vectors."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lectern.llm import ann, common, impact, langid, mixing, pii, sharding, tokencount, urlfilter, vectors

DOCS = "doc_id long, text string, lang string, source string"


def vector_table(spark, x):
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": flat})).repartition(4)


# ---- work tables


def test_scopes_delete_what_is_not_kept(spark):
    import os

    with common.scratch(spark) as outer:
        with common.scratch(spark) as keep:
            a, b = keep(common.materialize(spark.range(3), "a")), common.materialize(spark.range(4), "b")
        assert os.path.exists(a._work_path) and not os.path.exists(b._work_path)
        c = outer(common.materialize(a, "c"))
    assert not os.path.exists(a._work_path) and c.count() == 3


def test_copies_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(common, "COPIES", 4)
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 4), ("d", 11)], "k string, n long")
    got = defaultdict(list)
    for r in common.copies(df, "n").collect():
        got[r["k"]].append(r["copy"])
    assert {k: sorted(v) for k, v in got.items()} == {"b": [0, 1, 2], "c": [0, 1, 2, 3], "d": list(range(11))}
    rows = common.materialize(spark.range(900).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3)), "rows")
    got = defaultdict(list)
    for r in common.numbered(rows, ["k"], F.col("id"), "nth").collect():
        got[r["k"]].append(r["nth"])
    assert len(got) == 3 and all(sorted(v) == list(range(300)) for v in got.values())


# ---- PII


@pytest.mark.parametrize("n", [400, 676])
def test_used_up_format(spark, n):
    """x@y.io has 26 * 26 forms; so many entities take them that there are too few, or none, left for their replacements."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    canon = [f"{a}@{b}.io" for a in letters for b in letters][:n]
    found = [r["found"] for r in pii.resolve(spark.createDataFrame([("email", c) for c in canon], "kind string, canon string"), "k").collect()]
    assert len(found) == len(set(found)) == n and not set(found) & set(canon)
    assert all(regex.fullmatch(r"[a-z]+@[a-z]\.io", f) for f in found)


def test_one_surname_with_very_many_first_names(spark):
    canon = [f"m {a}{b} Smith" for a in "ABCDEFGHIJKLMNOP" for b in ["ada", "ede", "ibi", "olo"] * 10]
    canon = sorted({c.replace(" Smith", f"{i} Smith") for i, c in enumerate(canon)})
    found = [r["found"] for r in pii.resolve(spark.createDataFrame([("person", c) for c in canon], "kind string, canon string"), "k").collect()]
    assert len(set(found)) == len(canon)


MAKE = {
    "email": lambda r: f"{r.choice(['ann', 'Bob.x', 'zoë', 'иван', '山田'])}{r.randrange(9)}@{r.choice(['mail', 'x-y', '例え'])}.{r.choice(['com', 'org'])}",
    "ip": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    "ssn": lambda r: f"{r.randrange(1000):03}-{r.randrange(100):02}-{r.randrange(10000):04}",
    "card": lambda r: " ".join(f"{r.randrange(10000):04}" for _ in range(4)),
    "phone": lambda r: f"({r.randrange(1000):03}) {r.randrange(1000):03}-{r.randrange(10000):04}",
    "secret": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(40)) + "7",
    "person": lambda r: f"{r.choice(['Mr', 'Mrs', 'Herr'])} {r.choice(['Ana', 'Bo', 'Ελένη', '美咲'])} {r.choice(['Lind', 'Ruiz', 'Ode'])}".replace("Mr 美咲", "Mr Li"),
}


def test_pii_against_plain_python(spark):
    """Every entity that the patterns see in a text is replaced, and nothing else; one entity has one replacement, no two share one,
    none is an entity of the table; a replacement is of its entity's type and, letter by letter, of its script."""
    rng = random.Random(11)
    words = ["the", "of", "in 1999", "x = 3", "end.", "(a)", "$1", "\\n"]
    texts = []
    for _ in range(200):
        parts = [rng.choice(words) if rng.random() < 0.6 else MAKE[rng.choice(list(MAKE))](rng) for _ in range(rng.randrange(0, 14))]
        texts.append(" | ".join(parts))
    java = lambda p: regex.compile(p.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    any_, kinds = java(pii.ANY), {k: java(p) for k, p in pii.PATTERNS.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in pii.replace_pii(df, key="k").collect()}
    to, real = {}, set()

    def plain(kind, value):
        if kind == "person":
            honorific, rest = value.split(" ", 1)
            return kind, ("f " if honorific in pii.FEMALE else "m ") + rest
        return kind, regex.sub(r"\D", "", value) if kind in ("card", "phone", "ssn") else value.lower()

    for i, text in enumerate(texts):
        values = [m.group() for m in any_.finditer(text)]
        assert got[i]["entities"] == len(values)
        gaps = any_.split(text) if not any_.groups else None
        at, new = 0, got[i]["text"]
        gaps = []
        for m in any_.finditer(text):
            gaps.append(text[at : m.start()])
            at = m.end()
        gaps.append(text[at:])
        pattern = "(.+?)".join(regex.escape(g) for g in gaps)
        m = regex.fullmatch(pattern, new, regex.S)
        assert m, (text, new)
        for value, other in zip(values, m.groups()):
            kind = next(k for k, p in kinds.items() if p.fullmatch(value))
            assert kinds[kind].fullmatch(other) or kind == "card", (kind, value, other)
            key = plain(kind, value)
            assert to.setdefault(key, plain(kind, other)) == plain(kind, other)
            real.add(key)
            if kind == "email":
                script = lambda s: [next((n for n in ("Latin", "Cyrillic", "Greek", "Han", "Hiragana") if regex.match(rf"\p{{{n}}}", c)), c if not c.isdigit() else "N") for c in s]
                assert script(value.rsplit(".", 1)[0]) == script(other.rsplit(".", 1)[0]), (value, other)
            if kind == "person" and regex.search(r"\p{Greek}", value):
                assert regex.search(r"\p{Greek}", other) and not regex.search(r"\p{Latin}", other.split(" ", 1)[1].split(" ")[0])
    assert len(set(to.values())) == len(to) and not real & set(to.values()) and len(to) > 300


def test_pii_keeps_every_column_and_key(spark):
    df = spark.createDataFrame([(1, "a@b.io", "g1", "n1", "c1"), (2, "none", "g2", "n2", "c2")], "doc_id long, text string, g string, news string, canon string")
    rows = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert (rows[1]["g"], rows[1]["news"], rows[1]["canon"]) == ("g1", "n1", "c1") and rows[1]["text"] != "a@b.io" and rows[2]["text"] == "none"
    again = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert again[1]["text"] == rows[1]["text"]  # one key a session
    spark.conf.unset(pii.SECRET)
    assert pii.secret_of(spark) != "lectern" and len(pii.secret_of(spark)) == 64


# ---- mixing


def test_mixed_words_are_the_planned_ones(spark):
    """Null and repeated ids, rows that are alike in id and text, several sources: what is written is what is planned."""
    rng = random.Random(5)
    rows = [(None, "w " * (3 if i % 2 else 4), "en", "a") for i in range(101)] + [(None, "same text here", "en", "b") for _ in range(90)]
    rows += [(i % 7, "v " * rng.randrange(0, 9), str(i), rng.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.count("*").alias("rows")).collect()
    made = mixing.mix_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in made} == {r["source"]: r["n"] for r in plan} == {r["source"]: int(r["t"]) for r in plan}
    assert {r["source"]: r["rows"] for r in plan} == Counter(s for *_, s in rows)
    times = Counter((r["doc_id"], r["text"], r["lang"]) for r in mixing.mix_documents(docs).collect())
    own = Counter((i, t, lang) for i, t, lang, _ in rows)
    assert all(n <= 2 * own[k] for k, n in times.items() if k in own)


def test_many_sources(spark):
    rng = random.Random(6)
    sizes = [(f"s{i:03}" if i else None, rng.randrange(0, 50)) for i in range(200)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    size, names = dict(sizes), sorted(s for s, _ in sizes if s is not None) + [None]
    open_, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values())
    goal = {}
    while over := [s for s, w in open_.items() if left * w > 2 * size[s] * sum(open_.values())]:
        left -= sum(2 * size[s] for s in over)
        goal |= {s: 2.0 * size[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert got.keys() == goal.keys() and all(abs(got[s] - goal[s]) < 1e-6 for s in goal)


# ---- resharding


def test_rewrite_in_place(spark, tmp_path):
    """The folder that is read is the one that is written: all rows stay, emptied shards go, the files of shards that neither
    lose nor gain a row keep their names."""
    import os

    for old, new in ((6, 4), (3, 5)):
        path = str(tmp_path / f"{old}")
        rows = [(None if i % 9 == 0 else i % 80, "t" * (40 if i % old == 1 else i % 31), str(i), i % old) for i in range(400)] + [(None, "hot", "x", 0)] * 150
        spark.createDataFrame(rows, "doc_id long, text string, extra string, shard int").write.partitionBy("shard").parquet(path)
        docs = spark.read.parquet(path)
        plan = common.materialize(sharding.reshard(docs, new, F.col("shard")), "plan")
        touched = {s for r in plan.filter("moved").collect() for s in (r["old"], r["shard"])}
        names = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("shard=")}
        sharding.rewrite(docs, plan, path, old_shard=F.col("shard"))
        got = spark.read.parquet(path).collect()
        key = lambda i, t, e: (-1 if i is None else i, t, e)
        assert sorted(key(r["doc_id"], r["text"], r["extra"]) for r in got) == sorted(key(i, t, e) for i, t, e, _ in rows)
        assert {r["shard"] for r in got} == set(range(new))
        for d, files in names.items():
            if int(d.split("=")[1]) not in touched:
                assert sorted(os.listdir(f"{path}/{d}")) == files
        slots = defaultdict(list)
        for r in plan.collect():
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        mine = Counter((r["doc_id"], zlib.crc32(r["text"].encode()), r["shard"]) for r in got if r["shard"] in touched)
        assert mine == Counter((r["doc_id"], r["crc"], r["shard"]) for r in plan.collect() if r["shard"] in touched)


# ---- vector searches


def skewed(kind, n=20000, dim=64):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        return rng.normal(size=(200, dim))[rng.integers(0, 200, n)] + 0.15 * x
    return x * rng.lognormal(0, 0.7, (n, 1)) if kind == "norms" else x


@pytest.mark.parametrize("kind", ["random", "clusters", "norms"])
def test_ann_recall(spark, kind):
    x = skewed(kind).astype(np.float32).astype(np.float64)
    rows = ann.search(vector_table(spark, x), F.col("vec_id") % 100 == 0).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["query_id"]].add(r["vec_id"])
    q = np.arange(0, len(x), 100)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    assert all(len(v) == 20 for v in got.values()) and len(got) == len(q)
    assert np.mean([len(got[i] & set(t.tolist())) / 20 for i, t in zip(q.tolist(), true)]) >= 0.95


@pytest.mark.parametrize("search, k", [(ann.search, 20), (impact.search, 5)])
def test_rounds_change_nothing(spark, monkeypatch, search, k):
    """Rounds of 16 queries: the same rows, and never more than a round's queries on the driver."""
    x = skewed("clusters", 1200, 12)
    df = vector_table(spark, x)
    most = []
    collected = vectors.query_rounds

    def watched(*args):
        for ids, q in collected(*args):
            most.append(len(ids))
            yield ids, q

    monkeypatch.setattr(vectors, "query_rounds", watched)
    few = sorted(map(tuple, search(df, F.col("vec_id") % 10 == 0, k, per_round=16).collect()))
    assert len(most) == 8 and max(most) < 40
    one = sorted(map(tuple, search(df, F.col("vec_id") % 10 == 0, k).collect()))
    assert [r[:3] for r in few] == [r[:3] for r in one] and len(one) == 120 * k


def test_hot_vector_and_lengths(spark):
    """A vector that a third of the rows hold; rows of another length are searched among themselves."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(900, 8)), 3)
    x[300:600] = x[5] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [float(i), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for search, unit in ((ann.search, lambda v: v), (impact.search, lambda v: np.floor(256 * v))):
        got = defaultdict(list)
        for r in search(df, F.col("vec_id") % 100 == 0, 7).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        s = unit(x) @ unit(x).T
        for q in range(0, 900, 100):
            true = sorted((c for c in range(900) if c != q), key=lambda c: (-s[q, c], c))[:7]
            assert got[q] == true or search is ann.search and len(set(got[q]) & set(true)) >= 6
        assert got[2000] == ([2001, 2002, 2003] if search is not ann.search or got[2000] == [2001, 2002, 2003] else None)


def test_topk_refuses_what_would_overflow(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="bits"):
        impact.search(df, F.col("vec_id") % 50 == 0)


def test_bars_of_earlier_blocks_keep_the_proof(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(-300, 300, (3000, 10))
    q = x[7]
    s = x @ q
    true = sorted((c for c in range(3000) if c != 7), key=lambda c: (-s[c], c))[:5]
    bar, got = -np.inf, []
    for a in range(0, 3000, 700):
        index = impact.ImpactIndex(np.arange(a, min(a + 700, 3000)), x[a : a + 700])
        vec, score = index.top(7, q, 5, bar)
        got = sorted([*got, *zip(score.tolist(), vec.tolist())], key=lambda t: (-t[0], t[1]))[:5]
        bar = max(bar, got[-1][0]) if len(got) == 5 else bar
    assert [v for _, v in got] == true


# ---- URL filter, counts, language


def test_urlfilter_keeps_clashing_columns(spark):
    rng = random.Random(7)
    urls = [f"http://{rng.choice('abcd')}{rng.randrange(50)}.com/en/x{i}" for i in range(80)] + [f"http://{rng.choice('wxyz')}.net/es/y{i}" for i in range(60)] + ["http://q.org/a", "plain"]
    df = spark.createDataFrame([(i, u, "j", "s", "r") for i, u in enumerate(urls)], "page_id long, url string, judged string, said string, ratio string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(urls) and all((r["judged"], r["said"], r["ratio"]) == ("j", "s", "r") for r in rows)


def test_url_scores_in_slices(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(6))
    train = spark.createDataFrame([(f"{word()}.x/{word()}", i % 2 == 0) for i in range(60)], "symbols string, accepted boolean")
    asked = spark.createDataFrame([(w, w) for w in (word() for _ in range(30))], "url string, symbols string")
    whole = {r["url"]: r["score"] for r in urlfilter.scores(asked, train).collect()}
    parts = {r["url"]: r["score"] for r in urlfilter.scores(asked, train, most=40 * urlfilter.ROW).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[u] - parts[u]) < 1e-9 for u in whole)


def test_results_never_replace_a_column(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCS + ", token_count int")
    with pytest.raises(ValueError):
        tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    got = tokencount.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), "found").first()
    assert got["token_count"] == 3 and got["found"]["tokens"] > 0


def test_training_reads_whole_texts(spark):
    """What tells the languages apart stands at the end of long texts only."""
    rng = random.Random(3)
    head = "".join(rng.choice("abc ") for _ in range(64))
    rows = [(i, head + "".join(rng.choice("xyz" if i % 2 else "uvw") for _ in range(600)), "one" if i % 2 else "two", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(docs, langid.train(docs, steps=60)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
