"""The stages of the corpus pipeline, and all of it, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import common, jaccard, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, pairs, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS).repartition(parts)


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(pairs):
    """Root of each row: components of exact five-word similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def kept(pairs):
    best = {}
    for (i, t), g in zip(pairs, groups(pairs)):
        best.setdefault(g, []).append((i is None, i or 0))
    return sorted(min(rows) for rows in best.values())


def planted(seed=3, groups_of=(40, 12, 3, 2, 2), strangers=60):
    """Copies of a text with 0 to 8 words changed, around and beyond 0.8, and strangers with one line in common."""
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    line = "this line stands in very many of the texts here".split()
    texts = [prose(rng.randrange(20, 90)) + line for _ in range(strangers)]
    for size in groups_of:
        base = prose(rng.randrange(60, 160))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    return list(enumerate(" ".join(t) for t in rng.sample(texts, len(texts))))


@pytest.mark.parametrize("block", [8, 4096])
def test_deduplicate_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard.representatives, "__defaults__", (block,))
    pairs = planted()
    want = kept(pairs)
    assert 60 < len(want) < len(pairs) - 10
    got = corpus_pipeline.deduplicate(spark, frame(spark, pairs), "").collect()
    assert sorted((False, r["doc_id"]) for r in got) == want


def test_three_word_links_are_no_near_duplicates(spark):
    """A text with every fifth word or so changed is no near copy, whatever the fingerprints say; one with two words changed is."""
    words = [f"v{i}" for i in range(100)]
    far = [f"y{i}" if i % 6 == 0 else w for i, w in enumerate(words)]
    close = [f"z{i}" if i in (50, 51) else w for i, w in enumerate(words)]
    pairs = [(1, " ".join(words)), (2, " ".join(far)), (3, " ".join(close))]
    got = corpus_pipeline.deduplicate(spark, frame(spark, pairs), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def distinct_of(spark, pairs):
    """The table of distinct sets that links() gets, and the rows behind it."""
    rows = spark.createDataFrame([(i, i, t) for i, t in pairs], "doc_id long, row long, text string").repartition(3)
    made = jaccard.keyed(rows, np.empty(0, np.uint64)).select("sig", "fp", "sketch", "keys", F.struct(F.lit(False).alias("no_id"), "doc_id", "row").alias("best"))
    return common.materialize(made.dropDuplicates(["sig"]), "distinct"), rows


def test_deduplicate_goes_through_fingerprints(spark, monkeypatch):
    """Sets within 3 bits of one another come by the fingerprint operator; each of its pairs is confirmed, and the filter gets the rest."""
    base = [f"v{i}" for i in range(400)]
    copies = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(30, 330, 10)]
    pairs = [(1000, " ".join(base)), *copies, *((2000 + i, t) for i, t in planted(groups_of=(2, 2)))]
    bits = {i: simhash.majority(jaccard.shingle_set(t.encode())) for i, t in pairs}
    close = [i for i, _ in copies if 0 < ((bits[i] ^ bits[1000]) & (2**64 - 1)).bit_count() <= simhash.BITS]
    assert len(close) > 3
    asked, searched, search = [], simhash.links, jaccard.apart
    monkeypatch.setattr(simhash, "links", lambda fps, block: asked.extend(r["fp"] for r in fps.collect()) or searched(fps, block))
    left = []
    monkeypatch.setattr(jaccard, "apart", lambda found, roots: left.append((found.count(), search(found, roots).count())) or search(found, roots))
    distinct, rows = distinct_of(spark, pairs)
    name = {r["sig"]: r["best"]["doc_id"] for r in distinct.collect()}
    texts = dict(pairs)
    edges = [(name[r["a"]], name[r["b"]]) for r in jaccard.near_fingerprints(distinct, rows).collect()]
    assert set(asked) == set(bits.values())
    assert all(near(shingles(texts[a]), shingles(texts[b])) for a, b in edges)
    assert set(close) <= {i for e in edges for i in e}
    got = corpus_pipeline.deduplicate(spark, frame(spark, pairs), "").collect()
    assert sorted((False, r["doc_id"]) for r in got) == kept(pairs)
    assert left[0][1] < left[0][0]  # pairs that the fingerprints have joined aren't looked at again


def test_a_worker_drops_what_other_operators_kept(spark, monkeypatch):
    """The tokenizer and its words of a packing task are gone once the worker makes shingles; packing's own tasks keep them."""

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, each, _):
            return each

    monkeypatch.setattr(packing.WordTokenizer, "_of", kept_words := {"file": "tokenizer"})
    monkeypatch.setattr(common, "CACHES", [kept_words], raising=False)
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b"a b c d e f"])], ["doc_id", "row", "text"])
    assert sum(b.num_rows for b in jaccard.keyed(Rows(), np.empty(0, np.uint64))(iter([rows]))) == 1
    assert not kept_words
    kept_words["file"] = "tokenizer"
    common.settle(kept_words)
    assert kept_words


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_texts_stay_where_they_are(spark, monkeypatch, most):
    """Few rows to drop are broadcast, and no text is shuffled but those of equal rows; many are joined by a shuffle, with one result."""
    rows = [(i, f"text of number {i} that is its own and has some words", "en", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(10)] + [rows[20]] * 3
    monkeypatch.setattr(common.few, "__defaults__", (most,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, DOCS).repartition(3), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (most == 0)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    common = np.sort(rng.integers(0, 2000, 300).astype(np.uint64))
    met = 0
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2000, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2000, rng.integers(0, 6)).astype(np.uint64)]))
        if len(b) and jaccard.similar(a, b):
            met += 1
            assert np.intersect1d(jaccard.prefix(a, common), jaccard.prefix(b, common)).size
            assert jaccard.sketches_agree(jaccard.sketch(a), jaccard.sketch(b))
    assert met > 300


def test_sketches_of_all_widths_agree():
    """No similar pair is ruled out, also where the two bitmaps have different widths; strangers are."""
    rng = np.random.default_rng(6)
    for n in (3, 500, 512, 513, 1000, 1030, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 20 :], rng.integers(0, 2**63, n // 12).astype(np.uint64)]))
        c = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert jaccard.similar(a, b) and not jaccard.similar(a, c)
        marks = [jaccard.sketch(x) for x in (a, b, c)]
        assert jaccard.sketches_agree(marks[0], marks[1]) and not jaccard.sketches_agree(marks[0], marks[2])
        one, two = jaccard.Sketches(np.arange(3), marks).pairs(np.arange(3), np.arange(3), True)
        assert list(zip(one.tolist(), two.tolist())) == [(0, 1)]
        assert not len(jaccard.Sketches(np.array([0, 0, 2]), marks).pairs(np.arange(3), np.arange(3), True)[0])


def test_rows_that_share_an_id_stand_for_their_own_texts(spark):
    pairs = [(5, "one text of its own here"), (5, "another text that has a copy"), (3, "another text that has a copy"), (3, "another text that has a copy"), (None, "one text of its own here"), (None, "no id at all")]
    got = corpus_pipeline.deduplicate(spark, frame(spark, pairs), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "no id at all"), (3, pairs[1][1]), (5, pairs[0][1])]


# ---- the other stages, and all of them


WIDE = DOCS + ", language string, entities string, g string, size int, copy int, part int, row string"


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that the operators use themselves."""
    rng = random.Random(4)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows = [(i, prose("abcdé" if i % 2 else "uvwxß", rng.randrange(6, 60)), "one" if i % 2 else "two", rng.choice(["a", "a", "b", None]), 1) for i in range(120)]
    rows += [(200, None, "one", "a", None), (201, "", None, None, 0), (202, " \t\n", "two", "b", 3), (203, "123 !!", None, "a", 6), (None, None, None, None, None)]
    rows += [(300, prose("abcdé", 9000), "one", "a", 5)] * 2 + [(None, rows[1][1], None, "b", 2)] * 3 + [rows[2]] * 2
    rows += [(301, rows[4][1] + " write to ann.lee@mail.com", "two", "a", 9), (302, "tell ann.lee@mail.com " + rows[5][1], None, "c", 9)]
    wide = [(*r, f"l{i % 3}", "e", "g", 7, 8, 9, None) for i, r in enumerate(rows)]
    return rows, spark.createDataFrame(wide, WIDE).repartition(3)


def test_language_stage(spark):
    rows, docs = odd(spark)
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter(map(tuple, out.collect()))
    every = Counter(map(tuple, docs.collect()))
    assert not got - every
    gone = every - got
    assert {r[1] for r in gone} == {None, "", " \t\n", "123 !!"}
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_private_stage(spark):
    rows, docs = odd(spark)
    out = corpus_pipeline.private(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(rows)
    got = out.collect()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) and r["entities"] == "e" and r["g"] == "g" for r in got)
    changed = {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (301, 302)}
    mail = changed[301].rsplit(" ", 1)[1]
    assert mail != "ann.lee@mail.com" and changed[302].startswith(f"tell {mail} ")
    others = Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] not in (301, 302))
    assert others == Counter((i, t) for i, t, *_ in rows if i not in (301, 302))


def mixed_by_hand(rows):
    """Words that each source gives, in the order of the rows' hashes: whole passes, then what the cut leaves."""
    size = lambda t: len((t or "").split())
    sums, order = Counter(), {}
    for i, t, _, s, *_ in rows:
        sums[s] += size(t)
        text = hashlib.md5((t or "").encode()).hexdigest()
        order.setdefault(s, []).append((hashlib.md5(f"mix:{'null' if i is None else i}:{text}".encode()).hexdigest(), i, t))
    names = sorted(s for s in sums if s is not None) + ([None] if None in sums else [])
    open_, left, goal = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sums.values()), {}
    while over := [s for s, w in open_.items() if left * w > 2 * sums[s] * sum(open_.values())]:
        left -= sum(2 * sums[s] for s in over)
        goal |= {s: 2.0 * sums[s] for s in over}
        open_ = {s: w for s, w in open_.items() if s not in over}
    goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    made = Counter()
    for s, lines in order.items():
        words = int(goal[s])
        while words and sums[s]:
            for _, i, t in sorted(lines, key=lambda x: x[0]):
                if (n := min(size(t), words)) > 0:
                    made[i, s, " ".join(t.split()[:n])] += 1
                    words -= n
    return made


def test_mixed_stage_against_plain_python(spark):
    rows, docs = odd(spark)
    out = corpus_pipeline.mixed(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter((r["doc_id"], r["source"], " ".join(r["text"].split())) for r in got) == mixed_by_hand(rows)


def tokens_of(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def check_packed(pieces, ids_of_rows):
    """Pieces tile each row's ids and each sequence's places; rows of pieces are the rows of the input, whatever their ids."""
    by_row, by_sequence = {}, {}
    for r in pieces:
        by_row.setdefault(r["row"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    made = Counter()
    for mine in by_row.values():
        mine.sort(key=lambda r: r["start"])
        assert len({r["doc_id"] for r in mine}) == len({r["doc_tokens"] for r in mine}) == 1
        assert [r["start"] for r in mine] == np.cumsum([0, *[r["length"] for r in mine[:-1]]]).tolist() and sum(r["length"] for r in mine) == mine[0]["doc_tokens"]
        made[mine[0]["doc_id"], tuple((r["start"], r["length"], r["ids_crc32"]) for r in mine)] += 1
    shapes = {}
    for (doc_id, cuts), n in made.items():
        shapes.setdefault(doc_id, []).append((cuts, n))
    left = Counter((i, ids.tobytes()) for i, ids in ids_of_rows)
    for doc_id, mine in shapes.items():
        for cuts, n in mine:
            fits = [k for k in left if k[0] == doc_id and left[k] > 0 and all(zlib.crc32(k[1][4 * a : 4 * (a + length)]) == crc for a, length, crc in cuts) and sum(c[1] for c in cuts) * 4 == len(k[1])]
            while n:
                k = next(k for k in fits if left[k] > 0)
                take = min(n, left[k])
                left[k] -= take
                n -= take
    assert not +left
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places[:-1]]]).tolist() and places[-1][0] + places[-1][1] <= 2048


def test_packed_stage(spark):
    rows, docs = odd(spark)
    out = corpus_pipeline.packed(spark, docs, "").collect()
    check_packed(out, list(zip([r[0] for r in rows], tokens_of([r[1] for r in rows]))))


def test_empty_table(spark):
    _, docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_run_against_plain_python(spark, tmp_path):
    """run() of a table of near copies, personal data and junk: what the stages must do by hand gives the same rows."""
    rng = random.Random(8)
    prose = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(n))
    base = [prose("abcdé" if i % 2 else "uvwxß", rng.randrange(20, 60)) for i in range(60)]
    pairs = list(enumerate(base)) + [(100 + i, f"{t} end{i}") for i, t in enumerate(base[:20])] + [(200 + i, t) for i, t in enumerate(base[10:25])]
    pairs += [(300, "12 34"), (301, None), (302, base[7] + " mail bob@site.org"), (303, prose("abcdé", 30) + " bob@site.org")]
    rows = [(i, t, "one" if t and "é" in t else "two", rng.choice("ab"), 0) for i, t in pairs]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.lectern.pii.secret", "of this test")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    held = [(i, t) for i, t in pairs if t and any(c.isalpha() for c in t)]
    stay = {i for _, i in kept(held)}
    new = {r["doc_id"]: r["text"] for r in corpus_pipeline.private(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    spark.conf.unset("spark.lectern.pii.secret")
    assert all(("@" in (t or "")) == (new[i] != t) for i, t in pairs)
    made = mixed_by_hand([(i, new[i], lang, s, 0) for i, _, lang, s, _ in rows if i in stay])
    ids = tokens_of([t for _, _, t in made.elements()])
    check_packed(out, list(zip([i for i, _, _ in made.elements()], ids)))
