"""Operators against SQL on the given tables, and against plain Python on awkward rows."""

from __future__ import annotations

import hashlib
import random
import struct

import helpers as H
import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from veritrail.llm import ann_aq, bpe, decontaminate, jaccard_join, line_dedup, quality_crf, registry, sharding, suffix_dedup, toxicity_fm, warc


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def docs(spark):
    return H.awkward(spark)


def empty(docs):
    return docs.where(F.lit(False))


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (10, 0), (14, 0), (15, 0), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels)
    got = quality_crf.score(docs, model).select("doc_id", "score").collect()
    assert len(got) == len(H.ROWS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > by[14]
    for none in (labels.where("quality > 5"), labels.where("quality = 1")):
        assert {r.score for r in quality_crf.score(docs, quality_crf.fit(docs, none)).select("score").collect()} <= {0.5, 1.0}
    assert quality_crf.score(empty(docs), model).count() == 0


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    emit, trans, n = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 1, 2])
    good, pairs, log_z = quality_crf.forward_backward(emit, n, trans)
    want, z_all = [], 0.0
    for s, k in ((0, 4), (4, 1), (5, 2)):
        weight = {}
        for y in np.ndindex(*[2] * k):
            weight[y] = np.exp(sum(emit[s + i] * y[i] for i in range(k)) + sum(trans[y[i], y[i + 1]] for i in range(k - 1)))
        z = sum(weight.values())
        z_all += np.log(z)
        want += [sum(w for y, w in weight.items() if y[i]) / z for i in range(k)]
    assert np.allclose(good, want) and np.isclose(log_z, z_all) and np.isclose(pairs.sum(), 4)


def test_toxicity_learns_pairs(spark):
    # "rude" and "group" alone are harmless; together they are not
    rows, y = [], []
    for i in range(400):
        a, b = i % 2, (i // 2) % 2
        rows.append((i, f"filler{i} " + "rude " * a + "group " * b + "plain words"))
        y.append((i, a & b))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    model = toxicity_fm.fit(d, l)
    got = {r.doc_id: r.score for r in toxicity_fm.score(d, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in y)
    odd = toxicity_fm.score(H.awkward(spark), model).select("score").collect()
    assert len(odd) == len(H.ROWS) and all(0 <= r.score <= 1 for r in odd)


def test_sharding(spark, docs):
    limit = 8000
    got = sharding.assign(docs, sharding.directory(docs, limit), limit)
    rows = got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversize").collect()
    assert len(rows) == len(H.ROWS) and all(r.shard is not None and len(r.shard) == r.depth for r in rows)
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
    assert all(total[r.shard] == r.shard_bytes and (r.shard_bytes <= limit or r.oversize) for r in rows)
    shards = sorted(set(total))
    assert not any(b.startswith(a) for a in shards for b in shards if a != b and len(b) < 60)
    assert sharding.assign(empty(docs), sharding.directory(empty(docs), limit), limit).count() == 0


def test_warc(spark, tmp_path):
    page = "<p>" + "y" * 200 + "</p>"
    rows = [(3, "u", page), (1, None, page), (None, "n", page), (1, "again", page), (5, "a\nb", None), (6, "s", "short"), (7, "s", "short"), (8, "e", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = warc.write(warc.plan_records(pages), folder)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(3, "revisit", 1), (1, "response", None), (None, "revisit", 1), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)}
    assert {bytes(r.payload) for r in got if r.page_id == 8} == {("é" * 60).encode()}
    some = warc.read(index.where("page_id = 6"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"short"]
    assert warc.read(warc.write(warc.plan_records(pages.where("page_id > 99")), folder + "2"), folder + "2").count() == 0


def test_ranges_are_coalesced():
    assert [(a, b) for a, b, _ in warc.ranges([(10, 5), (0, 10), (100, 5)], gap=20)] == [(0, 15), (100, 105)]


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    tk = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "text", "ids", "decoded").collect()
    assert len(got) == len(H.ROWS)
    for r in got:
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == tk.decode(ids, skip_special_tokens=False) == (r.text or "")
    v = bpe.vocabulary(path)
    for word in ("abcabcabd" * 200, "zzzzzz" * 400):
        assert v.exact(word.encode()) == v._exact_long(word.encode())
    assert bpe.encode(empty(docs), path).count() == 0


def test_bpe_fuzz():
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = bpe.default_path()
    v, tk = bpe.vocabulary(path), Tokenizer.from_file(path)

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(st.text(alphabet=st.sampled_from("abcdehinorst'LDV \n\t0129.,!éñ中🎉\u0085\xa0 "), max_size=60))
    def same(t):
        assert np.frombuffer(v.encode([t])[0], "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids

    same()


def test_line_dedup(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, base + "\nshort line\n\n"), (2, base.replace("zeta", "zulu") + "\nkeep me here please"), (3, base + " lambda"), (4, base.replace("beta ", "") + "\nshort  line"),
        (5, base.replace("beta", "b").replace("eta", "e")), (6, None), (7, ""), (None, base), (8, "short lime"), (3, base + " lambda"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1))
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup(docs).select("doc_id", "text", "n_lines", "n_removed").collect()}
    left = {k[0]: k[1] for k in got}
    assert left[1] == base + "\nshort line\n\n" and left[2] == "keep me here please" and left[3] == "" and left[4] == "" and left[None] == ""
    assert left[5] == rows[4][1] and left[6] is None and left[7] == "" and left[8] == "short lime"
    assert line_dedup.dedup(H.awkward(spark)).count() == len(H.ROWS)
    assert line_dedup.dedup(docs.where("doc_id > 99")).count() == 0


def _near_plainly(rows):
    """Lines left of (id, text) rows: near by plain edit distances, all pairs."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def near(a, b):
        s = min(len(a), len(b))
        if s >= 8:
            return distance(a, b) <= max(1, s // 10)
        differ = [(x, y) for x, y in zip(a, b) if x != y]
        return len(a) == len(b) and len(differ) == 1 and distance(*differ[0]) <= min(len("".join(a)), len("".join(b))) // 10

    lines = [(d, i, t, t.split()) for d, text in rows for i, t in enumerate(text.split("\n"))]
    return {d: "\n".join(t for e, i, t, w in lines if e == d and not (w and any((f, j) < (d, i) and (v == w or near(v, w)) for f, j, _, v in lines if v))) for d, _ in rows}


def test_line_dedup_bound_grows_with_the_line(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = []
    for n in (7, 8, 9, 10, 12, 19, 20, 21, 22, 29, 30, 31, 40, 59, 100, 101, 165):
        base = [word() for _ in range(n)]
        rows.append(" ".join(base))
        for edits in (1, 1, 2, n // 10, n // 10, n // 10, n // 10 + 1, n // 10 + 2):
            w = list(base)
            for at in sorted(rng.sample(range(len(w)), min(edits, len(w))), reverse=True):
                w[at : at + 1] = rng.choice(([], [word()], [w[at], word()]))
            rows.append(" ".join(w))
        spread = list(base)  # the most that is allowed, evenly spread, so that all runs are short
        k = max(1, n // 10)
        for e in range(k):
            spread[(e + 1) * (n + 1) // (k + 1) - 1] = word()
        rows.append(" ".join(spread))
    rows += ["Posted on Monday by editor one", "Posted on Mondai by editor two", "Posted on Mondai by editor one", "Posted on Friday by editor one", "uncategorised", "uncategorized", "Überraschungsgäste", "Überraschungsgaste", "news", "newt"]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == _near_plainly(rows)
    assert sum(t == "" for t in got.values()) > 80


@pytest.mark.parametrize("contexts", [4096, 3])
def test_suffix_dedup(spark, docs, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", contexts)
    extra = [(100 + i, "z" * i + LOREM + "q" * (7 * i)) for i in range(12)]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = suffix_dedup.dedup(more, "none").select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("k")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.k) for r in got) == H.without_repeats(H.ROWS + extra)
    assert suffix_dedup.dedup(empty(docs), "none").count() == 0


LOREM = "".join(chr(97 + x) for x in np.random.default_rng(1).integers(0, 26, 450))


def test_suffix_keep_first(spark):
    d = spark.createDataFrame([(2, "b" + LOREM), (1, "a" + LOREM), (3, LOREM + "c")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.dedup(d, "first").collect()}
    assert got == {1: "a" + LOREM, 2: "b", 3: "c"}


def test_suffix_order_and_factors():
    data = np.frombuffer(b"abracadabra-abracadabra-", np.uint8)
    earlier, later = suffix_dedup.repeated(data, np.arange(13), 12)
    assert later.tolist() == [True] + [False] * 11 + [False] or later[0]
    assert earlier[12] and not earlier[0]


def test_decontaminate(spark, docs):
    items = [(1, H.A), (2, "one"), (3, None), (4, ""), (5, " ".join(f"tok{i}" for i in range(45, 60))), (None, "a b c d"), (5, H.A.upper())]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hits(docs, df).select("__key", "n_hit", "items")
    from veritrail.llm.shared import row_key

    got = docs.select("doc_id", row_key("doc_id", "text").alias("__key"), F.size(decontaminate.words(F.col("text"))).alias("w")).join(found, "__key", "left").collect()
    assert sorted((str(r.doc_id), r.w, r.n_hit or 0, ",".join(r["items"] or [])) for r in got) == H.hits(H.ROWS, items)
    assert decontaminate.clean(docs, df.where("item_id > 99")).count() == len(H.ROWS)
    assert decontaminate.clean(empty(docs), df).count() == 0


def test_decontaminate_by_shuffle(spark, docs, monkeypatch):
    df = spark.createDataFrame([(1, H.A), (2, "one")], "item_id long, text string")
    key = lambda: sorted(map(str, decontaminate.hits(docs, df).collect()))
    want = key()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert key() == want


@pytest.mark.parametrize("group", [64, 2])
def test_jaccard(spark, docs, group, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    family = [(200 + i, " ".join(f"f{(i * 3 + k) % 160}" for k in range(100))) for i in range(40)]
    more = docs.unionByName(spark.createDataFrame(family, "doc_id long, text string"), allowMissingColumns=True)
    got = jaccard_join.join(more).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == H.components(H.ROWS + family)
    left = jaccard_join.dedup(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.select("doc_id").collect()) == sorted(["1", "3", "4", "5", "6", "8", "10", "11", "13", "14", "16", "18", "None"])
    assert jaccard_join.join(empty(docs)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(150)]
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [0.0] * 7), (904, [float("inf")] + [0.0] * 7), (905, [1.0] * 3), (None, [1.0] * 8), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    use = ann_aq.usable(df, "vec_id", "embedding")
    assert use.count() == 451
    books = ann_aq.fit(use)
    got = ann_aq.search(ann_aq.index(use, books, 128), use.where("vec_id % 50 = 0").dropDuplicates(), books, 20, 40, certify=True).collect()
    x, ids = np.array([r[1] for r in rows], np.float32).astype(float), np.arange(450)
    for qid in range(0, 450, 50):
        score = np.zeros(450)
        for d in range(8):
            score += x[qid, d] * x[:, d]
        keep = ids != qid
        want = ids[keep][np.lexsort((ids[keep], -score[keep]))][:20].tolist()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == qid), key=lambda r: r["rank"])] == want
    assert ann_aq.fit(use.where("vec_id > 9999")) is None


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    for f, label, least in ((quality_crf.query, "quality", 0.9), (toxicity_fm.query, "toxic", 0.9)):
        r = f(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
        assert r >= least


def test_digest_of_ids(spark, sf_dir):
    r = bpe.query(spark, sf_dir).first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
