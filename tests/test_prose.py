"""Retrieval of prose by blocks with bars, and support of claims, against plain Python and Spark's own functions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritrail.functions import rules as R
from veritrail.functions import text as T
from veritrail.operators import prose, retrieval


def _top(asked, facts, k):
    out = []
    for i, words in asked:
        scored = sorted((-len(set(words) & set(ws)), f) for f, ws in facts if set(words) & set(ws))[:k]
        out += [(i, f, -s, r) for r, (s, f) in enumerate(scored, 1)]
    return sorted(out)


def _tables(seed, n_ids=300, n_facts=400):
    rng = random.Random(seed)
    words = lambda n: [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(n))]
    return [(f"c{i}", words(14)) for i in range(n_ids)], [(i, words(rng.choice([5, 30, 120]))) for i in range(n_facts)]


def test_shuffle_does_not_grow_with_blocks(spark):
    """Cells are made from stored blocks: what is shuffled does not grow when there are many more of them."""
    rng = random.Random(1)
    own = lambda words: [*words, *(rng.randbytes(12).hex() for _ in words)]  # noqa: E731  words that don't get smaller
    asked, facts = ([(i, own(words)) for i, words in rows] for rows in _tables(1))
    a, f = spark.createDataFrame(asked, "id string, words array<string>"), spark.createDataFrame(facts, "fact long, words array<string>").repartition(4)
    bytes_written, listener = [], spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = listener.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    for sizes in ((10**6, 10**6), (150, 700)):
        before = shuffled()
        rows = retrieval.shared_words_blocked(a, f, 3, *sizes).select("id", "fact", "score", "rank").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        bytes_written.append(shuffled() - before)
        assert sorted(map(tuple, rows)) == _top(asked, facts, 3)
    assert bytes_written[1] < 2 * bytes_written[0]


@pytest.mark.parametrize("longest", [3, 40])
def test_bars_from_few_facts_match_all_pairs(spark, monkeypatch, longest):
    monkeypatch.setattr(prose, "LONGEST", longest)
    asked, facts = _tables(longest)
    a, f = spark.createDataFrame(asked, "id string, words array<string>"), spark.createDataFrame([(f"f{i:04}", w) for i, w in facts], "fact string, words array<string>")
    found = retrieval.shared_words_blocked(a, f, 3, 700, 2000)
    assert sorted(map(tuple, found.select("id", "fact", "score", "rank").collect())) == _top(asked, [(f"f{i:04}", w) for i, w in facts], 3)


def _block(task, key, rows, *names):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=[key, "words"])
    (block,) = task(iter([batch]))
    return prose._opened(block.column(0)[0])


@pytest.mark.parametrize("least, entries, lowered", [(1, 7, 0), (3, 10**6, 0), (10**6, 50, 1), (2, 1, 2)])
def test_reached_lists_all_that_are_as_good_as_the_bar(monkeypatch, least, entries, lowered):
    """Any bitmaps, runs and bars: an id's best facts of a block, but those under its bar or beyond its key at the bar."""
    monkeypatch.setattr(prose, "ENTRIES", entries)
    asked, facts = _tables(entries, 80, 120)
    index = prose.Index(**_block(prose._fact_blocks(10**6), "fact", facts), least=least)
    block, rng = _block(prose._asked_blocks(10**6), "id", asked), random.Random(5)
    best = {}
    for i, f, score, rank in _top(asked, facts, 3):
        best[i] = (score, f) if rank == 3 else best.get(i)
    bar = [max(1, best[i][0] - lowered) if best.get(i) else 1 for i, _ in asked]
    upto = [rng.choice([best[i][1], 0, 60, 1000]) if best.get(i) else None for i, _ in asked]
    ids = block.pop("ids").to_pylist()
    i, row, score = prose._reached(index, **block, bar=np.array(bar, np.int32), upto=pa.array(upto, pa.int64()), k=5)
    got = sorted((ids[a], index.facts[int(b)].as_py(), int(c)) for a, b, c in zip(i, row, score, strict=True))
    limit = {i: (b, 10**9 if u is None else u) for (i, _), b, u in zip(asked, bar, upto, strict=True)}
    assert got == sorted((i, f, s) for i, f, s, _ in _kept(_top(asked, facts, 10**6), limit, 5))


def _kept(rows, limit, k):
    n = {}
    for row in sorted(rows, key=lambda r: (r[0], r[3])):
        b, u = limit[row[0]]
        if (row[2] > b or row[2] == b and row[1] <= u) and n.setdefault(row[0], 0) < k:
            n[row[0]] += 1
            yield row


def test_texts_are_cut_at_ascii_white_space(spark):
    claims = spark.createDataFrame([("a", " Über alles  the\tsea\x0bside "), ("b", "İstanbul ΣΑΣ"), ("c", ""), ("d", None)], "claim_id string, text string")
    facts = spark.createDataFrame([(1, "the SEA"), (2, "über alles\nside"), (3, "i̇stanbul σας Über"), (4, None), (5, "  ")], "fact_id long, text string")
    rows = lambda prose: sorted(map(tuple, retrieval.lexical_retrieve(claims, facts, 3, prose=prose).collect()))
    assert rows(True) == rows(False) != []


def test_support_of_odd_texts_matches_rules(spark):
    """Letters beyond ASCII, other line ends, capitals that grow, marks, zero bytes, long and short words in many claims."""
    texts = [
        "İstanbul'da çok güzel bir yer var. ΣΑΣ ΟΔΟΣ ist größer als ½ und x²! 東京は 大きい 都市です 一二三四. Ends here  ", "12345678901234 \u0085. 1234567890123456 ", "a\0b zero bytes\0inside of words. and_under scores 1st 2nd",
        "naïve café crème brûlée étude ‿tie٣٤ Ⅷth 𝒳yz 😀 face.\tNext\x0bsentence is here?  Last", "", None, "thtioning hashable " * 30 + "the end. " + " ".join(f"token{i}x" for i in range(400)) + ".",
    ]
    rng = random.Random(2)
    parts = [w for t in texts if t for w in t.split(" ")] + ["oken39", "9x", "....", "token3", "hashabl", "tioning.", "\"abcdefghijkl\"", "enx", "ken1x tok"]
    claims = [(f"c{i}", " ".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(150)]
    c, d = spark.createDataFrame(claims, "claim_id string, text string"), spark.createDataFrame(list(enumerate(texts)), "fact_id long, text string")
    found = c.select("claim_id").crossJoin(d.select("fact_id")).where("pmod(xxhash64(claim_id), 7) = fact_id OR fact_id = 6 AND pmod(xxhash64(claim_id), 2) = 0")
    got = {r.claim_id: (r.best, r.match) for r in retrieval.document_support(found, c, d).collect()}
    j = found.join(c, "claim_id").join(d.select("fact_id", F.col("text").alias("doc")), "fact_id")
    match = {r.claim_id: r.m for r in j.groupBy("claim_id").agg(F.max(R.word_match(F.col("text"), F.col("doc"))).alias("m")).collect()}
    s = j.select("claim_id", "text", F.explode_outer(T.sentences(F.col("doc"), "mark", 15)).alias("s"))
    best = {r.claim_id: r.b for r in s.groupBy("claim_id").agg(F.max(F.coalesce(T.word_overlap(F.col("text"), F.col("s")), F.lit(0.0))).alias("b")).collect()}
    assert len(got) == 150 and got == {k: (best[k], match[k]) for k in got}
