"""A labelled text beyond the bound on lines, and rows that repeat an id with another text."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pytest

from veritrail.llm import line_dedup, quality_crf, shared
from veritrail.session import ship

GOOD, BAD = "The river runs past the old mill and the bridge.\nIt was built long ago by the town.", "$$ 99 ## !!\n<<< click 0x9f >>>\n@@ ;; 77"


def test_a_text_over_the_bound_leaves_the_others(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(quality_crf, "SAMPLE_LINES", 200)
    rows = [(i, GOOD if i % 2 else BAD) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def scores(longer):
        docs = spark.createDataFrame([(i, "\n".join([t] * 300) if i == longer else t) for i, t in rows], "doc_id long, text string")
        return {r.doc_id: r.score for r in quality_crf.score(docs, quality_crf.fit(docs, labels)).collect()}

    for longer in range(0, 40, 13):  # whichever comes first
        found = scores(longer)
        assert max(found[i] for i in range(0, 40, 2) if i != longer) < 0.5 < min(found[i] for i in range(1, 40, 2) if i != longer)


@pytest.mark.parametrize("turned", [False, True])
def test_near_copies_of_a_repeated_id(spark, turned):
    """Two texts of one document share their first line; a later document has it with two words changed."""
    ship(spark)
    line = " ".join(f"word{i}" for i in range(40))
    near = line.replace("word7 ", "seven ").replace("word30 ", "thirty ")
    rows = [(1, line + "\nfirst text goes on here"), (1, line + "\nsecond text ends there now"), (5, near + "\nown words of the fifth document")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.n_removed): r.text for r in line_dedup.dedup(docs).collect()}
    assert got[5, 1] == "own words of the fifth document"


def test_texts_reach_workers_in_small_batches(spark):
    """A batch of Arrow ends at some MiB, however many texts are in a task."""
    docs = spark.range(3000).coalesce(1).selectExpr("id AS doc_id", "repeat('some words of a text. ', 300) AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality_crf.score(docs, quality_crf.fit(docs, labels))
    sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) < 2 * shared.BATCH_BYTES


def test_a_passage_that_repeats_gives_one_key():
    """Two lines in which one pair of words occurs many times meet once at that pair, and a line with one word changed still meets them."""
    def keys(words):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        return line_dedup.Lines(data, np.array([0, len(data)])).rare_pairs(np.zeros(1 << line_dedup.LEVEL_BITS, np.uint8))[1].tolist()

    one = ["same", "passage"] * 60
    found = keys(one)
    assert 1 <= len(found) == len(set(found)) <= 2
    assert set(found) & set(keys(one[:50] + ["other"] + one[51:]))


def test_pairs_of_lines_meet_once(spark):
    """Near-threshold copies share many pairs of words; the exhaustive join makes a row a pair of lines about, and loses none."""
    ship(spark)
    base = [f"word{i}" for i in range(60)]
    lines = [" ".join(w if i not in range(7 * d, 7 * d + 7) else f"own{d}x{i}" for i, w in enumerate(base)) for d in range(8)]
    docs = spark.createDataFrame([(d, t) for d, t in enumerate(lines)] + [(99, lines[3].replace("word59", "last"))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(docs).collect()}
    assert got == {**{d: 0 for d in range(8)}, 99: 1}


def test_near_lines_share_a_step_of_length():
    for n in range(line_dedup.WIDE, 3000):
        batch = pa.RecordBatch.from_arrays([pa.array([n, n + n // line_dedup.SHARE], pa.int32()), pa.array([[7], [7]], pa.list_(pa.int64()))], names=["n", "pairs"])
        own, following = line_dedup._steps(batch)
        assert {own[0], following[0]} & {own[1], following[1]}


def test_lines_just_beyond_the_bound_are_told_apart_before_they_are_read():
    """Of lines of 80 words with one replaced word more than is allowed, the parity lets few through."""
    rng = np.random.default_rng(3)
    through = 0
    for t in range(200):
        one = [f"word{t}x{i}" for i in range(80)]
        other = list(one)
        for i in rng.choice(80, 9, replace=False):
            other[i] = f"own{t}x{i}"
        text = "\n".join(" ".join(w) for w in (one, other)).encode()
        p = np.array(line_dedup.Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)])).parity())
        x = p[:, 0] ^ p[:, 1]
        long = [*x[2:], np.bitwise_xor.reduce(x[::2]), np.bitwise_xor.reduce(x[1::2])]
        through += np.bitwise_count(x[:2]).sum() <= 16 and sum(int(w).bit_count() for w in long) <= 16
    assert through < 90


def test_values_of_many_takes_binary_lists(spark):
    """Lists of longs as binary values give what arrays give, and a value of one row alone goes."""
    rows = [(1 << 60, [5, 7 << 40, -9]), (2 << 60, [7 << 40, 11]), (3 << 60, [-9, 13]), (3 << 60, [13]), (-1, [])]
    arrays = shared.stored(spark.createDataFrame(rows, "tag long, v array<long>"), "arrays")
    blobs = shared.stored(spark.createDataFrame([(t, np.array(v, np.int64).tobytes()) for t, v in rows], "tag long, v binary"), "blobs")
    plain = [(r.tag, r.v) for r in shared.only_held(arrays, "v", shared.values_of_many(arrays, "v", "tag", "of-arrays")).collect()]
    packed = [(r.tag, np.frombuffer(r.v, np.int64).tolist()) for r in shared.only_held(blobs, "v", shared.values_of_many(blobs, "v", "tag", "of-blobs")).collect()]
    assert sorted(plain) == sorted(packed)
    assert {x for _, v in plain for x in v} == {7 << 40, -9}


def test_workers_look_through_modules_once():
    """After a worker's first call, what lives then is not looked through again."""
    shared.released()
    assert gc.get_freeze_count() > 10_000
