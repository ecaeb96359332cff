"""Hard negatives, packing and conversation repair: SQL, plain Python and awkward rows."""

from __future__ import annotations

import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import assert_same
from helpers import awkward
from pyspark.sql import functions as F

from veritrail.llm import bpe, conversation_repair, hard_negatives, packing, registry
from veritrail.session import ship


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_conversation_repair"])
def test_query_matches_sql(spark, sf_dir, name):
    ship(spark)
    assert_same(spark, sf_dir, registry.queries()[name], registry.oracle_sql()[name])


# hard negatives


@pytest.mark.parametrize("most, dim", [(3, 5), (200, 64), (10**4, 1500), (2**22, 70), (2.0**60, 9), (2.0**140, 3)])
def test_products_are_exact(most, dim):
    rng = np.random.default_rng(3)
    a, b = (np.floor(rng.uniform(-most, most, (n, dim))) for n in (7, 11))
    a[0], b[0], b[1] = most, most, -most
    found = hard_negatives.products(a, b)
    for i, j in ((i, j) for i in range(7) for j in range(11)):
        true = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
        assert found[i, j] == max(-(2**63 - 1), min(2**63 - 1, true))


def _mined(rows, anchors, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by a double loop over distinct rows."""
    fine = {(i, y, tuple(v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    score = lambda v, w: sum(x * y for x, y in zip(whole(v), whole(w)))
    out = []
    for i, y, v in fine:
        if i not in anchors:
            continue
        others = sorted((-score(v, w), j, z) for j, z, w in fine if j != i)
        for place, (p, j, _) in enumerate([x for x in others if x[2] == y][:positives], 1):
            kept = [(-s, k) for s, k, z in others if z != y and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, place, j, -p, r, k, s) for r, (s, k) in enumerate(kept, 1)]
    return sorted(out)


def _vectors():
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-0.3, 1) for _ in range(rng.choice([6, 6, 4]))], rng.randrange(3)) for i in range(140)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(60)]  # ties
    rows += [rows[3], rows[3], rows[140], (5, [0.25] * 6, 1)]  # repeated rows, one id with another vector
    return rows + [(None, [1.0], 1), (300, None, 1), (301, [1.0], None), (302, [1.0, None], 1), (303, [float("nan")], 1), (304, [float("inf")], 1), (305, [], 1), (306, [0.0] * 6, 2)]


def test_negatives_match_a_double_loop(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "HELD_BLOCKS", 1)
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>, label int").repartition(3).withColumns({c: F.lit("x") for c in ("key", "block", "score", "window", "low")})
    rows = hard_negatives.usable(df, "vec_id", "embedding", "label")
    anchors = {0, 5, 10, 50, 203, 305, 306}
    found = hard_negatives.mine(rows, F.col("vec_id").isin(*anchors))
    got = sorted(tuple(r) for r in found.select("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score").collect())
    assert got and got == _mined(_vectors(), anchors)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.usable(empty, "vec_id", "embedding", "label"), F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.usable(one, "vec_id", "embedding", "label"), F.lit(True)).count() == 0


# packing


def _library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_runs_encode_as_the_library_does(monkeypatch):
    rng, library, vocab = random.Random(2), _library(), bpe.vocabulary(bpe.default_path())
    letters = [*"ab c  \n\t\r.,'Zé中\x1c\x1f\xa0　 ​́\0", "<|endoftext|>", " <|endoftext|>", "'ll", "'s", "  ", "x" * 60, "12"]
    texts = [None, "", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000))]
    true = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    vocab.forget_runs()
    assert vocab.encode_runs(texts) == true
    assert vocab.encode_runs(texts) == true  # remembered
    monkeypatch.setattr(bpe, "RUNS_REMEMBERED", 50)
    assert [x for k in range(0, len(texts), 40) for x in vocab.encode_runs(texts[k : k + 40])] == true
    monkeypatch.setattr(bpe, "PIECE_BYTES", 1)
    monkeypatch.setattr(bpe, "RUNS_AT_ONCE", 3)
    assert vocab.encode_runs(texts) == true


def _assert_packed(rows, texts, tiers=packing.TIERS, step=packing.STEP_TOKENS):
    """Every id in one piece, sequences gapless and of a tier's size or a power of two, groups even."""
    library = _library()
    docs = defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
    true = defaultdict(list)
    for d, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        true[d, len(ids)].append(ids)
    assert docs.keys() == true.keys()
    for key, pieces in docs.items():
        same = true[key]
        covered = sorted((r.start, bytes(r.ids)) for r in pieces)
        if len(same) == 1:
            ids = np.frombuffer(b"".join(b for _, b in covered), "<u4").tolist()
            assert ids == same[0] and [s for s, _ in covered] == list(np.cumsum([0] + [len(b) // 4 for _, b in covered])[:-1])
        else:  # documents that share id and length
            assert sum(len(b) // 4 for _, b in covered) == sum(map(len, same))
    sequences, groups = defaultdict(list), defaultdict(dict)
    for r in rows:
        sequences[r.sequence_id].append(r)
        groups[r.step_group][r.sequence_id] = r.sequence_tokens
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = list(np.cumsum([len(r.ids) // 4 for r in pieces]))
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] == pieces[0].sequence_tokens and ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= tiers[-1]
    return [sum(g.values()) for g in groups.values()]


def test_packing_keeps_every_id(spark, sf_dir):
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, bpe.default_path()).collect()
    groups = _assert_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(g != packing.STEP_TOKENS for g in groups) <= docs.rdd.getNumPartitions()
    assert len(rows) < 2 * docs.count()


def test_packing_of_awkward_rows_in_small_pools(spark):
    ship(spark)
    df = awkward(spark).withColumns({c: F.lit("x") for c in ("start", "length", "offset", "sequence_id")}).coalesce(1)
    rows = packing.pack(df, bpe.default_path(), tiers=(8, 16, 32), cell_tokens=200, step_tokens=64).collect()
    groups = _assert_packed(rows, [(r.doc_id, r.text) for r in df.collect()], tiers=(8, 16, 32))
    assert sum(g != 64 for g in groups) <= 1
    assert packing.pack(df.limit(0), bpe.default_path()).count() == 0


def test_packing_query_digests(spark, sf_dir):
    ship(spark)
    got = {(r.doc_id, r.start): r for r in packing.query(spark, sf_dir).collect()}
    for r in packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.default_path()).collect():
        other = got[r.doc_id, r.start]
        assert (other.length, other.ids_crc32) == (len(r.ids) // 4, zlib.crc32(r.ids))


# conversations


def _cheapest(codes):
    """Least (cost, audit) over targets, by plain recursion over strings."""
    n, best = len(codes), None
    for t in [("s" if k % 2 else "") + "ua" * (k // 2) for k in range(n + 6) if k != 1]:

        @functools.cache
        def f(i, j):
            if i == n and j == len(t):
                return 0, ""
            found = []
            steps = [(4, "D", i + 1, j)] if i < n else []
            if j < len(t) and t[j] != "s":
                steps.append((3, "I", i, j + 1))
            if i < n and j < len(t) and not codes[i] & 4:
                short = 3 if codes[i] & 8 else 0
                steps += [(short, "K", i + 1, j + 1)] if "xsua"[codes[i] & 3] == t[j] else []
                steps += [(3 + short, "R", i + 1, j + 1)] if t[j] != "s" else []
            for c, letter, x, y in steps:
                rest, audit = f(x, y)
                found.append((c + rest, letter + audit))
            return min(found) if found else (10**9, "")

        best = f(0, 0) if best is None else min(best, f(0, 0))
    return best


def test_alignment_and_fold_match_recursion():
    rng = random.Random(4)
    some = [[rng.choice([0, 1, 2, 2, 3, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randrange(9))] for _ in range(600)]
    cost, audit = conversation_repair.align([np.array(c, np.int64) for c in some])
    for codes, c, a in zip(some, cost, audit):
        assert (c, a) == _cheapest(codes)
        table, folded = conversation_repair._folded(codes)
        assert (c, a) == (table[0][0], folded)


def _talk():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", "", " \n", None, "What?  ", "é.", "a" * 3000])) for c in range(40) for t in range(rng.randrange(1, 9))]
    return rows + rows[:5] + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "assistant", "Ho."), (77, None, "user", "x."), (78, None, None, None)]


def test_long_conversations_match_short_ones(spark, monkeypatch):
    ship(spark)
    df = spark.createDataFrame(_talk(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "gone", "blank", "cost", "audit", "fault")})
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    gone = F.col("turn") == 3
    took = lambda: sorted(map(str, conversation_repair.repair(df, gone=F.coalesce(gone, F.lit(False))).select(columns).collect()))
    short = took()
    assert len(short) == len({r[0] for r in _talk()})
    monkeypatch.setattr(conversation_repair, "LONG_ROWS", 3)
    assert took() == short


def test_repair_of_awkward_rows_matches_sql(spark, tmp_path):
    ship(spark)
    df = spark.createDataFrame(_talk(), "conv_id long, turn long, role string, text string").where("role <> '' or role is null")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb
    from compare import rows

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    mine = conversation_repair.query(spark, str(tmp_path)).toPandas()
    assert rows(mine) == rows(c.sql(conversation_repair.ORACLE).df())


def test_repair_of_nothing(spark):
    ship(spark)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(empty).count() == 0
    row = conversation_repair.repair(empty.union(spark.createDataFrame([(1, 1, "user", "x")], empty.schema)), gone=F.lit(True)).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired, row.gaps) == (1, 0, "", "", 0)
    assert row.repaired_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
