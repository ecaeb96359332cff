"""Plain Python versions of the operators, and a table of awkward rows."""

from __future__ import annotations

import collections
import hashlib
import re

A, B = "The quick brown fox jumps over the lazy dog near the old river bank today.", "Ünïcode wörds äre älso hére for the täst."
LONG = " ".join(f"word{i % 977}x{i}" for i in range(6000))
NEAR = " ".join(f"tok{i}" for i in range(100))
#: doc_id, text: nulls, blanks, repeats, ties, near copies, a very long text, one word, marks only.
ROWS = [
    (1, A), (2, A), (2, A), (3, None), (4, ""), (5, "   \n \n"), (6, LONG), (7, LONG + " tail"), (None, B), (None, B), (8, "one"), (9, "one"), (10, "!!! ???"), (11, NEAR),
    (12, NEAR.replace("tok50", "other")), (13, A + "\n" + B + "\n" + A), (14, "x" * 5000), (15, "x" * 5000), (16, "a b c d"), (17, "A B C D"), (18, "<|endoftext|> it's 中文 🎉\x00\x1f"),
]


def awkward(spark):
    """The rows with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = {c: F.lit("extra") for c in ("lang", "source", "score", "shard", "depth", "ids", "kept", "spans", "gone", "h", "n", "sig", "g", "label", "items", "n_bytes", "n_lines")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """(doc_id, size, component) of each row, sorted as text."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    pick = lambda i: min((x for x in least[find(i)] if x is not None), default=None)
    return sorted((str(d), len(sets[i]), str(pick(i) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def without_repeats(rows, length=200):
    """(doc_id, bytes, removed, spans, digest) of each row."""
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((str(d), len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def hits(rows, items):
    """(doc_id, words, hit words, items) of each row."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            grams[tuple(w[k : k + m])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in grams:
                    hit.update(range(k, k + m))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((str(d), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)
