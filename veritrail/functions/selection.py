"""Column functions over a claim and the sentences of a document: scores, the best of them, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .text import clean_evidence_sentences, let, matches, score_tokens, sentences, strip, word_overlap

SCORE = "struct<pos:int,sentence:string,score:double,support:double,contradiction:double,neutral:double,sim:double,ent:double,cov:double>"


def _contained(words: Column, low: Column) -> Column:
    """How many of ``words`` are in the lower-cased text, anywhere."""
    return F.size(F.filter(words, lambda w: F.contains(low, F.lower(w))))


def proper_nouns(claim: Column, targets: Column) -> Column:
    """Capitalised words of the claim and of the target names, less stop words."""
    own = F.regexp_extract_all(claim, F.lit(r"\b[A-Z][a-z0-9]+\b"), F.lit(0))
    named = F.filter(F.flatten(F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.split(strip(t), r"\s+"))), lambda w: w.rlike(r"^\p{Lu}"))
    return F.filter(F.array_distinct(F.concat(own, named)), lambda w: ~F.lower(w).isin(*L.STOP_SCORE))


def denies(c: Column, legacy: bool = False) -> Column:
    """Whether a text denies; ``legacy`` matches inside words too."""
    return F.lower(c).rlike("no|never|didn't") if legacy else matches(c, r"\b(not?|never|didn't)\b")


#: What scores need of a sentence and of a claim: made once for each, however many of the others they meet.
PARTS = "struct<pos:int,sentence:string,tokens:array<string>,low:string,density:double,denies:boolean>"


def sentence_parts(document: Column, legacy: bool = False) -> Column:
    """Array of ``PARTS``: every sentence of a document that can state something, in order."""

    def one(s: Column, i: Column) -> Column:
        facts = F.filter(F.regexp_extract_all(s, F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*L.STOP_SCORE))
        density = F.least(F.lit(1.0), F.size(facts) / F.greatest(F.lit(1), F.size(F.split(strip(s), r"\s+"))))
        return F.struct(i.cast("int"), s, score_tokens(s), F.lower(s), density, denies(s, legacy)).cast(PARTS)

    return F.transform(clean_evidence_sentences(document), one)


def claim_parts(claim: Column, targets: Column, legacy: bool = False) -> Column:
    """struct(tokens, names, heads, denies) of a claim about the target names."""
    heads = lambda p: F.array_distinct(F.transform(F.filter(p, lambda w: F.length(w) > 2), F.lower))
    return let(proper_nouns(claim, targets), lambda p: F.struct(score_tokens(claim).alias("tokens"), F.transform(p, F.lower).alias("names"), heads(p).alias("heads"), denies(claim, legacy).alias("denies")))


# Scores are made in steps from x (of ``PARTS``), about (of ``claim_parts``) and v, the values of the steps before.
def _sizes(x, about, v):
    return {"n_s": F.size(x["tokens"]), "n_c": F.size(about["tokens"]), "both": F.size(F.array_intersect(x["tokens"], about["tokens"]))}


def _similar(x, about, v):
    sim = 0.5 * v["both"] / (v["n_s"] + v["n_c"] - v["both"]) + 0.5 * v["both"] / F.least(v["n_s"], v["n_c"])
    return {"empty": (v["n_s"] == 0) | (v["n_c"] == 0), "sim": F.when((v["n_s"] > 0) & (v["n_c"] > 0), sim)}


def _named(x, about, v):
    share = lambda words: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(x["low"], w))) / F.size(words)).otherwise(v["sim"])
    return {"ent": share(about["names"]), "rel": share(about["heads"])}


def _judged(x, about, v):
    sim, ent, rel = v["sim"], v["ent"], v["rel"]
    flip = (about["denies"] != x["denies"]) & (ent >= 0.5)
    contra = F.when(flip, F.least(F.lit(1.0), 0.70 + 0.30 * ent)).otherwise(F.greatest(F.lit(0.0), 0.10 * (1.0 - sim)))
    return {"support": F.when(flip, 0.30 * sim).otherwise(F.least(F.lit(1.0), 0.5 * sim + 0.5 * rel)), "contra": contra}


def _scores(x, v) -> list[Column]:
    """Values of ``SCORE`` after pos and sentence: names, relation, density and lead; support, contradiction, the rest."""
    lead = F.when(x["pos"] < 3, 1.0).when(x["pos"] < 5, 0.5).otherwise(0.1)
    rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.40 * v["ent"] + 0.30 * v["rel"] + 0.20 * x["density"] + 0.10 * lead))
    values = [rank, F.round(v["support"], 4), F.round(v["contra"], 4), F.round(F.greatest(F.lit(0.0), 1.0 - (v["support"] + v["contra"])), 4), F.round(v["sim"], 4), F.round(v["ent"], 4), F.round(x["density"], 4)]
    return [F.when(v["empty"], e).otherwise(value) for e, value in zip([0.10, 0.10, 0.0, 0.90, 0.10, 0.0, 0.0], values)]


_STEPS = [_sizes, _similar, _named, _judged]


def _score(x: Column, about: Column) -> Column:
    def after(i: int, v: dict) -> Column:
        if i == len(_STEPS):
            return F.struct(x["pos"], x["sentence"], *_scores(x, v)).cast(SCORE)
        new = _STEPS[i](x, about, v)
        return let(F.struct(*[c.alias(n) for n, c in new.items()]), lambda s: after(i + 1, {**v, **{n: s[n] for n in new}}))

    return after(0, {})


def score_rows(df: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns with ``SCORE``, a row a sentence, of ``df`` with parts (of ``sentence_parts``) and about (of ``claim_parts``)."""
    rows = df.select(*kept, F.col("about").alias("__about"), F.explode("parts").alias("__x"))
    x, about, v = F.col("__x"), F.col("__about"), {}
    for step in _STEPS:
        new = step(x, about, v)
        rows = rows.withColumns({f"__{n}": c for n, c in new.items()})
        v.update({n: F.col(f"__{n}") for n in new})
    names = ["score", "support", "contradiction", "neutral", "sim", "ent", "cov"]
    return rows.select(*kept, F.col("__x.pos").alias("pos"), F.col("__x.sentence").alias("sentence"), *[c.alias(n) for n, c in zip(names, _scores(x, v))])


def score_parts(parts: Column, about: Column) -> Column:
    """Array of ``SCORE`` of ``sentence_parts`` against ``claim_parts``."""
    return F.transform(parts, lambda x: _score(x, about))


def score_sentences(document: Column, claim: Column, targets: Column, legacy: bool = False) -> Column:
    """Array of ``SCORE``: every sentence of a document that can state something, in order."""
    return let(claim_parts(claim, targets, legacy), lambda about: score_parts(sentence_parts(document, legacy), about))


def select_sentences(scores: Column, document: Column, top_k: int = 3, ratio: float = 0.80) -> Column:
    """struct(sentences, excerpt, strength): those of 0.80 of the best score and 0.35, ``top_k`` at most, else the best one.

    ``scores``: of ``score_sentences``. A document without sentences gives its first 250 characters at 0.50.
    """
    start = F.substring(F.coalesce(document, F.lit("")), 1, 250)
    none = F.struct(F.when(start == "", F.array().cast("array<string>")).otherwise(F.array(start)).alias("sentences"), start.alias("excerpt"), F.lit(0.50).alias("strength"))

    def chosen(ranked: Column) -> Column:
        best = F.get(ranked, F.lit(0))
        good = F.filter(ranked, lambda x: (x["score"] >= best["score"] * ratio) & (x["score"] >= 0.35))
        kept = F.slice(F.when(F.size(good) > 0, good).otherwise(F.slice(ranked, 1, 1)), 1, top_k)
        top = F.get(kept, F.lit(0))
        lead = F.when(F.exists(ranked, lambda x: (x["pos"] < 3) & (x["sentence"] == top["sentence"])), 0.10).otherwise(0.05)
        strength = F.greatest(F.lit(0.45), F.least(F.lit(0.95), 0.45 * top["sim"] + 0.30 * top["ent"] + 0.15 * top["score"] + lead))
        return F.struct(F.transform(kept, lambda x: x["sentence"]).alias("sentences"), top["sentence"].alias("excerpt"), F.round(strength, 4).alias("strength"))

    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["pos"] - b["pos"])
    return F.when(F.size(scores) == 0, none).otherwise(let(F.array_sort(scores, order), chosen))


def best_excerpt(document: Column, terms: Column) -> Column:
    """The sentence with most of the terms' words (over two letters), the first of equals; without sentences or terms the first 300 characters."""
    start = F.substring(F.coalesce(document, F.lit("")), 1, 300)
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(document, F.lit("")), "\n", " "), r"\."), strip), lambda s: F.length(s) > 10)
    wanted = F.filter(F.flatten(F.transform(terms, lambda t: F.split(F.lower(strip(t)), r"\s+"))), lambda w: F.length(w) > 2)
    rows = F.transform(parts, lambda s, i: F.struct((-_contained(wanted, F.lower(s))).alias("hits"), i.alias("pos"), s.alias("s")))
    best = F.array_min(rows)["s"]
    return F.when((F.size(terms) == 0) | (F.size(parts) == 0), start).otherwise(F.concat(best, F.lit(".")))


def best_sentence_score(claim: Column, passage: Column) -> Column:
    """Score of the passage's best sentence: word overlap, 0.35 more for a shared predicate, 1 at most; 0.5 without sentences, 0 without a passage."""
    ss = sentences(passage, "mark", 15)
    has = F.filter(F.array(*map(F.lit, L.PREDICATES)), lambda p: F.contains(F.lower(claim), p))
    score = lambda s: F.round(F.least(F.lit(1.0), word_overlap(claim, s) + F.when(F.exists(has, lambda p: F.contains(F.lower(s), p)), 0.35).otherwise(0.0)), 4)
    return F.when(F.coalesce(passage, F.lit("")) == "", 0.0).when(F.size(ss) == 0, 0.5).otherwise(F.array_max(F.transform(ss, score)))
