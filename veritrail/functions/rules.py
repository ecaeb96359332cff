"""Verification rules: column expressions over a claim and the texts of its evidence.

A rule is a function (claim: string, evidence: array<string> in order) -> struct(verdict, confidence),
null where it does not apply or decides nothing. Words are matched at word borders, not inside other
words; ``legacy_substring=True`` matches anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import let, matches, normalized, sentences, words

VERDICT = "struct<verdict:string,confidence:double>"
YEAR = r"\b(?:19|20)\d\d\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"


def verdict(name: str, confidence: float) -> Column:
    return F.struct(F.lit(name).alias("verdict"), F.lit(confidence).cast("double").alias("confidence"))


def nothing() -> Column:
    return F.lit(None).cast(VERDICT)


def _has(c: Column, term: str, legacy: bool = False) -> Column:
    return F.lower(c).contains(term) if legacy else F.lower(c).rlike(r"\b" + term + r"\b")


def _found(c: Column, terms, legacy: bool = False) -> Column:
    """Those of ``terms`` (or values of a dict by its keys) that are in the text."""
    pairs = terms.items() if isinstance(terms, dict) else [(t, t) for t in terms]
    has = lambda low, k: low.contains(k) if legacy else low.rlike(r"\b" + k + r"\b")
    return let(F.lower(c), lambda low: F.array_distinct(F.array_compact(F.array(*[F.when(has(low, k), v) for k, v in pairs]))))


def _disjoint(a: Column, b: Column) -> Column:
    apart = lambda x: let(b, lambda y: (F.size(y) > 0) & ~F.arrays_overlap(x, y))
    return let(a, lambda x: F.when(F.size(x) > 0, apart(x)).otherwise(F.lit(False)))


def _joined(evidence: Column) -> Column:
    return F.lower(F.concat_ws(" ", evidence))


def _years(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(YEAR), F.lit(0))


def _extracted(evidence: Column, pattern: str) -> Column:
    return F.transform(evidence, lambda e: F.regexp_extract_all(F.lower(e), F.lit(pattern), F.lit(1)))


def temporal(claim: Column, evidence: Column, legacy: bool = False) -> Column:
    applies = matches(claim, r"\b(19\d\d|20\d\d|current|currently|former|ex-|played for|formed in|debuted)\b")
    years = _years(claim)
    out = F.when(matches(claim, r"\bcurrent(ly)?\b") & F.exists(evidence, lambda e: matches(e, r"\b(former|previously|ex-|played for)")), verdict("contradicted", 0.90))
    ev_years = F.flatten(F.transform(evidence, _years))
    any_year = F.when(F.size(years) == 0, nothing()).when(F.size(ev_years) == 0, nothing()).when(F.arrays_overlap(years, ev_years), verdict("supported", 0.92)).otherwise(verdict("contradicted", 0.90))
    out = F.coalesce(any_year, out)
    for p in reversed(L.TEMPORAL_PREDICATES):
        at = _extracted(evidence, rf"{p}\s+(?:in\s+)?((?:19|20)\d\d)")
        first = F.get(F.filter(at, lambda ys: F.size(ys) > 0), F.lit(0))
        dated = let(first, lambda f: F.when(f.isNotNull(), F.when(F.arrays_overlap(years, f), verdict("supported", 0.95)).otherwise(verdict("contradicted", 0.94))))
        out = F.coalesce(F.when(_has(claim, p, True) & (F.size(years) > 0), dated), out)
    return F.when(applies, out)


def _numbers(c: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))), lambda n: ~n.rlike(r"^(19|20)\d\d$"))


def numeric(claim: Column, evidence: Column, legacy: bool = False) -> Column:
    own = _numbers(claim)
    first = F.get(F.filter(F.transform(evidence, _numbers), lambda ns: F.size(ns) > 0), F.lit(0))
    as_double = lambda a: F.transform(a, lambda n: n.cast("double"))
    near = F.exists(as_double(own), lambda x: F.exists(as_double(first), lambda y: (x > 0) & (y > 0) & (F.abs(x - y) / F.greatest(x, y) <= 0.03)))
    out = F.when(first.isNull(), nothing()).when(F.arrays_overlap(own, first), verdict("supported", 0.95)).when(near, verdict("supported", 0.94)).otherwise(verdict("contradicted", 0.94))
    return F.when(claim.rlike(r"\b\d+(\.\d+)?\b"), out)


_ENTITY_WORDS = "founded created directed invented discovered wrote written painted developed landed born company organization entertainment band group club team agency president".split()


def entity(claim: Column, evidence: Column, legacy: bool = False) -> Column:
    joined = _joined(evidence)
    clash = _disjoint(_found(claim, L.COMPANIES, legacy), _found(joined, L.COMPANIES, legacy)) | _disjoint(_found(claim, L.PERSONS, legacy), _found(joined, L.PERSONS, legacy))
    return F.when(matches(claim, "|".join(_ENTITY_WORDS)), F.when(clash, verdict("contradicted", 0.96)))


def location(claim: Column, evidence: Column, legacy: bool = False, places: dict[str, str] | None = None) -> Column:
    """``places``: name to region; the built-in table by default."""
    places = places or L.PLACES
    clash = _disjoint(_found(claim, places, legacy), _found(_joined(evidence), places, legacy))
    denied = matches(claim, r"\b(not|never)\b")
    return let(clash, lambda c: F.when(c & denied, verdict("supported", 0.94)).when(c, verdict("contradicted", 0.96)))


def attribute(claim: Column, evidence: Column, legacy: bool = False) -> Column:
    c, e = F.lower(claim), _joined(evidence)
    has, ev = (lambda t: c.contains(t)), (lambda t: e.contains(t))
    applies = matches(claim, "absorb|currency|largest organ|prime number|visible from the moon|visible from space")
    wrong = (
        (has("absorb") & has("photosynthesis") & has("oxygen") & ev("carbon dioxide"))
        | ((has("currency") | has("euro") | has("pound")) & (has("united kingdom") | _has(claim, "uk")) & has("euro") & (ev("pound") | ev("sterling")))
        | (has("largest organ") & has("heart") & ev("skin"))
        | (has("smallest prime") & c.rlike(r"\b1\b") & ev("2"))
        | (has("visible") & has("moon") & (has("naked eye") | has("is visible")) & (ev("not visible") | ev("myth") | ev("cannot be seen")))
    )
    return F.when(applies & wrong, verdict("contradicted", 0.96))


def negation(claim: Column, evidence: Column, legacy: bool = False) -> Column:
    c, e = F.lower(claim), _joined(evidence)
    own = F.array_except(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3), F.array(F.lit("never")))
    shares = F.exists(own, lambda w: e.contains(w))
    denied = e.rlike("not|never|no") if legacy else matches(e, r"\b(not|never|no)\b")
    return F.when(matches(claim, r"\b(not|never)\b") & shares & ~denied, verdict("supported", 0.90))


Rule = Callable[[Column, Column], Column]
#: Rules by name, in the order in which they are asked.
CHECKERS: dict[str, Rule] = {"temporal": temporal, "numeric": numeric, "entity": entity, "location": location, "fact_attribute": attribute, "negation": negation}


def run_checkers(claim: Column, evidence: Column, checkers: dict[str, Rule] | None = None) -> Column:
    """struct(verdict, confidence, checker): the first contradiction, else the first verdict."""
    named = lambda n: lambda r: F.when(r.isNotNull(), F.struct(r["verdict"].alias("verdict"), r["confidence"].alias("confidence"), F.lit(n).alias("checker")))
    given = F.array_compact(F.array(*[let(f(claim, evidence), named(n)) for n, f in (checkers or CHECKERS).items()]))
    first = lambda xs: F.coalesce(F.get(F.filter(xs, lambda x: x["verdict"] == "contradicted"), F.lit(0)), F.get(xs, F.lit(0)))
    return let(given, first)  # each rule is asked once


def _some(evidence: Column, pattern: str) -> Column:
    return F.exists(evidence, lambda e: F.lower(e).rlike(pattern))


def negative_support(claim: Column, evidence: Column) -> Column:
    """Whether a denial is borne out: its field or origin is not in the evidence, another is."""
    c = F.lower(claim)
    w = F.split(c, r"\s+")
    bio = F.exists(evidence, lambda e: F.lower(e).rlike("|".join(L.BIOGRAPHY)))
    out = F.lit(False)
    for d in L.DOMAINS:
        out = out | (F.arrays_overlap(w, F.array(*map(F.lit, d))) & bio & ~_some(evidence, "|".join(d)))
    for k, n in enumerate(L.NATIONALITIES):
        others = "|".join(x for j, o in enumerate(L.NATIONALITIES) if j != k for x in o)
        out = out | (c.rlike(r"\b(" + "|".join(n) + r")\b") & _some(evidence, r"\b(" + others + r")\b"))
    return matches(claim, r"\b(never|not|no|couldn'?t\s+find)\b") & out


def _evidence_sentences(evidence: Column) -> Column:
    return F.transform(F.flatten(F.transform(evidence, lambda e: sentences(e, "drop_mark"))), normalized)


def explicit_contradiction(claim: Column, evidence: Column) -> Column:
    lists = lambda xs: F.array(*map(F.lit, xs))

    def conflict(own: Column, s: Column, sw: Column) -> Column:
        denied = s.rlike(r"\b(is not a|was not a|never played|did not play|false that)\b") & F.arrays_overlap(own, F.filter(sw, lambda w: F.length(w) > 4))
        clash = F.lit(False)
        for group in (L.DOMAINS, L.NATIONALITIES):
            for k, g in enumerate(group):
                others = [x for j, o in enumerate(group) if j != k for x in o]
                clash = clash | (F.arrays_overlap(own, lists(g)) & F.arrays_overlap(sw, lists(others)))
        return denied | (F.arrays_overlap(own, sw) & clash)

    own = F.array_distinct(F.split(normalized(claim), " "))
    return let(own, lambda o: F.exists(_evidence_sentences(evidence), lambda s: let(F.split(s, " "), lambda sw: conflict(o, s, sw))))


def direct_entailment(claim: Column, evidence: Column) -> Column:
    def entails(n: Column, own: Column) -> Column:
        share = lambda s: F.size(F.array_intersect(own, F.split(s, " "))) / F.size(own)
        return (F.length(n) >= 8) & F.exists(_evidence_sentences(evidence), lambda s: s.contains(n) | ((F.size(own) >= 3) & (share(s) >= 0.75)))

    return let(normalized(claim), lambda n: let(F.array_distinct(F.split(n, " ")), lambda own: entails(n, own)))


def synonym_equivalence(claim: Column, evidence: Column, similarity: Column | None = None) -> Column:
    """Share of the claim's words, widened by synonyms, in one evidence text; or a given similarity of 0.75."""

    def widened(own: Column) -> Column:
        more = [F.when(F.array_contains(own, w), F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>")) for w, xs in L.SYNONYMS.items()]
        return F.array_distinct(F.flatten(F.array(own, *more)))

    near = lambda own, wide: F.exists(evidence, lambda e: F.size(F.array_intersect(wide, words(e))) / F.greatest(F.size(own), F.lit(1)) >= 0.65)
    hit = let(words(claim), lambda own: let(widened(own), lambda wide: near(own, wide)))
    return hit | F.coalesce(similarity >= 0.75, F.lit(False)) if similarity is not None else hit


def verify(claim: Column, evidence: Column, first: Column | None = None) -> Column:
    """Verdict by precedence; ``first``: a verdict of stronger rules (team and role triples), null if they decide nothing."""
    e = F.filter(evidence, lambda x: x.isNotNull() & (x != ""))
    ruled = F.coalesce(
        first if first is not None else nothing(),
        F.when(negative_support(claim, e), verdict("supported", 0.90)),
        F.when(explicit_contradiction(claim, e), verdict("contradicted", 0.90)),
        F.when(direct_entailment(claim, e), verdict("supported", 0.95)),
        F.when(synonym_equivalence(claim, e), verdict("supported", 0.90)),
        verdict("insufficient", 0.30),
    )
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, verdict("insufficient", 0.30)).otherwise(ruled)


def fallback_confidence(name: Column, mean_score: Column) -> Column:
    strong = name.isin("supported", "contradicted")
    value = F.when(strong, 0.55).otherwise(0.30) + F.when(strong, 0.4).otherwise(0.2) * F.coalesce(mean_score, F.lit(0.5))
    return F.round(F.least(value, F.lit(0.95)), 2)


def long_words(claim: Column) -> Column:
    """Words of more than three characters, lower case, without marks at their ends; repeats count."""
    long = F.filter(F.split(F.trim(claim), r"\s+"), lambda w: F.length(w) > 3)
    return F.transform(long, lambda w: F.lower(F.regexp_replace(w, r"""^[.,!?"']+|[.,!?"']+$""", "")))


def word_match(claim: Column, evidence: Column) -> Column:
    """Share of the claim's long words that are in the evidence, anywhere; 0 without such words."""
    share = lambda own, low: F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: F.contains(low, w))) / F.size(own)).otherwise(0.0)
    return let(F.lower(F.coalesce(evidence, F.lit(""))), lambda low: let(long_words(claim), lambda own: share(own, low)))


def lexical_verdict(best: Column, match: Column) -> Column:
    """Verdict without rules: best sentence score of 0.30 or word match of 0.50 supports, any word in part, none contradicts."""
    supported = F.struct(F.lit("supported").alias("verdict"), F.round(F.least(F.lit(0.95), 0.70 + best), 2).alias("confidence"))
    return F.when((best >= 0.30) | (match >= 0.50), supported).when(match > 0, verdict("partial", 0.65)).otherwise(verdict("contradicted", 0.85))
