"""Queries of evidence selection and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import selection as E
from ..functions.text import jaccard
from ..operators import evidence as V
from ..operators import retrieval as R
from .profiles import PROFILES, claims, pages, people
from .q_text import _LETTERS, SPLIT, sql_except, sql_jaccard, sql_overlap_words, strings, strip
from ..session import ROWS_OF_TASK
from .registry import query, table

# --- sentences of pages against claims ------------------------------------------------------------------------
PAIRS = f"{PROFILES}, pairs AS (SELECT c.claim_id, p.page_id, c.text AS claim, p.text AS doc, [c.person] AS targets FROM pcl c JOIN ppg p USING (k))"


def pairs(spark, d):
    """claim_id, page_id, claim, doc, targets: every claim with the pages of its person."""
    ppl = people(spark, d)
    p = pages(ppl).select("k", "page_id", F.col("text").alias("doc"))
    return claims(ppl).join(p, "k").select("claim_id", "page_id", F.col("text").alias("claim"), "doc", F.array("person").alias("targets"))


def met(spark, d):
    """Pairs with parts of the page and of the claim: pages are cut, and words of claims taken, before they meet."""
    ppl = people(spark, d)
    p = pages(ppl).select("k", "page_id", F.col("text").alias("doc"), E.sentence_parts(F.col("text")).alias("parts"))
    c = claims(ppl).select("k", "claim_id", E.claim_parts(F.col("text"), F.array("person")).alias("about"))
    return c.join(p, "k")


_tokens = lambda x: sql_except(rf"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+(?:\.[a-z0-9]+)*')), lambda w: length(w) > 1)", L.STOP_SCORE)
_denies = lambda x: rf"regexp_matches(lower({x}), '\b(not?|never|didn''t)\b')"
SCORED = rf"""sa AS (SELECT *, list_transform({SPLIT['mark'](strip(r"regexp_replace(doc, '(?i)\[\d+\]|\[citation needed\]|\[edit\]', '', 'g')"))}, lambda s: {strip('s')}) AS ss FROM pairs),
sb AS (SELECT *, list_filter(ss, lambda s: length(s) >= 20 AND s NOT LIKE '==%' AND s NOT LIKE '—%' AND (len(list_intersect({_LETTERS}, {strings(L.ACTION_VERBS)})) > 0 OR len({_LETTERS}) >= 6)) AS good FROM sa),
sc AS (SELECT claim_id, page_id, claim, targets, CASE WHEN len(good) > 0 THEN good ELSE list_filter(ss, lambda s: length(s) >= 15) END AS ss FROM sb),
sd AS (SELECT claim_id, page_id, claim, (i - 1)::INT AS pos, ss[i] AS s, targets FROM sc, unnest(range(1, len(ss) + 1)) AS r(i)),
se AS (SELECT *, {_tokens('s')} AS st, {_tokens('claim')} AS ct, list_filter(list_distinct(list_concat(regexp_extract_all(claim, '\b[A-Z][a-z0-9]+\b'), list_filter(flatten(list_transform(targets, lambda t: string_split_regex(t, '\s+'))), lambda w: regexp_matches(w, '^[A-Z]')))),
  lambda w: NOT list_contains({strings(L.STOP_SCORE)}, lower(w))) AS pn FROM sd),
sf AS (SELECT *, len(list_intersect(st, ct)) AS n_both, list_distinct(list_transform(list_filter(pn, lambda w: length(w) > 2), lambda w: lower(w))) AS heads,
  least(1.0::DOUBLE, len(list_filter(regexp_extract_all(s, '[a-zA-Z0-9]+'), lambda w: NOT list_contains({strings(L.STOP_SCORE)}, lower(w))))::DOUBLE / len(string_split_regex({strip('s')}, '\s+'))) AS cov FROM se),
sg AS (SELECT *, 0.5::DOUBLE * n_both / len(list_distinct(list_concat(st, ct))) + 0.5::DOUBLE * n_both / least(len(st), len(ct)) AS sim FROM sf),
sh AS (SELECT *, CASE WHEN len(pn) > 0 THEN len(list_filter(pn, lambda w: contains(lower(s), lower(w))))::DOUBLE / len(pn) ELSE sim END AS ent,
  CASE WHEN len(heads) > 0 THEN len(list_filter(heads, lambda w: contains(lower(s), w)))::DOUBLE / len(heads) ELSE sim END AS rel FROM sg),
si AS (SELECT *, {_denies('s')} <> {_denies('claim')} AND ent >= 0.5 AS flip FROM sh),
sj AS (SELECT *, CASE WHEN flip THEN 0.3::DOUBLE * sim ELSE least(1.0::DOUBLE, 0.5::DOUBLE * sim + 0.5::DOUBLE * rel) END AS sup, CASE WHEN flip THEN least(1.0::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * ent) ELSE greatest(0.0::DOUBLE, 0.1::DOUBLE * (1 - sim)) END AS con FROM si),
scores AS (SELECT claim_id, page_id, pos, s AS sentence, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE * ent + 0.3::DOUBLE * rel + 0.2::DOUBLE * cov + 0.1::DOUBLE * (CASE WHEN pos < 3 THEN 1.0 WHEN pos < 5 THEN 0.5 ELSE 0.1 END)::DOUBLE)) AS score,
  round(sup, 4) AS support, round(con, 4) AS contradiction, round(greatest(0.0::DOUBLE, 1 - (sup + con)), 4) AS neutral, round(sim, 4) AS sim, round(ent, 4) AS ent, round(cov, 4) AS cov FROM sj)"""


@query("W06_score_sentences", f"WITH {PAIRS}, {SCORED} SELECT * FROM scores")
def w06(spark, d):
    return E.score_rows(met(spark, d), "claim_id", "page_id")


_SELECTED = """ra AS (SELECT *, row_number() OVER w AS rk, max(score) OVER (PARTITION BY claim_id, page_id) AS top FROM scores WINDOW w AS (PARTITION BY claim_id, page_id ORDER BY score DESC, pos)),
rb AS (SELECT *, count(*) FILTER (score >= top * 0.8 AND score >= 0.35) OVER (PARTITION BY claim_id, page_id) AS n_good FROM ra),
rc AS (SELECT * FROM rb WHERE (n_good > 0 AND score >= top * 0.8 AND score >= 0.35 AND rk <= 3) OR (n_good = 0 AND rk = 1)),
sel AS (SELECT claim_id, page_id, string_agg(sentence, ' | ' ORDER BY rk) AS sentences, arg_min(sentence, rk) AS excerpt,
  round(greatest(0.45::DOUBLE, least(0.95::DOUBLE, 0.45::DOUBLE * arg_min(sim, rk) + 0.3::DOUBLE * arg_min(ent, rk) + 0.15::DOUBLE * arg_min(score, rk) + CASE WHEN arg_min(pos, rk) < 3 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END)) + 1e-12, 4) AS strength FROM rc GROUP BY claim_id, page_id)"""


@query("W07_select_sentences", f"WITH {PAIRS}, {SCORED}, {_SELECTED} SELECT * FROM sel")
def w07(spark, d):
    scored = met(spark, d).withColumn("scores", E.score_parts(F.col("parts"), F.col("about")))
    chosen = scored.select("claim_id", "page_id", E.select_sentences(F.col("scores"), F.col("doc")).alias("x"))
    return chosen.select("claim_id", "page_id", F.array_join("x.sentences", " | ").alias("sentences"), "x.excerpt", "x.strength")


@query("T28_best_excerpt", rf"""WITH {PAIRS}, x AS (SELECT claim_id, page_id, list_filter(list_transform(string_split(doc, '.'), lambda s: {strip('s')}), lambda s: length(s) > 10) AS ss, list_filter(string_split(lower(claim), ' '), lambda w: length(w) > 2) AS ws FROM pairs),
  y AS (SELECT claim_id, page_id, i, ss[i] AS s, len(list_filter(ws, lambda w: contains(lower(ss[i]), w))) AS hits FROM x, unnest(range(1, len(ss) + 1)) AS r(i))
  SELECT claim_id, page_id, arg_min(s, (-hits, i)) || '.' AS excerpt FROM y GROUP BY claim_id, page_id""")
def t28(spark, d):
    return pairs(spark, d).select("claim_id", "page_id", E.best_excerpt(F.col("doc"), F.array("claim")).alias("excerpt"))


_PRED = lambda x: f"list_filter({strings(L.PREDICATES)}, lambda p: contains(lower({x}), p))"
_VERDICT = "CASE WHEN pos = 0 THEN 'supported' WHEN pos = 1 THEN 'contradicted' ELSE 'insufficient' END"


@query("W14_claim_evidence_mapping", rf"""WITH {PROFILES}, pr AS (SELECT c.claim_id, c.pos, c.text AS claim, p.text AS doc FROM pcl c JOIN ppg p ON p.k = c.k AND p.n = 1),
  s AS (SELECT claim_id, pos, claim, list_filter(list_transform({SPLIT['mark']('doc')}, lambda s: {strip('s')}), lambda s: length(s) > 15) AS ss FROM pr),
  e AS (SELECT claim_id, pos, claim, i, ss[i] AS s, {sql_overlap_words('claim')} AS a, {sql_overlap_words('ss[i]')} AS b FROM s, unnest(range(1, len(ss) + 1)) AS r(i)),
  f AS (SELECT *, round(least(1.0::DOUBLE, {sql_jaccard('a', 'b')} + CASE WHEN len(list_filter({_PRED('claim')}, lambda p: contains(lower(s), p))) > 0 THEN 0.35 ELSE 0 END), 4) AS score FROM e),
  g AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, i) AS rk FROM f)
  SELECT claim_id, CASE {_VERDICT} WHEN 'supported' THEN 'supporting' WHEN 'contradicted' THEN 'contradicting' ELSE 'insufficient' END AS relation, string_agg(s, ' | ' ORDER BY rk) AS sentences,
    round(CASE WHEN pos = 0 THEN greatest(0.78, max(score)) ELSE max(score) END, 2)::DOUBLE AS strength FROM g WHERE rk <= 2 GROUP BY claim_id, pos""")
def w14(spark, d):
    ppl = people(spark, d)
    p = pages(ppl).where("n = 1").select("k", F.col("text").alias("passage"))
    c = claims(ppl).join(p, "k").withColumn("verdict", F.expr(_VERDICT))
    ranked = R.rank_sentences(c.select(F.col("claim_id").alias("id"), F.col("text").alias("claim"), "passage"))
    return V.evidence_mapping(c.select("claim_id", "verdict"), ranked).select("claim_id", "relation", F.array_join("sentences", " | ").alias("sentences"), "strength")


# --- ranking of pages --------------------------------------------------------------------------------------------
_W = lambda x: rf"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> ''))"
_DERIVED = " ".join(f"- CASE WHEN contains(lower(title), '{t}') AND NOT contains(lower(claim), '{t}') THEN 0.2::DOUBLE ELSE 0 END" for t in L.DERIVATIVE)


@query("W08_rank_evidence", rf"""WITH {PROFILES}, a AS (SELECT c.claim_id, p.page_id, c.text AS claim, p.title, p.text, regexp_extract_all(c.text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b') AS subj FROM pcl c JOIN ppg p USING (k)),
  b AS (SELECT *, regexp_matches(lower(title || ' ' || text), 'disambiguation|may refer to') AS dis FROM a), c AS (SELECT * FROM (SELECT *, bool_and(dis) OVER (PARTITION BY claim_id) AS all_dis FROM b) WHERE NOT dis OR all_dis),
  e AS (SELECT *, len(list_intersect({_W('claim')}, {_W('text')}))::DOUBLE / len(list_distinct(list_concat({_W('claim')}, {_W('text')}))) AS raw, list_transform(subj, lambda s: lower(s)) AS sl FROM c),
  f AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw + CASE WHEN list_contains(sl, lower(title)) OR (len(string_split(title, ' ')) > 1 AND contains(lower(claim), lower(title))) THEN 0.25::DOUBLE ELSE 0 END {_DERIVED})), 4) AS score FROM e),
  g AS (SELECT * FROM f WHERE score >= 0.1), h AS (SELECT *, max((score >= 0.6 AND list_contains(sl, lower(title)))::INT) OVER (PARTITION BY claim_id) AS canon FROM g),
  i AS (SELECT * FROM h WHERE canon = 0 OR score >= 0.2), j AS (SELECT *, row_number() OVER w AS rk, first_value(score) OVER w AS top FROM i WINDOW w AS (PARTITION BY claim_id ORDER BY score DESC, page_id))
  SELECT claim_id, page_id, rk AS rank, score FROM j WHERE top < 0.8 AND rk <= 3""")
def w08(spark, d):
    ppl = people(spark, d)
    c = claims(ppl).select("claim_id", F.col("text").alias("claim"), "k", V.distinct_words(F.col("text")).alias("cw"))
    p = pages(ppl).select("k", "page_id", "title", "text", V.distinct_words(F.col("text")).alias("tw"))  # words before they meet
    rows = c.join(p, "k").select("claim_id", "page_id", "claim", "title", "text", F.lit(None).cast("string").alias("url"), jaccard(F.col("cw"), F.col("tw")).alias("raw"))
    rows = rows.repartition(table(spark, d, "customer").count() // ROWS_OF_TASK + 1, "claim_id")  # tasks don't grow with the tables
    return V.rank_evidence(rows, 3, raw=F.col("raw")).select("claim_id", "page_id", "rank", "score")
