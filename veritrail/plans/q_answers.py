"""Queries of answers: claims, retrieval for them, decisions, denials, team profiles, corrections, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import synthesis as Y
from ..functions.text import jaccard, words
from ..operators import answers as A
from .profiles import PROFILES, answers, claims, pages, people
from .q_entities import _PLAIN
from .q_text import SPLIT, hit, q, sql_jaccard, sql_words, strip
from .registry import query

_P = rf"""ps AS (SELECT response_id, i AS ord_at, {strip('ss[i]')} AS s FROM (SELECT response_id, {SPLIT['mark'](strip('response'))} AS ss FROM pan), unnest(range(1, len(ss) + 1)) AS r(i)),
pf AS (SELECT response_id, ord_at, regexp_replace(s, '(?i)\b(?:actually|separate)\s+', '', 'g') AS s FROM ps WHERE len(string_split_regex(s, '\s+')) >= 3 AND NOT {hit('s', L.TALK)}),
pg AS (SELECT *, regexp_matches(s, '(?i)^It\s+') AS it, nullif(regexp_extract(s, {q(L.SUBJECT)}, 1), '') AS subj FROM pf),
ph AS (SELECT *, last_value(CASE WHEN NOT it THEN subj END IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY ord_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM pg),
pi AS (SELECT response_id, ord_at, CASE WHEN it THEN prev || s[3:] ELSE s END AS claim FROM ph WHERE NOT it OR prev IS NOT NULL),
split AS (SELECT * FROM (SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY ord_at) - 1 AS pos, claim FROM pi WHERE len(string_split_regex(claim, '\s+')) >= 3) WHERE pos < 5)"""


@query("T12_split_claims_external", f"WITH {PROFILES}, {_P} SELECT * FROM split")
def t12(spark, d):
    return A.split_claims(answers(people(spark, d)))


@query("W02_it_resolve", f"WITH {PROFILES}, {_P} SELECT response_id, prev AS subject, prev || s[3:] AS claim FROM ph WHERE it AND prev IS NOT NULL")
def w02(spark, d):
    return A.resolve_it(answers(people(spark, d))).where("referent IS NOT NULL").select("response_id", F.col("referent").alias("subject"), "claim")


# --- retrieval --------------------------------------------------------------------------------------------------
_SEM = sql_jaccard("wa", "wb")
_CAND = f"""cd AS (SELECT c.claim_id, c.response_id, c.pos, c.text AS claim, p.page_id AS doc_id, p.source, p.title, p.text, p.n, lower(p.title) = lower(c.person) AS exact, [c.person, c.company] AS names, c.person, {sql_words('c.text')} AS wa, {sql_words('p.text')} AS wb FROM pcl c JOIN ppg p USING (k)),
ce AS (SELECT *, {_SEM} AS semantic, {_PLAIN('text')} AS pt, {_PLAIN("title || ' ' || text")} AS ptt FROM cd),
cf AS (SELECT *, CASE WHEN contains(ptt, {_PLAIN('person')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS prim FROM ce WHERE (source <> 'FEVER' OR (semantic >= 0.55 AND contains(pt, {_PLAIN('person')}))) AND (exact OR contains(ptt, {_PLAIN('person')}) OR contains(ptt, {_PLAIN('names[2]')}))),
cg AS (SELECT *, 0.6::DOUBLE * semantic + 0.4::DOUBLE * prim + CASE WHEN exact THEN 1 ELSE 0 END AS score FROM cf),
ranked AS (SELECT * FROM (SELECT claim_id, doc_id, source, text, score, row_number() OVER (PARTITION BY claim_id ORDER BY CASE source WHEN 'Wikipedia' THEN 0 WHEN 'FEVER' THEN 1 ELSE 2 END, prim DESC, score DESC, doc_id) AS rank FROM cg) WHERE rank <= 5)"""


def candidates(spark, d):
    ppl = people(spark, d)
    j = claims(ppl).select("claim_id", "k", "person", "company", F.col("text").alias("claim")).join(pages(ppl).select("k", F.col("page_id").alias("doc_id"), "source", "title", "text"), "k")
    return j.withColumns({"semantic": jaccard(words(F.col("claim")), words(F.col("text"))), "exact": F.lower("title") == F.lower("person"), "names": F.array("person", "company")})


@query("J03_hybrid_retrieve", f"WITH {PROFILES}, {_CAND} SELECT claim_id, doc_id, score, rank FROM ranked")
def j03(spark, d):
    return A.hybrid_rank(candidates(spark, d)).select("claim_id", "doc_id", "score", "rank")


@query("J19_retrieve_for_claims", f"WITH {PROFILES}, {_CAND} SELECT c.claim_id, doc_id, rank, count(doc_id) OVER (PARTITION BY response_id) = 0 AS bare FROM pcl c LEFT JOIN ranked USING (claim_id)")
def j19(spark, d):
    c = claims(people(spark, d)).select("claim_id", "response_id")
    return A.retrieve_for_claims(c, A.hybrid_rank(candidates(spark, d)).drop("text", "source")).select("claim_id", "doc_id", "rank", "bare")


@query("J04_tiered_page_lookup", f"""WITH {PROFILES}, q AS (SELECT response_id AS id, k, CASE WHEN k % 3 = 0 THEN person WHEN k % 3 = 1 THEN split_part(company, ' ', 1) ELSE 'Zzyzx ' || k END AS term, CASE WHEN k % 3 = 1 THEN 'Which company is ' || split_part(company, ' ', 1) || '?' ELSE query END AS query FROM pan JOIN (SELECT k, company FROM ppl) USING (k)),
  pp AS (SELECT title, min(text) AS text FROM ppg WHERE n < 2 GROUP BY title), a AS (SELECT q.id, title, 0.98::DOUBLE AS similarity, 1 AS attempt, 'Passed' AS status FROM q JOIN pp ON lower(title) = lower(term)),
  l AS (SELECT * FROM q WHERE id NOT IN (SELECT id FROM a)), w AS (SELECT id, term, title, text, count(*) AS n FROM (SELECT id, term, unnest(list_distinct(list_filter(string_split(lower(term), ' '), lambda x: length(x) > 2))) AS w FROM l) JOIN (SELECT title, text, unnest(list_distinct(list_filter(string_split(lower(title), ' '), lambda x: length(x) > 2))) AS w FROM pp) USING (w) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, title) AS r FROM w), s AS (SELECT id, title, 2 AS attempt, 'Passed' AS status, CASE WHEN starts_with(lower(title), lower(term)) THEN 0.98 ELSE 0.85 END::DOUBLE AS similarity FROM t WHERE r <= 3),
  f AS (SELECT * FROM a UNION ALL SELECT id, title, similarity, attempt, status FROM s) SELECT * FROM f UNION ALL SELECT id, term, 0.2::DOUBLE, 1, 'Failed' FROM q WHERE id NOT IN (SELECT id FROM f)""")
def j04(spark, d):
    ppl = people(spark, d)
    asked, found = lookups(ppl)
    return A.tiered_lookup(asked, found).select("id", "title", "similarity", "attempt", "status")


def lookups(ppl):
    """Queries by person, by the beginning of a company's name and by a name without pages; pages by title."""
    first, k = F.split("company", " ")[0], F.col("k")
    term = F.when(k % 3 == 0, F.col("person")).when(k % 3 == 1, first).otherwise(F.concat(F.lit("Zzyzx "), "k"))
    text = F.when(k % 3 == 1, F.concat(F.lit("Which company is "), first, F.lit("?"))).otherwise(F.concat(F.lit("Who is "), "person", F.lit("?")))
    asked = ppl.select(F.concat(F.lit("P"), "k").alias("id"), text.alias("query"), term.alias("term"))
    return asked, pages(ppl).where("n < 2").groupBy("title").agg(F.min("text").alias("text"))


@query("V20_pipeline_trace", None)
def v20(spark, d):
    ppl = people(spark, d)
    asked, found = lookups(ppl)
    verdict = F.when(F.col("pos") == 0, "supported").when(F.col("pos") == 1, "contradicted").otherwise("insufficient")
    c = claims(ppl).select(F.col("response_id").alias("id"), verdict.alias("verdict"))
    return A.pipeline_traces(asked, A.tiered_lookup(asked, found), c)


# --- decisions --------------------------------------------------------------------------------------------------
_DOCS = """dk AS (SELECT c.claim_id, c.response_id, c.pos, c.text AS claim, c.pos = 3 AS sup, c.pos = 1 AND k % 3 = 0 AS con, p.source, p.text, CASE WHEN p.n = 2 AND c.k % 3 = 0 THEN 0.5 ELSE ((c.k * 3 + c.pos * 7 + p.n * 5) % 10) / 10.0 END::DOUBLE AS score, p.n AS rank
  FROM pcl c LEFT JOIN ppg p USING (k)),
dl AS (SELECT claim_id, response_id, pos, claim, coalesce(max(score), 0) AS top, coalesce(bool_or(score >= 0.35), false) AS near, coalesce(bool_or(score >= 0.35 AND source <> 'other'), false) AS trusted, any_value(sup) AS sup, any_value(con) AS con FROM dk GROUP BY ALL),
st AS (SELECT *, CASE WHEN trusted OR (sup AND near) THEN 'SUPPORTED' WHEN con AND near THEN 'CONTRADICTED' ELSE 'INSUFFICIENT_EVIDENCE' END AS state FROM dl),
nr AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS n FROM dk WHERE score >= 0.35),
kp AS (SELECT * FROM (SELECT st.response_id, st.claim, state, source, text, nr.score, st.pos, n, row_number() OVER (PARTITION BY st.response_id, source, lower(text) ORDER BY st.pos, n) AS seen FROM nr JOIN st USING (claim_id) WHERE n <= 2 AND state <> 'INSUFFICIENT_EVIDENCE') WHERE seen = 1),
ag AS (SELECT response_id, count(*) AS n_claims, count(*) FILTER (state = 'SUPPORTED') AS n_supported, count(*) FILTER (state = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (state = 'INSUFFICIENT_EVIDENCE') AS n_insufficient, round(avg(top), 4) AS mean_similarity FROM st GROUP BY response_id),
kq AS (SELECT response_id, count(*) FILTER (state = 'CONTRADICTED') AS kc, count(*) FILTER (state = 'SUPPORTED') AS ks, avg(score) AS quality, count(DISTINCT source) AS sources FROM kp GROUP BY response_id),
av AS (SELECT ag.*, coalesce(kc, 0) AS kept_contradictions, coalesce(ks, 0) AS kept_support, CASE WHEN coalesce(kc, 0) > 0 THEN 'yes' WHEN coalesce(ks, 0) > 0 THEN 'no' ELSE 'uncertain' END AS decision,
  round(coalesce(quality, 0) * (0.6::DOUBLE + 0.25::DOUBLE * ((n_supported + n_contradicted)::DOUBLE / n_claims) + 0.15::DOUBLE * least(1.0, coalesce(sources, 0) / 2.0)), 4) AS confidence FROM ag LEFT JOIN kq USING (response_id))"""


def documents_of_claims(spark, d):
    ppl = people(spark, d)
    p = pages(ppl).select("k", "n", "source", F.col("text").alias("doc"))
    k, n = F.col("k"), F.col("n")
    score = F.when((n == 2) & (k % 3 == 0), 0.5).otherwise(((k * 3 + F.col("pos") * 7 + n * 5) % 10) / 10.0)
    return claims(ppl).join(p, "k", "left").select(
        "claim_id", "response_id", "pos", F.col("text").alias("claim"), (F.col("pos") == 3).alias("said_supported"), ((F.col("pos") == 1) & (k % 3 == 0)).alias("said_contradicted"), "source", F.col("doc").alias("text"), score.alias("score"), n.alias("rank")
    )


@query("A03_aggregate_verdicts", f"WITH {PROFILES}, {_DOCS} SELECT * FROM av")
def a03(spark, d):
    return A.aggregate_verdicts(documents_of_claims(spark, d))


@query("A04_decision_score", f"WITH {PROFILES}, {_DOCS} SELECT response_id, decision, round(CASE decision WHEN 'yes' THEN n_contradicted::DOUBLE / n_claims WHEN 'no' THEN 0 ELSE 0.5 END, 4) AS probability, round(greatest(n_supported, CASE WHEN decision = 'yes' OR (decision = 'uncertain') THEN n_contradicted ELSE 0 END)::DOUBLE / n_claims, 4) AS confidence, CASE decision WHEN 'yes' THEN 'high' WHEN 'no' THEN 'low' ELSE 'uncertain' END AS label FROM av")
def a04(spark, d):
    return A.decision_scores(A.aggregate_verdicts(documents_of_claims(spark, d)))


_CONFLICT = lambda u, f: f"(contains(lower({u}), ' not ') <> contains(lower({f}), ' not '))"


@query("J17_user_claim_conflict", f"WITH {PROFILES}, x AS (SELECT c.claim_id, person || CASE WHEN k % 2 = 0 THEN ' is from Asia.' ELSE ' is not from Europe.' END AS u, c.text || CASE WHEN k % 3 = 0 THEN ' It is in Europe.' ELSE ' It is in Asia.' END AS f, k FROM pcl c) SELECT claim_id, {_CONFLICT('u', 'f')} OR (k % 2 = 0) = (k % 3 = 0) AS conflict FROM x")
def j17(spark, d):
    k = F.col("k")
    user = F.concat("person", F.when(k % 2 == 0, " is from Asia.").otherwise(" is not from Europe."))
    fact = F.concat("text", F.when(k % 3 == 0, " It is in Europe.").otherwise(" It is in Asia."))
    return claims(people(spark, d)).select("claim_id", A.user_claim_conflict(user, fact).alias("conflict"))


@query("V19_verified_answer", f"""WITH {PROFILES}, {_DOCS}, fa AS (SELECT response_id, string_agg(claim, ' ' ORDER BY pos) AS f FROM st WHERE state = 'SUPPORTED' GROUP BY response_id), dt AS (SELECT response_id, arg_min(text, (pos, n)) AS detail FROM kp WHERE state = 'CONTRADICTED' GROUP BY response_id)
  SELECT av.response_id, CASE WHEN decision = 'no' AND contains(f, ' not ') THEN 'The user''s claim is false. ' || f WHEN decision = 'no' THEN 'The user''s claim is supported by retrieved evidence. ' || f WHEN decision = 'yes' THEN 'The generated response is contradicted by evidence. ' || detail ELSE 'There is insufficient evidence to verify this claim.' END AS answer
  FROM av LEFT JOIN fa USING (response_id) LEFT JOIN dt USING (response_id)""")
def v19(spark, d):
    docs = documents_of_claims(spark, d)
    states = A.claim_states(docs)
    return A.verified_answers(answers(people(spark, d)), A.aggregate_verdicts(docs), states, A.retained_evidence(docs, states))


# --- denials ------------------------------------------------------------------------------------------------------
@query("J08_query_grounding", f"WITH {PROFILES} SELECT a.response_id AS id, CASE WHEN p.text IS NULL THEN '' ELSE a.person || ': ' || p.text[1:600] END AS context FROM pan a LEFT JOIN (SELECT title, arg_min(text, page_id) AS text FROM ppg WHERE n = 0 GROUP BY title) p ON p.title = a.person")
def j08(spark, d):
    ppl = people(spark, d)
    p = pages(ppl).where("n = 0").select(F.col("title").alias("name"), F.col("page_id").alias("rank"), "text")
    return A.knowledge_context(answers(ppl).select(F.col("response_id").alias("id"), "query"), p)


_SORT = "CASE WHEN k % 6 = 0 THEN 'denied' WHEN k % 5 = 0 THEN 'pronoun' WHEN k % 4 = 0 THEN 'other' ELSE 'told' END"


@query("W03_pronoun_affirmed", f"WITH {PROFILES} SELECT response_id, lower(CASE WHEN {_SORT} = 'told' THEN company ELSE person END) AS name FROM pan JOIN (SELECT k, company FROM ppl) USING (k) WHERE {_SORT} IN ('pronoun', 'told')")
def w03(spark, d):
    return A.pronoun_affirmed(answers(people(spark, d)))


@query("J10_denial_check", f"WITH {PROFILES} SELECT response_id, person AS name, 'The response claims to have no information about ' || person || ', despite verified reference evidence that ' || person || ' exists.' AS claim, 'contradicted' AS verdict, 0.9::DOUBLE AS confidence FROM pan WHERE ({_SORT} = 'denied' OR {_SORT} = 'other') AND k % 7 <> 0 AND k % 9 <> 0")
def j10(spark, d):
    a = answers(people(spark, d))
    grounded = a.where("k % 7 <> 0").select("response_id", F.col("person").alias("name"))
    affirmed = a.where("k % 9 = 0").select("response_id", F.concat("person", F.lit(" Junior")).alias("name"))
    return A.denial_check(a, grounded, affirmed)


@query("J11_fabricated_alternative", f"WITH {PROFILES} SELECT a.response_id, c.claim_id, {_SORT} = 'other' AND c.pos IN (0, 2) AS fabricated FROM pan a JOIN (SELECT claim_id, response_id, pos FROM pcl) c USING (response_id)")
def j11(spark, d):
    ppl = people(spark, d)
    names = F.when(F.col("pos") == 0, F.array(F.lit("Mira Novak"))).when(F.col("pos") == 1, F.array(F.upper("person"))).when(F.col("pos") == 2, F.array(F.lit("Nobody"))).otherwise(F.array().cast("array<string>"))
    c = claims(ppl).select("claim_id", "response_id", F.lit("insufficient").alias("verdict"), names.alias("names"))
    return A.fabricated_alternatives(answers(ppl).withColumn("query_names", F.array("person")), c)


@query("W04_reference_queries", f"WITH {PROFILES}, x AS (SELECT response_id AS id, [person] AS a FROM pan WHERE {_SORT} IN ('denied', 'pronoun') UNION ALL SELECT response_id, [person, 'Mira Novak'] FROM pan WHERE {_SORT} = 'other' UNION ALL SELECT a.response_id, [a.person, p.company, p.place] FROM pan a JOIN ppl p USING (k) WHERE {_SORT.replace('k %', 'a.k %')} = 'told') SELECT id, i - 1 AS pos, a[i] AS query FROM x, unnest(range(1, len(a) + 1)) AS r(i)")
def w04(spark, d):
    a = answers(people(spark, d))
    return A.reference_queries(a.select(F.col("response_id").alias("id"), F.col("response").alias("text")))


# --- teams and corrections ------------------------------------------------------------------------------------------
_SHARE = "len(list_intersect(list_filter(string_split(lower(former), ' '), lambda w: length(w) > 3), list_filter(string_split(lower(team), ' '), lambda w: length(w) > 3))) > 0"
_PROFILE = f"tp AS (SELECT k, CASE WHEN {_SHARE} THEN [] ELSE [lower(team)] END AS cur, [lower(former)] AS form FROM ppl WHERE k % 7 <> 0)"


def profiles_of(spark, d):
    p = pages(people(spark, d))
    return A.team_profiles(p.where("n = 0").select(F.col("k").alias("id"), F.col("n").alias("pos"), "text"))


@query("V09_team_profile", f"""WITH {PROFILES}, {_PROFILE}, v AS (SELECT c.claim_id, c.pos, c.k, array_to_string(cur, ';') AS cur, array_to_string(form, ';') AS form FROM pcl c JOIN tp USING (k))
  SELECT claim_id, cur AS current, form AS former, CASE WHEN pos = 2 AND k % 4 = 0 THEN 'contradicted' WHEN pos = 2 AND k % 5 <> 0 THEN 'supported' END AS verdict, CASE WHEN pos = 2 AND k % 4 = 0 THEN 0.92 WHEN pos = 2 AND k % 5 <> 0 THEN 0.95 END::DOUBLE AS confidence FROM v""")
def v09(spark, d):
    j = claims(people(spark, d)).join(profiles_of(spark, d).withColumnRenamed("id", "k"), "k")
    v = A.team_verdict(F.col("text"), *map(F.col, ["current", "former", "current_roles", "former_roles"]))
    listed = lambda c: F.array_join(c, ";").alias(c)
    return j.withColumn("v", v).select("claim_id", listed("current"), listed("former"), "v.*")


@query("V11_explicit_contradiction", f"WITH {PROFILES} SELECT c.claim_id, c.pos = 3 AND (c.k % 5 = 0 OR c.k % 7 = 0) AS contradicted FROM pcl c")
def v11(spark, d):
    text = F.concat("person", F.lit(" is a footballer. He lives abroad."))
    return claims(people(spark, d)).select("claim_id", R.explicit_contradiction(F.col("text"), F.array(text)).alias("contradicted"))


@query("V18_corrected_response", f"""WITH {PROFILES}, p AS (SELECT k, text, list_filter(list_transform(string_split(text, '.'), lambda s: {strip('s')}), lambda s: length(s) > 10) AS ss FROM ppg WHERE n = 1), c AS (SELECT k, max(CASE WHEN pos = 0 THEN text END) AS c0, max(CASE WHEN pos = 1 THEN text END) AS c1, string_agg(text, ' ' ORDER BY pos) AS c FROM pcl GROUP BY k)
  SELECT a.response_id, CASE WHEN a.k % 3 = 0 THEN a.response ELSE c0 || ' ' || CASE WHEN ss IS NOT NULL THEN 'Verified evidence indicates that ' || array_to_string(ss[1:2], '. ') || '.' ELSE 'Verified evidence indicates that assertion ''' || c1 || ''' is unsupported.' END END AS corrected FROM pan a JOIN c USING (k) LEFT JOIN p USING (k)""")
def v18(spark, d):
    ppl = people(spark, d)
    k, none = F.col("k"), F.array().cast("array<string>")
    by = claims(ppl).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    at = lambda i: F.array(F.get("c", F.lit(i))["text"])
    rows = answers(ppl).join(by, "k").join(pages(ppl).where("n = 1").select("k", F.col("text").alias("page")), "k", "left")
    return A.corrected_responses(rows.select("response_id", "query", "response", "page", F.when(k % 3 == 0, F.lit(1)).otherwise(2).alias("n_claims"), at(0).alias("supported"), F.when(k % 3 == 0, none).otherwise(at(1)).alias("contradicted")))


_FULL = lambda c: f"CASE WHEN {c} = 'Barcelona' THEN 'FC Barcelona' ELSE {c} END"


@query("V17_merge_supported_claims", f"""WITH {PROFILES} SELECT response_id, person || CASE WHEN k % 4 = 0 THEN ' who plays for ' || {_FULL('former')} || ' and The CEO of ' || company || ' is ' || person WHEN k % 5 = 0 THEN ' is the CEO of ' || company || ' and is not a singer' ELSE ' is the CEO of ' || company || ' who plays for ' || {_FULL('team')} END || '.' AS merged FROM pan JOIN (SELECT k, company, team, former FROM ppl) USING (k)""")
def v17(spark, d):
    c = claims(people(spark, d)).where("pos IN (0, 2)").groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"))
    return c.select("response_id", Y.merged_claims(F.transform("c", lambda x: x["text"])).alias("merged"))
