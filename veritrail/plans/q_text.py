"""Queries of text preparation, claims, verification and scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import rules as R
from ..functions import text as T
from ..operators import scoring as S
from .profiles import CASES, cases
from .registry import query, table
from .views import QA, TEMPLATED, qa_pairs, templated

# --- SQL forms of the column functions -------------------------------------------------------------------------
q = lambda p: "'" + p.replace("'", "''") + "'"
strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
hit = lambda x, p: f"regexp_matches({x}, {q('(?i)' + p)})"
#: Word borders of RE2 know ASCII letters only, so others are put as x.
ascii_letters = lambda x: rf"regexp_replace({x}, '[^\x00-\x7F]', 'x', 'g')"
strings = lambda xs: "[" + ", ".join(q(x) for x in xs) + "]"
SPLIT = {
    "capital": lambda x: rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))",
    "mark": lambda x: rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))",
    "drop_mark": lambda x: rf"string_split_regex({x}, '[.!?]\s+')",
    "dot": lambda x: rf"string_split({x}, '.')",
    "clause": lambda x: rf"string_split_regex(regexp_replace({x}, '([.!?;])\s+', '\1' || chr(1), 'g'), '\x01|\n+')",
}
sql_sentences = lambda x, kind, n: f"list_filter(list_transform({SPLIT[kind](x)}, lambda s: {strip('s')}), lambda s: length(s) > {n})"
sql_words = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"
sql_except = lambda a, xs: f"list_filter({a}, lambda w: NOT list_contains({strings(xs)}, w))"
sql_overlap_words = lambda x: sql_except(f"list_filter({sql_words(x)}, lambda w: length(w) > 2)", L.STOP_OVERLAP)
sql_jaccard = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"
sql_content = lambda x: sql_except(f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))", L.STOP_CLAIM)
sql_normalized = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
sql_factual = lambda x: (
    rf"(length({strip(x)}) >= 8 AND NOT {hit(strip(x), L.REDUNDANT)} AND (len(string_split_regex({strip(x)}, '\s+')) >= 3 OR {hit(strip(x), L.COMMON_VERB)}) AND NOT {hit(strip(x), '(' + '|'.join(L.NON_FACTUAL) + ')')})"
)


@query("T01_split_sentences", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {sql_sentences('text', k, n)} AS ss FROM documents" for k, n in (("capital", 0), ("mark", 15), ("drop_mark", 0), ("dot", 10), ("clause", 0))) + ") SELECT doc_id, kind, i - 1 AS pos, md5(ss[i]) AS digest FROM s, unnest(range(1, len(ss) + 1)) AS r(i)")
def t01(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), T.sentences(F.col("text"), k, n).alias("ss")) for k, n in (("capital", 0), ("mark", 15), ("drop_mark", 0), ("dot", 10), ("clause", 0))])
    return docs.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.kind", F.posexplode("x.ss").alias("pos", "s")).select("doc_id", "kind", "pos", F.md5("s").alias("digest"))


_LETTERS = "list_distinct(regexp_extract_all(lower(s), '[a-z]+'))"


@query("T02_clean_evidence_sentences", rf"""WITH c AS (SELECT page_id, list_transform({SPLIT['mark'](strip(r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '(?i)\[\d+\]|\[citation needed\]|\[edit\]', '', 'g')"))}, lambda s: {strip('s')}) AS ss FROM pages),
  g AS (SELECT page_id, ss, list_filter(ss, lambda s: length(s) >= 20 AND s NOT LIKE '==%' AND s NOT LIKE '—%' AND (len(list_intersect({_LETTERS}, {strings(L.ACTION_VERBS)})) > 0 OR len({_LETTERS}) >= 6)) AS good FROM c),
  o AS (SELECT page_id, CASE WHEN len(good) > 0 THEN good ELSE list_filter(ss, lambda s: length(s) >= 15) END AS ss FROM g) SELECT page_id, i - 1 AS pos, md5(ss[i]) AS digest FROM o, unnest(range(1, len(ss) + 1)) AS r(i)""")
def t02(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.posexplode(T.clean_evidence_sentences(T.strip_html(F.col("html")))).alias("pos", "s")).select("page_id", "pos", F.md5("s").alias("digest"))


@query("T03_normalize_text", rf"""SELECT doc_id, md5({sql_normalized('text')}) AS plain, md5(trim(regexp_replace(regexp_replace(lower(text), '\[\d+\]|\[citation needed\]|https?://\S+', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS evidence_form,
  md5(lower(translate(text, '{T._ACCENTED}', '{T._PLAIN}'))) AS folded FROM documents""")
def t03(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalized(c)).alias("plain"), F.md5(T.evidence_key(c)).alias("evidence_form"), F.md5(T.folded(c)).alias("folded"))


@query("T04_tokenize", f"WITH {QA} SELECT response_id, len({sql_words('response')}) AS n_words, len({sql_content('response')}) AS n_content, len({sql_overlap_words('response')}) AS n_overlap FROM qa")
def t04(spark, d):
    c = F.col("response")
    return qa_pairs(spark, d).select("response_id", F.size(T.words(c)).alias("n_words"), F.size(T.content_words(c)).alias("n_content"), F.size(T.overlap_words(c)).alias("n_overlap"))


@query("T05_word_overlap", f"WITH {QA}, w AS (SELECT response_id, {sql_overlap_words('query')} AS a, {sql_overlap_words('response')} AS b FROM qa) SELECT response_id, {sql_jaccard('a', 'b')} AS jaccard, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) ELSE 0 END AS coefficient, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END AS one_sided FROM w")
def t05(spark, d):
    w = qa_pairs(spark, d).select("response_id", T.overlap_words(F.col("query")).alias("a"), T.overlap_words(F.col("response")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return w.select("response_id", T.jaccard(a, b).alias("jaccard"), T.overlap_coefficient(a, b).alias("coefficient"), T.one_sided(a, b).alias("one_sided"))


#: Lead-ins put before the sentences of answers, so that the rules have something to work on; none for the rest.
LEADS = ["I'm not aware of any information suggesting ", "I don't think that ", "There is no evidence suggesting ", "", "", ""]
_LEAD = f"{strings(LEADS)}[(i - 1) % {len(LEADS)} + 1]"
_SENT = f"sent AS (SELECT response_id, i - 1 AS pos, {_LEAD} || ss[i] AS s FROM (SELECT response_id, {SPLIT['capital'](strip('response'))} AS ss FROM qa), unnest(range(1, len(ss) + 1)) AS r(i))"


def _sentences(spark, d):
    c = qa_pairs(spark, d).select("response_id", F.posexplode(F.split(T.strip(F.col("response")), r"(?<=[.!?])\s+(?=[A-Z0-9])")).alias("pos", "s"))
    lead = F.element_at(F.array(*map(F.lit, LEADS)), F.col("pos") % len(LEADS) + 1)
    return c.select("response_id", "pos", F.concat(lead, "s").alias("s"))


_PFX = f"regexp_extract({strip('s')}, {q('(?i)' + L.LEAD_IN)}, 0)"
_NORM = rf"""norm AS (SELECT response_id, pos, CASE WHEN p = '' OR r = '' THEN t ELSE upper(x[1]) || x[2:] END AS s FROM (SELECT *, CASE WHEN NOT regexp_matches(lower(p), 'not|no|couldn''t|cannot') THEN r
  WHEN contains(lower(r), 'has ever ') THEN regexp_replace(r, '(?i)\bhas\s+ever\b', 'has never', 'g') WHEN NOT {hit('r', r'\b(not|never|no)\b')} THEN 'No evidence indicates that ' || lower(r[1]) || r[2:] ELSE r END AS x
  FROM (SELECT *, {strip("t[length(p) + 1:]")} AS r FROM (SELECT response_id, pos, {strip('s')} AS t, {_PFX} AS p FROM sent))))"""


@query("T06_normalize_claim", f"WITH {QA}, {_SENT}, {_NORM} SELECT response_id, pos, s AS claim FROM norm")
def t06(spark, d):
    return _sentences(spark, d).select("response_id", "pos", T.normalize_claim(F.col("s")).alias("claim"))


@query("T07_decompose_claims", f"""WITH {TEMPLATED}, c AS (SELECT claim_id, pos, split_part(text, ' is ', 1) AS a, split_part(text, ' was created in ', 1) AS b, text, kind FROM claims),
  x AS (SELECT claim_id, CASE WHEN kind = 'location' THEN a || ' is a depot.' ELSE b || ' is a shipment.' END AS c1, CASE WHEN kind = 'location' THEN a ELSE 'Order' END || ' was formed by ACME.' AS c2,
  CASE WHEN kind = 'location' THEN a ELSE 'Order' END || ' was formed in 2013.' AS c3 FROM c)
  SELECT claim_id, i - 1 AS pos, [c1, c2, c3][i] AS claim FROM x, unnest([1, 2, 3]) AS r(i)""")
def t07(spark, d):
    claims, _ = templated(spark, d)
    who = F.when(F.col("kind") == "location", F.split("text", " is ")[0]).otherwise(F.split("text", " was created in ")[0])
    made = F.concat(who, F.when(F.col("kind") == "location", " is a depot").otherwise(" is a shipment"), F.lit(" formed by ACME in 2013."))
    return claims.select("claim_id", F.posexplode(T.decompose_claims(made)).alias("pos", "claim"))


@query("T08_filter_factual", f"WITH {QA}, {_SENT} SELECT response_id, pos, {sql_factual('s')} AS factual FROM sent")
def t08(spark, d):
    return _sentences(spark, d).select("response_id", "pos", T.is_factual(F.col("s")).alias("factual"))


#: Answers hold none of the compound patterns, so each sentence is one claim.
_CLAIMS = f"claim AS (SELECT response_id, row_number() OVER (PARTITION BY response_id ORDER BY pos) - 1 AS pos, s AS claim FROM (SELECT response_id, i - 1 AS pos, {strip('ss[i]')} AS s FROM (SELECT response_id, {SPLIT['capital'](strip('response'))} AS ss FROM qa), unnest(range(1, len(ss) + 1)) AS r(i)) WHERE {sql_factual('s')})"


def claims_of(spark, d):
    return qa_pairs(spark, d).select("response_id", F.posexplode(T.extract_claims(F.col("response"))).alias("pos", "claim"))


@query("T09_extract_claims", f"WITH {QA}, {_CLAIMS} SELECT response_id, pos, claim FROM claim")
def t09(spark, d):
    return claims_of(spark, d)


@query("T10_grounded_filter", f"WITH {QA}, {_CLAIMS}, w AS (SELECT response_id, pos, {sql_content('claim')} AS c, {sql_content('query')} AS s FROM claim JOIN qa USING (response_id)), m AS (SELECT *, len(list_filter(c, lambda x: NOT list_contains(s, x))) AS missing FROM w) SELECT response_id, pos, len(c) > 0 AND (missing < 2 OR missing::DOUBLE / len(c) <= 0.3) AS grounded FROM m")
def t10(spark, d):
    c = claims_of(spark, d).join(qa_pairs(spark, d).select("response_id", "query"), "response_id")
    return c.select("response_id", "pos", T.is_grounded(F.col("claim"), F.col("query")).alias("grounded"))


_TYPE = f"CASE WHEN {strip('s')} = '' THEN 'conversational_meta' WHEN {hit(strip('s'), L.ASSISTANT_STATE)} THEN 'assistant_internal_state' WHEN {hit(strip('s'), L.CONVERSATIONAL)} THEN 'conversational_meta' WHEN {hit(strip('s'), L.NEGATIVE_FACT)} THEN 'objective_negative_fact' WHEN {hit(strip('s'), L.UNCERTAIN)} THEN 'uncertain_fact' ELSE 'objective_fact' END"


@query("T11_classify_claim_type", f"WITH {QA}, {_SENT} SELECT response_id, pos, {_TYPE} AS claim_type FROM sent")
def t11(spark, d):
    return _sentences(spark, d).select("response_id", "pos", T.claim_type(F.col("s")).alias("claim_type"))


@query("T14_span_coverage", f"""WITH {QA}, {_CLAIMS}, t AS (SELECT response_id, lower({strip('response')}) AS src FROM qa), b AS (SELECT response_id, length(src) AS n, instr(src, lower({strip('claim')})[1:30]) AS st, length({strip('claim')}) AS k FROM claim JOIN t USING (response_id)),
  e AS (SELECT response_id, n, st, least(n + 1, st + k) AS en FROM b WHERE st > 0), m AS (SELECT *, max(en) OVER (PARTITION BY response_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e)
  SELECT qa.response_id, round(coalesce(sum(greatest(0, en - greatest(st, coalesce(pe, 0))))::DOUBLE / max(n), 0), 4) AS coverage FROM qa LEFT JOIN m USING (response_id) GROUP BY qa.response_id""")
def t14(spark, d):
    return S.span_coverage(qa_pairs(spark, d).select("response_id", F.col("response").alias("text")), claims_of(spark, d))


@query("T18_extract_relation", f"WITH {TEMPLATED} SELECT claim_id, CASE WHEN kind = 'location' THEN 'headquarters_of' END AS relation, CASE WHEN kind = 'location' THEN split_part(text, ' is located in ', 1) END AS subject, CASE WHEN kind = 'location' THEN rtrim(split_part(text, ' is located in ', 2), '.') END AS object FROM claims")
def t18(spark, d):
    claims, _ = templated(spark, d)
    return claims.select("claim_id", T.relation(F.col("text")).alias("r")).select("claim_id", "r.*")


_IMP = rf"greatest(0.15, least(1.0, 0.40 * least(1.0, ((pos % 4)::DOUBLE) / 3) + 0.35 * least(1.0, 0.5 + 0.3 * regexp_matches(s, '\d')::INT + 0.2 * {hit(ascii_letters('s'), L.COMMON_VERB)}::INT) + 0.25 * least(1.0, len(string_split_regex({strip('s')}, '\s+'))::DOUBLE / 12)))"


@query("T26_claim_importance", f"WITH {QA}, {_SENT} SELECT response_id, pos, {_IMP} AS importance FROM sent")
def t26(spark, d):
    return _sentences(spark, d).select("response_id", "pos", T.claim_importance(F.col("pos") % 4, F.col("s")).alias("importance"))


@query("T27_stratum_key", rf"""WITH x AS (SELECT doc_id, source, quality, text, len(string_split_regex({strip('text')}, '\s+')) AS n FROM documents JOIN labels USING (doc_id))
  SELECT doc_id, concat_ws('|', source, quality::VARCHAR, CASE WHEN n < 20 THEN 'short' WHEN n <= 60 THEN 'medium' ELSE 'long' END, CASE WHEN regexp_matches(text, '\b(19|20)\d\d\b') THEN 'temporal' WHEN regexp_matches(text, '\d') THEN 'numeric' WHEN regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+') THEN 'entity' ELSE 'attribution' END) AS stratum FROM x""")
def t27(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.select("doc_id", T.stratum(F.col("source"), F.col("quality"), F.col("text")).alias("stratum"))


_LEVEL = "CASE WHEN 1 - c <= 0.10 THEN 'very_low' WHEN 1 - c <= 0.25 THEN 'low' WHEN 1 - c <= 0.50 THEN 'moderate' WHEN 1 - c <= 0.75 THEN 'high' ELSE 'very_high' END"


@query("T29_levels", f"SELECT o_orderkey AS id, {_LEVEL} AS uncertainty, CASE WHEN c > 0.85 THEN 'critical' WHEN c >= 0.60 THEN 'high' WHEN c >= 0.30 THEN 'moderate' ELSE 'low' END AS severity FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS c FROM orders)")
def t29(spark, d):
    c = (F.col("o_orderkey") % 1000) / 1000.0
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.uncertainty_level(c).alias("uncertainty"), T.severity(c).alias("severity"))


@query("T30_strip_html", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def t30(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest"))


@query("T31_derive_input_type", "SELECT page_id, CASE WHEN t <> '' AND i <> '' THEN 'text_image' WHEN i <> '' THEN 'image' ELSE 'text' END AS input_type FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS t, CASE WHEN page_id % 2 = 0 THEN '' ELSE url END AS i FROM pages)")
def t31(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.input_type(F.when(F.col("page_id") % 3 != 0, F.col("url")), F.when(F.col("page_id") % 2 != 0, F.col("url"))).alias("input_type"))


# --- verification of the templated claims -------------------------------------------------------------------------
def with_evidence(spark, d):
    """Claims with the texts of their valid evidence, in order."""
    claims, evidence = templated(spark, d)
    per = S.valid_evidence(evidence).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("texts"), F.avg("score").alias("mean_score"))
    return claims.join(per, "claim_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


_EV = """ev AS (SELECT * FROM (SELECT *, max((score >= 0.15)::INT) OVER (PARTITION BY claim_id) AS any_good FROM evidence) WHERE score >= 0.15 OR any_good = 0),
ce AS (SELECT c.*, coalesce(e.texts, []) AS texts, mean_score FROM claims c LEFT JOIN (SELECT claim_id, list(text ORDER BY pos) AS texts, avg(score) AS mean_score FROM ev GROUP BY claim_id) e USING (claim_id))"""


@query("F05_valid_evidence", f"WITH {TEMPLATED}, {_EV} SELECT claim_id, pos, text FROM ev")
def f05(spark, d):
    return S.valid_evidence(templated(spark, d)[1]).select("claim_id", "pos", "text")


_YRS = lambda x: rf"regexp_extract_all({x}, '\b(?:19|20)\d\d\b')"


@query("V01_temporal_check", rf"""WITH {TEMPLATED}, {_EV}, y AS (SELECT claim_id, {_YRS('text')} AS cy, regexp_extract_all(array_to_string(list_transform(list_filter(texts, lambda e: regexp_matches(lower(e), 'created\s+(?:in\s+)?(?:19|20)\d\d')), lambda e: lower(e))[1:1], ' '), 'created\s+(?:in\s+)?((?:19|20)\d\d)', 1) AS py FROM ce WHERE kind = 'temporal')
  SELECT claim_id, CASE WHEN len(py) = 0 THEN NULL WHEN len(list_intersect(cy, py)) > 0 THEN 'supported' ELSE 'contradicted' END AS verdict, CASE WHEN len(py) = 0 THEN NULL WHEN len(list_intersect(cy, py)) > 0 THEN 0.95 ELSE 0.94 END::DOUBLE AS confidence FROM y""")
def v01(spark, d):
    c = with_evidence(spark, d).where("kind = 'temporal'")
    return c.select("claim_id", R.temporal(F.col("text"), F.col("texts")).alias("v")).select("claim_id", "v.*")


_NUM = lambda x: rf"list_filter(list_distinct(regexp_extract_all({x}, '\b\d+(?:\.\d+)?\b')), lambda n: NOT regexp_matches(n, '^(19|20)\d\d$'))"


@query("V02_numeric_check", rf"""WITH {TEMPLATED}, {_EV}, n AS (SELECT claim_id, text, {_NUM('text')} AS cn, list_filter(list_transform(texts, lambda e: {_NUM('e')}), lambda l: len(l) > 0)[1] AS en FROM ce),
  x AS (SELECT *, len(list_filter(cn, lambda a: len(list_filter(en, lambda b: a::DOUBLE > 0 AND b::DOUBLE > 0 AND abs(a::DOUBLE - b::DOUBLE) / greatest(a::DOUBLE, b::DOUBLE) <= 0.03)) > 0)) > 0 AS near FROM n)
  SELECT claim_id, CASE WHEN en IS NULL OR NOT regexp_matches(text, '\b\d+(\.\d+)?\b') THEN NULL WHEN len(list_intersect(cn, en)) > 0 OR near THEN 'supported' ELSE 'contradicted' END AS verdict,
  CASE WHEN en IS NULL OR NOT regexp_matches(text, '\b\d+(\.\d+)?\b') THEN NULL WHEN len(list_intersect(cn, en)) > 0 THEN 0.95 ELSE 0.94 END::DOUBLE AS confidence FROM x""")
def v02(spark, d):
    return with_evidence(spark, d).select("claim_id", R.numeric(F.col("text"), F.col("texts")).alias("v")).select("claim_id", "v.*")


@query("V04_location_check", f"""WITH {TEMPLATED}, {_EV}, n AS (SELECT list(lower(n_name)) AS names FROM nation), x AS (SELECT claim_id, list_filter(names, lambda n: regexp_matches(lower(text), '\\b' || n || '\\b')) AS a, list_filter(names, lambda n: regexp_matches(lower(array_to_string(texts, ' ')), '\\b' || n || '\\b')) AS b FROM ce, n WHERE kind = 'location')
  SELECT claim_id, CASE WHEN len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 THEN 'contradicted' END AS verdict, CASE WHEN len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) = 0 THEN 0.96 END::DOUBLE AS confidence FROM x""")
def v04(spark, d):
    names = {r.n_name.lower(): r.n_name.lower() for r in table(spark, d, "nation").collect()}  # 25 names
    c = with_evidence(spark, d).where("kind = 'location'")
    return c.select("claim_id", R.location(F.col("text"), F.col("texts"), places=names).alias("v")).select("claim_id", "v.*")


_ENT = rf"""en AS (SELECT ce.*, string_split(n, ' ') AS cw, list_transform(list_transform(flatten(list_transform(texts, lambda e: string_split_regex(e, '[.!?]\s+'))), lambda s: {strip('s')}), lambda s: {sql_normalized('s')}) AS ss, n FROM (SELECT *, {sql_normalized('text')} AS n FROM ce) ce),
ent AS (SELECT *, length(n) >= 8 AND len(list_filter(ss, lambda s: s <> '' AND (contains(s, n) OR (len(list_distinct(cw)) >= 3 AND len(list_intersect(list_distinct(cw), string_split(s, ' ')))::DOUBLE / len(list_distinct(cw)) >= 0.75)))) > 0 AS entails FROM en),
syn AS (SELECT *, len(list_filter(texts, lambda e: len(list_intersect({sql_words('text')}, {sql_words('e')}))::DOUBLE / greatest(1, len({sql_words('text')})) >= 0.65)) > 0 AS equal_words FROM ent)"""


@query("V12_direct_entailment", f"WITH {TEMPLATED}, {_EV}, {_ENT} SELECT claim_id, entails FROM ent")
def v12(spark, d):
    return with_evidence(spark, d).select("claim_id", R.direct_entailment(F.col("text"), F.col("texts")).alias("entails"))


@query("V13_synonym_equivalence", f"WITH {TEMPLATED}, {_EV}, {_ENT} SELECT claim_id, equal_words FROM syn")
def v13(spark, d):
    return with_evidence(spark, d).select("claim_id", R.synonym_equivalence(F.col("text"), F.col("texts")).alias("equal_words"))


_VER = "ver AS (SELECT *, CASE WHEN len(texts) = 0 THEN 'insufficient' WHEN entails OR equal_words THEN 'supported' ELSE 'insufficient' END AS verdict, CASE WHEN len(texts) = 0 THEN 0.30 WHEN entails THEN 0.95 WHEN equal_words THEN 0.90 ELSE 0.30 END::DOUBLE AS confidence FROM syn)"


def verified(spark, d):
    c = with_evidence(spark, d).withColumn("v", R.verify(F.col("text"), F.col("texts")))
    return c.select("claim_id", "response_id", "pos", "text", "kind", "truth", "mean_score", "v.*")


@query("V08_verify_claims", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER} SELECT claim_id, verdict, confidence FROM ver")
def v08(spark, d):
    return verified(spark, d).select("claim_id", "verdict", "confidence")


@query("V07_run_checkers")
def v07(spark, d):
    return with_evidence(spark, d).select("claim_id", R.run_checkers(F.col("text"), F.col("texts")).alias("v")).select("claim_id", "v.*")


_JOINED = "lower(array_to_string(texts, ' '))"
_FOUND = lambda x, terms: rf"list_filter({strings(terms)}, lambda t: regexp_matches({x}, '\b' || t || '\b'))"
_DISJOINT = lambda a, b: f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"
_WHEN = lambda cond, name, conf: f"CASE WHEN {cond} THEN '{name}' END AS verdict, CASE WHEN {cond} THEN {conf} END::DOUBLE AS confidence"


def _ruled(spark, d, rule):
    return cases(spark, d).select("claim_id", rule(F.col("text"), F.col("texts")).alias("v")).select("claim_id", "v.*")


@query("V03_entity_check", f"WITH {CASES}, x AS (SELECT claim_id, text, {_FOUND('lower(text)', L.COMPANIES)} AS ca, {_FOUND(_JOINED, L.COMPANIES)} AS cb, {_FOUND('lower(text)', L.PERSONS)} AS pa, {_FOUND(_JOINED, L.PERSONS)} AS pb FROM cases), "
       f"y AS (SELECT claim_id, {hit('text', '|'.join(R._ENTITY_WORDS))} AND ({_DISJOINT('ca', 'cb')} OR {_DISJOINT('pa', 'pb')}) AS clash FROM x) SELECT claim_id, {_WHEN('clash', 'contradicted', 0.96)} FROM y")
def v03(spark, d):
    return _ruled(spark, d, R.entity)


_ODDITIES = r"""(contains(c, 'absorb') AND contains(c, 'photosynthesis') AND contains(c, 'oxygen') AND contains(e, 'carbon dioxide'))
  OR ((contains(c, 'currency') OR contains(c, 'euro') OR contains(c, 'pound')) AND (contains(c, 'united kingdom') OR regexp_matches(c, '\buk\b')) AND contains(c, 'euro') AND (contains(e, 'pound') OR contains(e, 'sterling')))
  OR (contains(c, 'largest organ') AND contains(c, 'heart') AND contains(e, 'skin')) OR (contains(c, 'smallest prime') AND regexp_matches(c, '\b1\b') AND contains(e, '2'))
  OR (contains(c, 'visible') AND contains(c, 'moon') AND (contains(c, 'naked eye') OR contains(c, 'is visible')) AND (contains(e, 'not visible') OR contains(e, 'myth') OR contains(e, 'cannot be seen')))"""


@query("V05_attribute_check", f"WITH {CASES}, x AS (SELECT claim_id, regexp_matches(c, 'absorb|currency|largest organ|prime number|visible from the moon|visible from space') AND ({_ODDITIES}) AS wrong FROM (SELECT claim_id, lower(text) AS c, {_JOINED} AS e FROM cases)) SELECT claim_id, {_WHEN('wrong', 'contradicted', 0.96)} FROM x")
def v05(spark, d):
    return _ruled(spark, d, R.attribute)


@query("V06_negation_check", rf"""WITH {CASES}, x AS (SELECT claim_id, regexp_matches(c, '\b(not|never)\b') AND NOT regexp_matches(e, '\b(not|never|no)\b') AND len(list_filter(string_split_regex(c, '\s+'), lambda w: length(w) > 3 AND w <> 'never' AND contains(e, w))) > 0 AS fine
  FROM (SELECT claim_id, lower(text) AS c, {_JOINED} AS e FROM cases)) SELECT claim_id, {_WHEN('fine', 'supported', '0.90')} FROM x""")
def v06(spark, d):
    return _ruled(spark, d, R.negation)


_ANY = lambda pattern: f"len(list_filter(texts, lambda e: regexp_matches(lower(e), {q(pattern)}))) > 0"
_OTHERS = lambda group, k: [x for j, o in enumerate(group) if j != k for x in o]
_BORNE = " OR ".join(
    [f"(list_has_any(w, {strings(g)}) AND {_ANY('|'.join(L.BIOGRAPHY))} AND NOT {_ANY('|'.join(g))})" for g in L.DOMAINS]
    + [rf"(regexp_matches(c, {q(chr(92) + 'b(' + '|'.join(g) + ')' + chr(92) + 'b')}) AND {_ANY(chr(92) + 'b(' + '|'.join(_OTHERS(L.NATIONALITIES, k)) + ')' + chr(92) + 'b')})" for k, g in enumerate(L.NATIONALITIES)]
)
_CONFLICT = " OR ".join(
    [r"(regexp_matches(s, '\b(is not a|was not a|never played|did not play|false that)\b') AND list_has_any(own, list_filter(sw, lambda w: length(w) > 4)))"]
    + [f"(list_has_any(own, {strings(g)}) AND list_has_any(sw, {strings(_OTHERS(group, k))}) AND list_has_any(own, sw))" for group in (L.DOMAINS, L.NATIONALITIES) for k, g in enumerate(group)]
)


@query("V10_negative_support", rf"""WITH {CASES}, b AS (SELECT claim_id, text, texts, lower(text) AS c, string_split_regex(lower(text), '\s+') AS w FROM cases), n AS (SELECT claim_id, regexp_matches(c, '\b(never|not|no|couldn''?t\s+find)\b') AND ({_BORNE}) AS denied_well FROM b),
  s AS (SELECT claim_id, own, s, string_split(s, ' ') AS sw FROM (SELECT claim_id, list_distinct(string_split({sql_normalized('text')}, ' ')) AS own, unnest(list_transform(list_filter(list_transform(flatten(list_transform(texts, lambda e: string_split_regex(e, '[.!?]\s+'))), lambda s: {strip('s')}), lambda s: s <> ''), lambda s: {sql_normalized('s')})) AS s FROM b)),
  k AS (SELECT claim_id, bool_or({_CONFLICT}) AS contradicted FROM s GROUP BY claim_id) SELECT claim_id, denied_well, coalesce(contradicted, false) AS contradicted FROM n LEFT JOIN k USING (claim_id)""")
def v10(spark, d):
    c = cases(spark, d)
    return c.select("claim_id", R.negative_support(F.col("text"), F.col("texts")).alias("denied_well"), R.explicit_contradiction(F.col("text"), F.col("texts")).alias("contradicted"))


@query("V07_run_checkers_of_cases")
def v07_cases(spark, d):
    """All rules over cases that each of them decides some of."""
    return cases(spark, d).select("claim_id", R.run_checkers(F.col("text"), F.col("texts")).alias("v")).select("claim_id", "v.*")


@query("V15_fallback_confidence", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER} SELECT claim_id, round(least(0.95, CASE WHEN verdict = 'supported' THEN 0.55 + 0.4 * coalesce(mean_score, 0.5) ELSE 0.30 + 0.2 * coalesce(mean_score, 0.5) END), 2) AS fallback FROM ver")
def v15(spark, d):
    return verified(spark, d).select("claim_id", R.fallback_confidence(F.col("verdict"), F.col("mean_score")).alias("fallback"))


_A01 = """sc AS (SELECT response_id, avg(CASE verdict WHEN 'supported' THEN 0 WHEN 'contradicted' THEN 1 ELSE 0.5 END) AS sco, avg(confidence) AS con, bool_and(verdict = 'supported') AS fine FROM ver GROUP BY response_id),
a01 AS (SELECT response_id, round(sco, 4) AS hallucination_score, CASE WHEN fine THEN round(greatest(0.95, least(0.98, con + 0.18)) + 1e-9, 3) ELSE round(con + 1e-9, 3) END AS confidence FROM sc)"""


@query("A01_hallucination_score", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, {_A01} SELECT * FROM a01")
def a01(spark, d):
    v = verified(spark, d)
    return S.hallucination_score(v.withColumn("fabricated", F.lit(False)), v.select("response_id").distinct())


@query("A02_claim_confidence", f"""WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, a AS (SELECT claim_id, count(DISTINCT source) AS n_sources, avg(score) AS qual, max(score) AS top FROM evidence GROUP BY claim_id),
  x AS (SELECT v.claim_id, verdict, CASE WHEN verdict = 'supported' THEN greatest(coalesce(n_sources, 0), 1) ELSE 0 END AS support_count, CASE verdict WHEN 'supported' THEN 1.0 WHEN 'contradicted' THEN 0.0 ELSE 0.5 END::DOUBLE AS agreement, round(coalesce(qual, 0.5), 4) AS quality, coalesce(top, 0.5) AS top FROM ver v LEFT JOIN a USING (claim_id))
  SELECT claim_id, support_count, agreement, quality AS evidence_quality, CASE WHEN verdict = 'supported' THEN round(greatest(CASE WHEN top >= 0.9 AND support_count >= 2 THEN 0.95 WHEN support_count >= 2 THEN 0.92 ELSE 0.88 END, least(0.98, 0.4 * quality + 0.35 * agreement + 0.25 * least(1.0, 0.5 * support_count))), 2) WHEN verdict = 'contradicted' THEN 0.90 ELSE 0.30 END::DOUBLE AS confidence FROM x""")
def a02(spark, d):
    return S.claim_confidence(verified(spark, d).select("claim_id", "verdict"), templated(spark, d)[1])


@query("A05_response_summary", f"""WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, g AS (SELECT response_id, count(*) AS n, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'contradicted') AS c, count(*) FILTER (verdict = 'partial') AS p FROM ver GROUP BY response_id)
  SELECT response_id, n, s AS n_supported, p AS n_partial, c AS n_contradicted, CASE WHEN s = n THEN 'Fully Supported' WHEN c > 0 THEN 'Contradicted' WHEN s + p > 0 THEN 'Partially Supported' ELSE 'Insufficient Evidence' END AS status, (s + 0.5 * p) / n AS support, least(1.0, 1 - (s + 0.5 * p) / n + 0.25 * c / n) AS p_evidence FROM g""")
def a05(spark, d):
    return S.response_summary(verified(spark, d))


@query("A06_fuse_scores", f"""WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER}, g AS (SELECT response_id, count(*) AS n, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'contradicted') AS c FROM ver GROUP BY response_id),
  x AS (SELECT *, (split_part(response_id, '-', 2)::BIGINT % 100) / 100.0::DOUBLE AS i, least(1.0, 1 - s::DOUBLE / n + 0.25 * c / n) AS e FROM g), y AS (SELECT *, 0.7 * i + 0.3 * e AS p0 FROM x),
  z AS (SELECT *, CASE WHEN c > 0 THEN greatest(p0, 0.5 + 0.15) WHEN s = n THEN least(p0, 0.75 * 0.5) ELSE p0 END AS p1 FROM y) SELECT response_id, greatest(0.0, least(1.0, p1)) AS probability FROM z""")
def a06(spark, d):
    s = S.response_summary(verified(spark, d)).withColumn("internal", (F.split("response_id", "-")[1].cast("long") % 100) / 100.0)
    return s.select("response_id", S.fused(F.col("internal"), F.col("p_evidence"), F.col("n_contradicted") > 0, F.col("n_supported") == F.col("n"), 0.5).alias("probability"))


@query("V16_explain_response", f"""WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER} SELECT response_id, count(*) FILTER (verdict = 'supported') || ' supported, ' || count(*) FILTER (verdict = 'contradicted') || ' contradicted, ' || count(*) FILTER (verdict = 'insufficient') || ' insufficient' AS counts,
  coalesce(string_agg(text, ' ' ORDER BY lower(text), verdict) FILTER (verdict = 'supported'), '') AS supported, coalesce(string_agg(text, ' ' ORDER BY lower(text), verdict) FILTER (verdict = 'insufficient'), '') AS insufficient FROM ver GROUP BY response_id""")
def v16(spark, d):
    return S.explain(verified(spark, d))


@query("W13_claim_numbering", f"WITH {TEMPLATED}, {_EV}, {_ENT}, {_VER} SELECT claim_id, 'C' || row_number() OVER (PARTITION BY response_id ORDER BY lower(text), verdict, claim_id) AS number FROM ver")
def w13(spark, d):
    w = Window.partitionBy("response_id").orderBy(F.lower("text"), "verdict", "claim_id")
    return verified(spark, d).select("claim_id", F.concat(F.lit("C"), F.row_number().over(w)).alias("number"))
