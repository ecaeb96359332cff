"""Queries of names: recognition, linking, triples, types, lookup terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as N
from ..functions import lexicons as L
from ..operators import answers as A
from .profiles import PROFILES, claims, pages, people, pick
from .q_text import strings, strip
from .registry import query

_any = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
#: What the sentences of the view are made of tells their entities: the SQL puts them together, the operator reads the text.
_FIRM = "CASE WHEN company LIKE '% Inc' THEN [] ELSE [company || '/PERSON'] END"
_PERSON, _TWICE = "[person || '/PERSON']", "[person || '/PERSON', person || '/PERSON']"
_TEAM_OF = lambda c: f"[person || '/PERSON', {c} || '/SPORTS_TEAM', person || '/PERSON']"
ENTITIES = f"""en AS (SELECT c.*, CASE WHEN pos = 0 AND k % 4 = 0 THEN list_concat({_FIRM}, {_PERSON}) WHEN pos = 0 THEN list_concat({_PERSON}, {_FIRM}, {_PERSON})
  WHEN pos = 1 THEN list_concat({_FIRM}, [CASE WHEN k % 3 = 0 THEN p.other ELSE c.place END || '/COUNTRY', company || '/PERSON'])
  WHEN pos = 2 AND k % 4 = 0 THEN {_TEAM_OF('p.former')} WHEN pos = 2 AND k % 5 = 0 THEN {_TWICE} WHEN pos = 2 THEN {_TEAM_OF('c.team')}
  WHEN k % 5 = 0 OR k % 7 = 0 THEN {_TWICE} ELSE [p.year || '/DATE', p.year || '/NUMBER'] END AS es FROM (SELECT * FROM pcl) c JOIN (SELECT k, other, former, year FROM ppl) p USING (k)),
er AS (SELECT claim_id, response_id, pos, k, text AS claim, i AS ord, split_part(es[i], '/', 1) AS text, split_part(es[i], '/', 2) AS label FROM en, unnest(range(1, len(es) + 1)) AS r(i)),
ep AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE label WHEN 'PERSON' THEN 0 WHEN 'SPORTS_TEAM' THEN 1 WHEN 'COUNTRY' THEN 2 WHEN 'DATE' THEN 4 WHEN 'NUMBER' THEN 5 ELSE 99 END, ord) AS rk FROM er)"""
_listed = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws("/", e["text"], e["label"])), ";")


def recognized(spark, d):
    return claims(people(spark, d)).withColumn("es", N.extract_entities(F.col("text")))


@query("T15_extract_entities", f"WITH {PROFILES}, {ENTITIES} SELECT claim_id, string_agg(text || '/' || label, ';' ORDER BY ord) AS entities FROM er GROUP BY claim_id")
def t15(spark, d):
    return recognized(spark, d).select("claim_id", _listed(F.col("es")).alias("entities"))


_NATIONS = ["French", "German", "Spanish", "Indian"]


@query("T16_extract_entities_alias", f"WITH {PROFILES} SELECT k, person || '/PERSON;' || CASE WHEN k % 4 = 0 THEN 'Kylian Mbappé/PERSON;' ELSE '' END || {strings(_NATIONS)}[k % 4 + 1] || '/NATIONALITY' AS entities FROM ppl")
def t16(spark, d):
    who = F.when(F.col("k") % 4 == 0, " friend of Mbappé.").otherwise(" footballer.")
    text = F.concat("person", F.lit(" is a "), pick(_NATIONS, F.col("k")), who)
    return people(spark, d).select("k", _listed(N.extract_aliases(text)).alias("entities"))


_ABOUT = ["It sells iPhones.", "It is a fruit.", "It plays music.", "It is well known."]


@query("T17_link_entities", f"WITH {PROFILES} SELECT k, ['Apple Inc.', 'Apple', 'Apple Records', 'Apple Inc.'][k % 4 + 1] || ';' || person AS titles FROM ppl")
def t17(spark, d):
    given = F.array(N.entity(F.lit("Apple"), "ORGANIZATION"), N.entity(F.col("person"), "PERSON"), N.entity(F.lit(" apple "), "ORGANIZATION"))
    return people(spark, d).select("k", F.array_join(F.transform(N.link_entities(given, pick(_ABOUT, F.col("k"))), lambda e: e["title"]), ";").alias("titles"))


_BARE = lambda x: rf"regexp_replace({x}, '^[.,!? ]+|[.,!? ]+$', '', 'g')"
_SIDE = lambda x: (
    f"CASE WHEN {x} = '' THEN 'General' WHEN {_any(f'lower({x})', L.ORG_WORDS)} THEN 'Organization' WHEN {_any(f'lower({x})', L.COUNTRY_WORDS)} THEN 'Country' WHEN {_any(f'lower({x})', L.CITY_WORDS)} THEN 'City' "
    rf"WHEN len(string_split_regex({x}, '\s+')) IN (2, 3) AND len(list_filter(string_split_regex({x}, '\s+'), lambda w: lower(w) NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'is', 'are', 'was', 'were') AND NOT regexp_matches(w, '^[A-Z]'))) = 0 THEN 'Person' ELSE 'General' END"
)


def _sql_triples() -> str:
    rows = []
    for i, (pattern, conf, s, r, o) in enumerate(N.TRIPLES):
        part = lambda gs, p=pattern: " || ' ' || ".join(strip(f"regexp_extract(text, '{p}', {g})") for g in gs)
        rows.append(f"SELECT claim_id, {i} AS n, {_BARE(part(s))} AS subject, {part(r)} AS relation, regexp_replace({_BARE(part(o))}, '(?i)^(is|was) ', '') AS object, {conf}::DOUBLE AS confidence FROM pcl WHERE regexp_matches(text, '{pattern}')")
    return " UNION ALL ".join(rows)


_KIND_OF = lambda side: f"CASE WHEN subject IS NOT NULL THEN {_SIDE(side)} END AS {side}_type"


@query("T19_extract_triple", f"WITH {PROFILES}, t AS ({_sql_triples()}), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n) = 1) SELECT claim_id, subject, relation, object, {_KIND_OF('subject')}, {_KIND_OF('object')}, confidence FROM pcl LEFT JOIN b USING (claim_id)")
def t19(spark, d):
    return claims(people(spark, d)).select("claim_id", N.triple(F.col("text")).alias("t")).select("claim_id", "t.*")


_VERB = " ".join(f"WHEN contains(lower(text), '{v}') THEN '{v}'" for v in L.PROVENANCE_VERBS)


@query("T20_provenance_triple", f"WITH {PROFILES}, {ENTITIES}, s AS (SELECT claim_id, coalesce(arg_min(text, ord) FILTER (label = 'PERSON'), arg_min(text, ord)) AS subject FROM er GROUP BY claim_id), v AS (SELECT claim_id, text, CASE {_VERB} ELSE '' END AS relation FROM pcl) SELECT claim_id, subject, relation, CASE WHEN relation = '' THEN '' ELSE rtrim(trim(text[instr(lower(text), relation) + length(relation):]), '.') END AS object FROM v JOIN s USING (claim_id)")
def t20(spark, d):
    return recognized(spark, d).select("claim_id", N.provenance(F.col("text"), F.col("es")).alias("t")).select("claim_id", "t.*")


_EXPECTED = lambda x: f"CASE WHEN {x} LIKE '% is the CEO of %' OR {x} LIKE 'The CEO of % is %' OR {x} LIKE '% is headquartered in %' OR {x} LIKE '% founded %' THEN 'ORGANIZATION' " + " ".join(f"WHEN {_any(f'lower({x})', ws)} THEN '{t}'" for t, ws in L.EXPECTED_TYPE) + " ELSE 'GENERIC' END"
_PAGE = lambda t, x: "CASE " + " ".join(f"WHEN {_any(f'lower({x})[1:500]', ws)}" + (f" OR {_any(f'lower({t})', ['inc', 'company'])}" if k == "ORGANIZATION" else "") + f" THEN '{k}'" for k, ws in L.PAGE_TYPE) + f" WHEN {_any(f'lower({x})[1:500]', L.PLACE_WORDS)} THEN 'LOCATION' ELSE 'GENERIC' END"


@query("T21_infer_entity_type", f"WITH {PROFILES} SELECT c.claim_id, p.page_id, {_EXPECTED('c.text')} AS expected, {_PAGE('p.title', 'p.text')} AS found FROM pcl c JOIN ppg p USING (k)")
def t21(spark, d):
    ppl = people(spark, d)
    j = claims(ppl).select("claim_id", "k", F.col("text").alias("claim")).join(pages(ppl), "k")
    return j.select("claim_id", "page_id", N.expected_type(F.col("claim")).alias("expected"), N.page_type(F.col("title"), F.col("text")).alias("found"))


_SIM = f"""sm AS (SELECT c.claim_id, p.page_id, lower(c.company) AS t, lower(p.title) AS p, lower(p.text)[1:300] AS e, {_EXPECTED('c.text')} AS w, {_PAGE('p.title', 'p.text')} AS g, list_filter(string_split(lower(c.company), ' '), lambda x: length(x) > 2) AS own FROM pcl c JOIN ppg p USING (k)),
sn AS (SELECT *, len(list_filter(own, lambda x: list_contains(string_split(p, ' '), x) OR contains(e, x)))::DOUBLE / len(own) AS share FROM sm)"""


@query("T22_entity_similarity", f"""WITH {PROFILES}, {_SIM} SELECT claim_id, page_id, CASE WHEN starts_with(p, t) OR contains(p, t || ' inc') THEN CASE WHEN w = 'ORGANIZATION' AND g <> 'ORGANIZATION' AND NOT contains(p, 'inc') AND NOT contains(e, 'tech') THEN 0.15 ELSE 0.98 END
  WHEN len(list_filter(own, lambda x: contains(p, x))) > 0 THEN greatest(0.85, share) WHEN len(list_filter(own, lambda x: contains(e, x))) > 0 THEN greatest(0.65, share * 0.8) ELSE 0.20 END::DOUBLE AS similarity FROM sn""")
def t22(spark, d):
    ppl = people(spark, d)
    j = claims(ppl).select("claim_id", "k", "company", F.col("text").alias("claim")).join(pages(ppl), "k")
    return j.select("claim_id", "page_id", N.entity_similarity(F.col("company"), F.col("title"), F.col("text"), F.col("claim")).alias("similarity"))


@query("T23_query_terms", f"WITH {PROFILES} SELECT response_id, person || ';' || split_part(person, ' ', 1) || ';' || split_part(person, ' ', 2) AS terms FROM pan")
def t23(spark, d):
    from .profiles import answers

    return answers(people(spark, d)).select("response_id", F.array_join(N.query_terms(F.col("query")), ";").alias("terms"))


@query("T24_retrieval_terms_per_claim", f"""WITH {PROFILES}, {ENTITIES}, f AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rk) AS n, arg_min(CASE WHEN label = 'PERSON' THEN text END, CASE WHEN label = 'PERSON' THEN ord END) OVER (PARTITION BY claim_id) AS who FROM ep WHERE label NOT IN ('DATE', 'NUMBER')),
  t AS (SELECT claim_id, n * 10 AS o, text AS term FROM f WHERE n <= 3 UNION ALL SELECT claim_id, n * 10 + 1, who || ' ' || text FROM f WHERE n <= 3 AND text <> who AND len(string_split(text, ' ')) <= 2 UNION ALL SELECT claim_id, 999, rtrim(text, '.') FROM pcl),
  g AS (SELECT claim_id, term, min(o) AS o FROM t GROUP BY ALL) SELECT claim_id, string_agg(term, ';' ORDER BY o) AS terms FROM g GROUP BY claim_id""")
def t24(spark, d):
    return recognized(spark, d).select("claim_id", F.array_join(N.retrieval_terms(F.col("text"), F.col("es")), ";").alias("terms"))


@query("T25_entity_priority", f"WITH {PROFILES}, {ENTITIES} SELECT claim_id, string_agg(text, ';' ORDER BY rk) AS names FROM ep GROUP BY claim_id")
def t25(spark, d):
    return recognized(spark, d).select("claim_id", F.array_join(F.transform(N.by_priority(F.col("es")), lambda e: e["text"]), ";").alias("names"))


@query("W11_propagate_primary_person", f"""WITH {PROFILES}, {ENTITIES}, l AS (SELECT response_id, arg_max(text, (length(text), -(pos * 100 + ord))) AS longest FROM er WHERE label = 'PERSON' GROUP BY response_id),
  n AS (SELECT claim_id, ord, label, CASE WHEN label = 'PERSON' AND len(list_filter(string_split(text, ' '), lambda w: contains(longest, w))) > 0 THEN longest ELSE text END AS text FROM er LEFT JOIN l USING (response_id))
  SELECT claim_id, ord, text FROM n WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY claim_id, trim(text), label ORDER BY ord) = 1""")
def w11(spark, d):
    # outer, as the filter on empty arrays that Spark adds to the other form would recognise all names again
    e = recognized(spark, d).select("claim_id", "response_id", F.col("pos").alias("at"), F.posexplode_outer("es").alias("i", "e")).where("e IS NOT NULL")
    e = e.select("claim_id", "response_id", (F.col("i") + 1).alias("ord"), (F.col("at") * 100 + F.col("i") + 1).alias("pos"), "e.*")
    return A.primary_person(e).select("claim_id", "ord", "text")


_PLAIN = lambda x: rf"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("F03_accept_fact_doc", f"""WITH {PROFILES}, j AS (SELECT c.claim_id, p.page_id, ((c.k * 7 + p.n) % 10) / 10.0::DOUBLE AS s, CASE WHEN c.k % 3 = 0 THEN lower(c.place) WHEN c.k % 3 = 1 THEN lower(c.person) END AS who, {_PLAIN('p.text')} AS t FROM pcl c JOIN ppg p USING (k))
  SELECT claim_id, page_id, s >= 0.55 AND (who IS NULL OR contains(t, who) OR (who = 'india' AND contains(t, 'asia'))) AS accepted FROM j""")
def f03(spark, d):
    ppl = people(spark, d)
    j = claims(ppl).drop("text").join(pages(ppl).select("k", "n", "page_id", "text"), "k")
    who = F.when(F.col("k") % 3 == 0, F.col("place")).when(F.col("k") % 3 == 1, F.col("person"))
    return j.select("claim_id", "page_id", N.accept_fact(((F.col("k") * 7 + F.col("n")) % 10) / 10.0, who, F.col("text")).alias("accepted"))


@query("F04_entity_consistency", f"WITH {PROFILES} SELECT c.claim_id, p.page_id, c.k % 5 = 0 OR c.k % 4 = 0 OR contains({_PLAIN('p.title || chr(32) || p.text')}, {_PLAIN('c.person')}) OR contains({_PLAIN('p.title || chr(32) || p.text')}, {_PLAIN('c.team')}) AS consistent FROM pcl c JOIN ppg p USING (k)")
def f04(spark, d):
    ppl = people(spark, d)
    j = claims(ppl).drop("text").join(pages(ppl).select("k", "page_id", "title", "text"), "k")
    names = F.when(F.col("k") % 4 != 0, F.array("person", "team"))
    return j.select("claim_id", "page_id", N.entity_consistency(F.col("k") % 5 == 0, names, F.col("title"), F.col("text")).alias("consistent"))


