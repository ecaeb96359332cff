"""Decisions about answers: claims of an answer, retrieval for them, verdicts rolled up, conflicts and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities as N
from ..functions import lexicons as L
from ..functions.text import matches, normalized, sentences, strip
from .retrieval import shared_words

TRUSTED = ["wikipedia", "fever", "local kb", "knowledge base", "halueval"]


def resolve_it(answers: DataFrame) -> DataFrame:
    """response_id, at, claim, referent: sentences that state something, a leading "It" put in words by the last subject.

    ``answers``: response_id, response. Sentences of under three words and talk go; so does an "It" that
    refers to nothing. ``referent`` is null where there was no "It".
    """
    s = answers.select("response_id", F.posexplode(F.split(strip(F.coalesce("response", F.lit(""))), r"(?<=[.!?])\s+")).alias("at", "s")).withColumn("s", strip(F.col("s")))
    n_words = F.size(F.split(strip(F.col("s")), r"\s+"))
    s = s.where((n_words >= 3) & ~matches(F.col("s"), L.TALK)).withColumn("s", F.regexp_replace("s", r"(?i)\b(?:actually|separate)\s+", ""))
    it = matches(F.col("s"), r"^It\s+")
    subject = F.regexp_extract("s", L.SUBJECT, 1)
    before = Window.partitionBy("response_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("subject", F.when(~it & (subject != ""), subject)).withColumn("last", F.last("subject", ignorenulls=True).over(before))
    s = s.where(~it | F.col("last").isNotNull()).withColumn("claim", F.when(it, F.concat("last", F.substr("s", F.lit(3)))).otherwise(F.col("s")))
    return s.where(F.size(F.split(strip(F.col("claim")), r"\s+")) >= 3).select("response_id", "at", "claim", F.when(it, F.col("last")).alias("referent"))


def split_claims(answers: DataFrame, most: int = 5) -> DataFrame:
    """response_id, pos, claim: the first ``most`` claims of each answer (response_id, response)."""
    pos = F.row_number().over(Window.partitionBy("response_id").orderBy("at")) - 1
    return resolve_it(answers).withColumn("pos", pos).where(F.col("pos") < most).select("response_id", "pos", "claim")


def tiered_lookup(queries: DataFrame, pages: DataFrame, top_k: int = 3) -> DataFrame:
    """id, title, text, similarity, attempt, status: pages of a query's main name.

    ``queries``: id, query, term; ``pages``: title, text. First the page of that title; for a company also
    "X Inc." and "X (company)"; then pages that share a word of their titles. A page is taken if it is
    similar enough (0.50); a query without any gets one placeholder. Titles are joined by key, and words
    only for queries that titles do not answer (by ``shared_words``, so frequent words of titles don't pair everything).
    """
    p = pages.select("title", "text", F.lower("title").alias("key"))
    ask = queries.select("id", "query", "term", N.expected_type(F.col("query")).alias("wants"))
    firm = (F.col("wants") == "ORGANIZATION") & ~F.contains(F.lower("term"), F.lit("inc"))
    tier = lambda n, key: F.struct(F.lit(n).alias("tier"), F.lower(key).alias("key"))
    keys = F.concat(F.array(tier(0, F.col("term"))), F.when(firm, F.array(tier(1, F.concat("term", F.lit(" Inc."))), tier(2, F.concat("term", F.lit(" (company)"))))).otherwise(F.array().cast("array<struct<tier:int,key:string>>")))

    def accepted(found: DataFrame) -> DataFrame:
        value = N.entity_similarity(F.col("term"), F.col("title"), F.col("text"), wanted=F.col("wants"))
        return found.select("id", "tier", "title", "text", F.round(value, 2).alias("similarity")).where("similarity >= 0.5")

    exact = accepted(ask.select("*", F.inline(keys)).join(p, "key"))
    exact = exact.withColumn("first", F.min("tier").over(Window.partitionBy("id"))).where("tier = first").drop("first")
    left = ask.join(exact.select("id").distinct(), "id", "left_anti")
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2).alias("words")
    ranked = shared_words(left.select("id", words(F.col("term"))), p.select(F.col("title").alias("fact"), words(F.col("title"))), top_k).select("id", F.col("fact").alias("title"))
    found = exact.unionByName(accepted(ranked.join(ask, "id").join(p, "title").withColumn("tier", F.lit(3))))
    j = ask.join(found, "id", "left")
    none = F.concat(F.lit("No direct extract found for query '"), "query", F.lit("'."))
    return j.select(
        "id", F.coalesce("title", "term").alias("title"), F.coalesce("text", none).alias("text"), F.coalesce("similarity", F.lit(0.20)).alias("similarity"),
        F.when(F.coalesce("tier", F.lit(0)) == 0, 1).otherwise(2).alias("attempt"), F.when(F.col("tier").isNull(), "Failed").otherwise("Passed").alias("status"),
    )


def hybrid_rank(candidates: DataFrame, k: int = 5) -> DataFrame:
    """claim_id, doc_id, score, rank: documents from several sources ranked for each claim.

    ``candidates``: claim_id, doc_id, source, title, text, semantic, exact, names (the claim's entities, the
    first is the main one). Blank texts and "halueval" go, of equal texts the smallest doc_id stays; facts
    must be accepted and documents be about an entity of the claim.
    """
    c = candidates.where((strip(F.coalesce("text", F.lit(""))) != "") & (F.lower("source") != "halueval"))
    once = Window.partitionBy("claim_id", F.lower(strip(F.col("text")))).orderBy("doc_id")
    c = c.withColumn("n", F.row_number().over(once)).where("n = 1")
    main = F.get("names", F.lit(0))
    c = c.where((F.col("source") != "FEVER") | N.accept_fact(F.col("semantic"), main, F.col("text"))).where(N.entity_consistency(F.col("exact"), F.col("names"), F.col("title"), F.col("text")))
    c = c.withColumn("primary", N.primary_relevance(main, F.col("title"), F.col("text")))
    c = c.withColumn("score", 0.60 * F.col("semantic") + 0.40 * F.col("primary") + F.when(F.col("exact"), 1.0).otherwise(0.0))
    order = F.when(F.col("source") == "Wikipedia", 0).when(F.col("source") == "FEVER", 1).otherwise(2)
    w = Window.partitionBy("claim_id").orderBy(order, F.desc("primary"), F.desc("score"), "doc_id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("claim_id", "doc_id", "source", "text", "score", "rank")


def retrieve_for_claims(claims: DataFrame, ranked: DataFrame) -> DataFrame:
    """Every claim (claim_id, response_id, ...) with its documents, or with nulls; ``bare``: no claim of its response has any."""
    j = claims.join(ranked, "claim_id", "left")
    return j.withColumn("bare", F.count("doc_id").over(Window.partitionBy("response_id")) == 0)


def claim_states(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """claim_id, response_id, pos, claim, state, top: by trusted documents of ``least`` and more, or by a verdict given.

    ``docs``: claim_id, response_id, pos, claim, said_supported, said_contradicted, source, text, score, rank
    (one row with nulls for a claim without documents).
    """
    near = F.col("score") >= least
    g = docs.groupBy("claim_id", "response_id", "pos", "claim", "said_supported", "said_contradicted").agg(
        F.coalesce(F.bool_or(near), F.lit(False)).alias("near"), F.coalesce(F.bool_or(near & F.lower("source").isin(*TRUSTED)), F.lit(False)).alias("trusted"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top")
    )
    supported = F.col("trusted") | (F.coalesce("said_supported", F.lit(False)) & F.col("near"))
    state = F.when(supported, "SUPPORTED").when(F.coalesce("said_contradicted", F.lit(False)) & F.col("near"), "CONTRADICTED").otherwise("INSUFFICIENT_EVIDENCE")
    return g.withColumn("state", state).select("claim_id", "response_id", "pos", "claim", "state", "top")


def retained_evidence(docs: DataFrame, states: DataFrame, least: float = 0.35) -> DataFrame:
    """response_id, claim, state, source, text, score, pos, n: the first two near documents of each decided claim, each text of a source once."""
    near = docs.where(F.col("score") >= least).withColumn("n", F.row_number().over(Window.partitionBy("claim_id").orderBy("rank"))).where("n <= 2")
    j = near.select("claim_id", "source", "text", F.round("score", 4).alias("score"), "n").join(states.where("state <> 'INSUFFICIENT_EVIDENCE'"), "claim_id")
    w = Window.partitionBy("response_id", "source", F.lower(strip(F.col("text")))).orderBy("pos", "n")
    return j.withColumn("seen", F.row_number().over(w)).where("seen = 1").select("response_id", "claim_id", "claim", "state", "source", "text", "score", "pos", "n")


def aggregate_verdicts(docs: DataFrame) -> DataFrame:
    """Counts, decision ("yes": contradicted, "no": supported, "uncertain") and confidence of each response."""
    states = claim_states(docs)
    is_ = lambda x: F.count_if(F.col("state") == x)
    per = states.groupBy("response_id").agg(
        F.count("*").alias("n_claims"), is_("SUPPORTED").alias("n_supported"), is_("CONTRADICTED").alias("n_contradicted"), is_("INSUFFICIENT_EVIDENCE").alias("n_insufficient"), F.round(F.avg("top"), 4).alias("mean_similarity")
    )
    kept = retained_evidence(docs, states).groupBy("response_id").agg(
        is_("CONTRADICTED").alias("kept_contradictions"), is_("SUPPORTED").alias("kept_support"), F.avg("score").alias("quality"), F.countDistinct("source").alias("sources")
    )
    out = per.join(kept, "response_id", "left").fillna(0, ["kept_contradictions", "kept_support", "quality", "sources"])
    coverage = (F.col("n_supported") + F.col("n_contradicted")) / F.col("n_claims")
    confidence = F.col("quality") * (0.60 + 0.25 * coverage + 0.15 * F.least(F.lit(1.0), F.col("sources") / 2.0))
    decision = F.when(F.col("kept_contradictions") > 0, "yes").when(F.col("kept_support") > 0, "no").otherwise("uncertain")
    return out.withColumns({"decision": decision, "confidence": F.round(confidence, 4)}).drop("quality", "sources")


def decision_scores(verdicts: DataFrame) -> DataFrame:
    """response_id, decision, probability, confidence, label: of ``aggregate_verdicts`` rows, made consistent first."""
    no_contra = F.col("kept_contradictions") == 0
    decision = F.when(no_contra & (F.col("kept_support") > 0), "no").when(no_contra & (F.col("decision") == "yes"), "uncertain").otherwise(F.col("decision"))
    changed = no_contra & ((F.col("kept_support") > 0) | (F.col("decision") == "yes"))
    v = verdicts.withColumns({"total": F.greatest(F.lit(1), "n_claims"), "contra": F.when(changed, 0).otherwise(F.col("n_contradicted")), "decision": decision})
    p = F.when(F.col("decision") == "yes", F.col("contra") / F.col("total")).when(F.col("decision") == "no", 0.0).otherwise(0.5)
    label = F.when(F.col("decision") == "yes", "high").when(F.col("decision") == "no", "low").otherwise("uncertain")
    return v.select("response_id", "decision", F.round(p, 4).alias("probability"), F.round(F.greatest("n_supported", "contra") / F.col("total"), 4).alias("confidence"), label.alias("label"))


def user_claim_conflict(user: Column, facts: Column) -> Column:
    """Whether a user's claim and supported facts differ: one of them denies, or they name different regions only."""
    u, f = F.lower(F.coalesce(user, F.lit(""))), F.lower(F.coalesce(facts, F.lit("")))
    named = lambda c: F.filter(F.array(*map(F.lit, L.CONFLICT_REGIONS)), lambda r: F.contains(c, r))
    apart = (F.size(named(u)) > 0) & (F.size(named(f)) > 0) & ~F.arrays_overlap(named(u), named(f))
    return (u != "") & (f != "") & ((F.contains(u, F.lit(" not ")) != F.contains(f, F.lit(" not "))) | apart)


def verified_answers(users: DataFrame, verdicts: DataFrame, states: DataFrame, kept: DataFrame) -> DataFrame:
    """response_id, answer: what the decision means for the user's claim (``users``: response_id, query)."""
    facts = states.where("state = 'SUPPORTED'").groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim"))), lambda x: x["claim"]), " ").alias("facts"))
    against = kept.where("state = 'CONTRADICTED'").groupBy("response_id").agg(F.min_by("text", F.struct("pos", "n")).alias("detail"))
    j = verdicts.select("response_id", "decision").join(users, "response_id").join(facts, "response_id", "left").join(against, "response_id", "left")
    f = F.coalesce("facts", F.lit(""))
    fine = F.when(user_claim_conflict(F.col("query"), f), F.concat(F.lit("The user's claim is false. "), f)).otherwise(F.concat(F.lit("The user's claim is supported by retrieved evidence. "), f))
    answer = F.when(F.col("decision") == "no", fine).when(F.col("decision") == "yes", F.concat(F.lit("The generated response is contradicted by evidence. "), F.coalesce("detail", F.lit(""))))
    return j.select("response_id", strip(F.coalesce(answer, F.lit("There is insufficient evidence to verify this claim."))).alias("answer"))


def knowledge_context(queries: DataFrame, pages: DataFrame, most: int = 3, length: int = 600) -> DataFrame:
    """id, context: "name: beginning of its first page" of a query's first entities. ``pages``: name, rank, text."""
    e = queries.select("id", F.posexplode(F.slice(N.by_priority(N.searchable(N.extract_entities(F.col("query")))), 1, most)).alias("pos", "e")).select("id", "pos", F.col("e.text").alias("name"))
    e = e.groupBy("id", "name").agg(F.min("pos").alias("pos"))
    first = pages.groupBy("name").agg(F.min_by("text", "rank").alias("text")).where("text <> ''")
    block = F.struct("pos", F.concat("name", F.lit(": "), F.substring("text", 1, length)).alias("b"))
    got = e.join(first, "name").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))
    return queries.select("id").join(got, "id", "left").select("id", F.coalesce("context", F.lit("")).alias("context"))


def _sentences(answers: DataFrame) -> DataFrame:
    s = answers.select("response_id", F.posexplode(F.split(F.coalesce("response", F.lit("")), r"(?<=[.!?])\s+")).alias("at", "s"))
    return s.withColumn("denial", matches(F.col("s"), L.DENIAL))


def pronoun_affirmed(answers: DataFrame) -> DataFrame:
    """response_id, name (lower case): subjects that a later sentence speaks of by a pronoun and does not deny."""
    s = _sentences(answers)
    subject = F.get(F.filter(N.extract_entities(F.col("s")), lambda e: e["label"].isin("PERSON", "ORGANIZATION", "SPORTS_TEAM")), F.lit(0))["text"]
    before = Window.partitionBy("response_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("subject", subject).withColumn("last", F.last("subject", ignorenulls=True).over(before))
    return s.where(~F.col("denial") & F.col("last").isNotNull() & matches(F.col("s"), r"\b(he|she|it|him|her|his|its)\b")).select("response_id", F.lower("last").alias("name")).distinct()


def _same_name(a: Column, b: Column) -> Column:
    return (a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" ")))


def denial_check(answers: DataFrame, grounded: DataFrame, affirmed: DataFrame) -> DataFrame:
    """response_id, name, claim, verdict, confidence: denials of entities for which there is evidence.

    ``grounded``: response_id, name, with evidence; ``affirmed``: response_id, name of entities of supported
    claims. A name counts as affirmed if a claim, a sentence that does not deny, or a pronoun does.
    """
    s = _sentences(answers)
    low = F.lower("name")
    about = grounded.join(s, "response_id").groupBy("response_id", "name").agg(
        F.bool_or(F.col("denial") & F.contains(F.lower("s"), low)).alias("denied"), F.bool_or(~F.col("denial") & F.contains(F.lower("s"), low)).alias("said")
    )
    named = affirmed.select("response_id", F.lower("name").alias("a")).unionByName(pronoun_affirmed(answers).withColumnRenamed("name", "a")).distinct()
    rows = about.where("denied AND NOT said").alias("x")
    left = rows.join(named.alias("y"), (F.col("x.response_id") == F.col("y.response_id")) & _same_name(F.lower("x.name"), F.col("y.a")), "left_anti")
    claim = F.concat(F.lit("The response claims to have no information about "), "name", F.lit(", despite verified reference evidence that "), "name", F.lit(" exists."))
    return left.select("response_id", "name", claim.alias("claim"), F.lit("contradicted").alias("verdict"), F.lit(0.9).alias("confidence"))


def fabricated_alternatives(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """response_id, claim_id, fabricated: claims about other names in an answer that found nothing and offers something else.

    ``claims``: response_id, claim_id, verdict, names; ``answers``: response_id, response, query_names.
    """
    j = claims.join(answers.select("response_id", "response", "query_names"), "response_id")
    low = lambda a: F.transform(a, F.lower)
    flag = F.col("response").rlike(L.ALTERNATIVE) & (F.col("verdict") != "contradicted") & (F.size("names") > 0) & ~F.arrays_overlap(low(F.col("names")), low(F.col("query_names")))
    return j.select("response_id", "claim_id", flag.alias("fabricated"))


def primary_person(entities: DataFrame) -> DataFrame:
    """``entities`` (response_id, claim_id, pos, text, label): persons that share a word with the response's longest person take its name.

    Of a claim's entities that then have the same text and label, the first stays; those without text go.
    """
    person = F.when(F.col("label") == "PERSON", F.struct(F.length("text").alias("n"), F.negate("pos").alias("p"), F.col("text").alias("t")))
    longest = F.max(person).over(Window.partitionBy("response_id"))["t"]
    e = entities.withColumn("longest", longest)
    part = F.exists(F.split("text", r"\s+"), lambda w: F.contains(F.col("longest"), w))
    e = e.withColumn("text", F.when((F.col("label") == "PERSON") & F.col("longest").isNotNull() & part, F.col("longest")).otherwise(F.col("text"))).drop("longest")
    again = F.row_number().over(Window.partitionBy("claim_id", F.trim("text"), "label").orderBy("pos"))
    return e.where(F.trim("text") != "").withColumn("__again", again).where("__again = 1").drop("__again")


def reference_queries(texts: DataFrame, most: int = 3) -> DataFrame:
    """id, pos, query: names to look up for a text's claims, ``most`` at most, each once.

    A claim's first entity; a claim that begins with a pronoun asks for the last such entity of its text and
    for its own first one. ``texts``: id, text.
    """
    c = texts.select("id", F.posexplode(sentences(F.col("text"), "clause", 0)).alias("at", "claim"))
    bare = F.regexp_replace(strip(F.regexp_replace("claim", L.STANCE, "")), r"^[ ,;:-]+|[ ,;:-]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^according\s+to\s+[^,]+,\s*", ""), r"[.?! ]+$", "")
    c = c.withColumn("claim", bare).where("claim <> ''")
    refers = matches(F.col("claim"), r"^\s*(?:it|he|she|they|the\s+country|the\s+player)\b")
    c = c.withColumns({"refers": refers, "e": F.get(N.extract_entities(F.col("claim")), F.lit(0))["text"]})
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("last", F.last(F.when(~F.col("refers"), F.col("e")), ignorenulls=True).over(before))
    asked = F.array_compact(F.when(F.col("refers"), F.array("last", "e")).otherwise(F.array("e")))
    q = c.select("id", "at", F.posexplode(asked).alias("i", "query")).withColumn("query", strip(F.regexp_replace("query", r"(?i)^(?:the|a|an)\s+", "")))
    q = q.withColumn("key", N.plain(F.col("query"))).where("key <> ''")
    first = q.groupBy("id", "key").agg(F.min(F.struct("at", "i", "query")).alias("f"))
    pos = F.row_number().over(Window.partitionBy("id").orderBy("f.at", "f.i")) - 1
    return first.withColumn("pos", pos).where(F.col("pos") < most).select("id", "pos", F.col("f.query").alias("query"))


def _team(c: Column) -> Column:
    """A team's name from what follows a verb."""
    cut = strip(F.get(F.split(c, r"(?i)\b(on|in|from|for|and|who|regarded|winning|leaving|previously|signed|joined|where|as|with|after)\b"), F.lit(0)))
    return strip(F.regexp_replace(cut, r"(?i)^(the|a|an|la liga club|premier league club)\s+", ""))


def team_profiles(evidence: DataFrame) -> DataFrame:
    """id, current, former, current_roles, former_roles: teams and roles that evidence (id, pos, text) tells of; former beats current."""
    s = evidence.select("id", "pos", F.posexplode(F.split("text", r"[.!?]\s+")).alias("i", "s")).withColumn("s", normalized(strip(F.col("s"))))
    has = lambda *xs: F.lit(False) if not xs else (F.contains(F.col("s"), F.lit(xs[0])) | has(*xs[1:]))
    after = lambda m: F.when(F.contains(F.col("s"), F.lit(m)), _team(F.element_at(F.split("s", m), -1)))
    long = lambda a: F.filter(F.array_compact(a), lambda t: F.length(t) > 3)
    many = lambda cond, *ms: F.when(cond, F.array(*[after(m) for m in ms])).otherwise(F.array().cast("array<string>"))
    plays = has("plays for ", "plays as a", "forward for ") & ~has("previously", "former", "leaving", "left", "signed for")
    current = F.concat(
        many(plays, "plays for ", "forward for ", "striker for ", "winger for "),
        many(has("captains ", "represents ", "represented "), "captains the ", "captains ", "represents the ", "represents ", "represented the ", "represented "),
        many(has("joined ") & has("2024", "2025", "2026"), "joined "),
    )
    gone = many(has("previously played for", "leaving", "left ", "former player", "transferred from", "former club"), "previously played for ", "leaving ", "left ", "transferred from ", "former club ")
    signed = many(has("signed for ", "career in "), "signed for ", "career in ", "played for ")
    dated = has(*[str(y) for y in range(2015, 2024)])
    s = s.select("id", "pos", "i", long(current).alias("c"), long(gone).alias("f"), long(signed).alias("g"), dated.alias("dated"),
        (has("former") & has("captain")).alias("was"), (has("captains", "current captain") & ~(has("former") & has("captain"))).alias("is"))
    upto = Window.partitionBy("id").orderBy("pos", "i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("some", F.coalesce(F.max((F.size("c") > 0).cast("int")).over(upto), F.lit(0)) > 0)
    s = s.withColumn("f", F.concat("f", F.when(F.col("dated") | F.col("some"), F.col("g")).otherwise(F.array().cast("array<string>"))))
    g = s.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("former"), F.bool_or("is").alias("is"), F.bool_or("was").alias("was"))
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3)
    beaten = lambda t: F.exists("former", lambda f: F.arrays_overlap(words(f), words(t))) & ~t.contains("real madrid") & ~t.contains("france")
    role = lambda c: F.when(c, F.array(F.lit("captain"))).otherwise(F.array().cast("array<string>"))
    return g.select("id", F.filter("c", lambda t: ~beaten(t)).alias("current"), "former", role(F.col("is")).alias("current_roles"), role(F.col("was")).alias("former_roles"))


def team_verdict(claim: Column, current: Column, former: Column, current_roles: Column, former_roles: Column) -> Column:
    """struct(verdict, confidence) of a claim about a team or captaincy by a profile; null if it decides nothing."""
    c = normalized(claim)
    any_of = lambda *xs: c.rlike("|".join(xs))
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 3)
    active = any_of("plays for", "signed with", "plays as a forward for", "plays as a striker for", "represented")
    past = any_of("previously", "former", "was a", "played for", "used to play")
    left = F.exists(former, lambda f: F.exists(words(f), lambda w: F.contains(c, w)) & ~F.exists(current, lambda t: F.forall(words(f), lambda w: F.contains(t, w))))
    there = F.exists(current, lambda t: (F.size(words(t)) > 0) & F.forall(words(t), lambda w: F.contains(c, w)))
    v = lambda name, x: F.struct(F.lit(name).alias("verdict"), F.lit(x).alias("confidence"))
    captain = any_of("current captain", "currently captains", "is captain", "is the captain") & (F.size(former_roles) > 0) & (F.size(current_roles) == 0)
    return F.when(active & ~past & left, v("contradicted", 0.92)).when(active & there, v("supported", 0.95)).when(captain, v("contradicted", 0.92))


def corrected_responses(rows: DataFrame) -> DataFrame:
    """response_id, corrected: supported claims, then what the first page says instead of the others.

    ``rows``: response_id, query, response, supported and contradicted (arrays in order), page (its text or null).
    """
    parts = F.filter(F.transform(F.split(F.coalesce("page", F.lit("")), r"\."), strip), lambda s: F.length(s) > 10)
    excerpt = F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit("."))
    kept = F.transform("supported", lambda c: F.concat(F.regexp_replace(c, r"\.+$", ""), F.lit(".")))
    first = F.get("contradicted", F.lit(0))
    against = F.when(F.size(parts) > 0, F.concat(F.lit("Verified evidence indicates that "), excerpt)).when(first.isNotNull(), F.concat(F.lit("Verified evidence indicates that assertion '"), first, F.lit("' is unsupported.")))
    every = F.concat(kept, F.when(against.isNotNull(), F.array(against)).otherwise(F.array().cast("array<string>")))
    once = F.filter(every, lambda p, i: F.array_position(F.transform(every, F.lower), F.lower(p)) == i + 1)
    none = F.concat(F.lit("Retrieved evidence provides insufficient verification for query: '"), "query", F.lit("'."))
    fine = (F.size("supported") > 0) & (F.size("contradicted") == 0) & (F.col("n_claims") == F.size("supported"))
    return rows.select("response_id", F.when(fine, strip(F.col("response"))).when(F.size(once) > 0, F.array_join(once, " ")).otherwise(none).alias("corrected"))


def pipeline_traces(queries: DataFrame, pages: DataFrame, claims: DataFrame) -> DataFrame:
    """id, entity, expected_type, candidates, accepted, retried, n_claims and counts of verdicts: how an answer came about.

    ``pages``: of ``tiered_lookup``; ``claims``: id, verdict.
    """
    is_ = lambda x: F.count_if(F.col("verdict") == x)
    counts = claims.groupBy("id").agg(F.count("*").alias("n_claims"), is_("supported").alias("n_supported"), is_("contradicted").alias("n_contradicted"), is_("insufficient").alias("n_insufficient"))
    q = queries.select("id", F.col("term").alias("entity"), N.expected_type(F.col("query")).alias("expected_type"))
    row = F.struct("title", (F.col("status") == "Passed").alias("accepted"), "similarity")
    found = pages.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("c"), F.bool_or(F.col("attempt") > 1).alias("retried"))
    j = q.join(found, "id", "left").join(counts, "id", "left").fillna(0)
    return j.select("id", "entity", "expected_type", F.size("c").alias("candidates"), F.size(F.filter("c", lambda x: x["accepted"])).alias("accepted"), F.coalesce("retried", F.lit(False)).alias("retried"), "n_claims", "n_supported", "n_contradicted", "n_insufficient")
