"""Column functions over names: recognition, linking, triples, types of queries and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import folded, let, relation, strip

ENTITY = "struct<text:string,label:string>"


def entity(text: Column, label: str | Column) -> Column:
    return F.struct(text.alias("text"), (F.lit(label) if isinstance(label, str) else label).alias("label"))


def _none() -> Column:
    return F.array().cast(f"array<{ENTITY}>")


def _one_of(c: Column, words: list[str]) -> Column:
    """Whether one of ``words`` is in the text, anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def _label(phrase: Column) -> Column:
    """Kind of a proper-noun phrase, null if it is not known well enough."""
    n = F.lower(strip(phrase))
    w = F.split(strip(phrase), r"\s+")
    first, last = F.lower(F.get(w, F.lit(0))), F.lower(F.element_at(w, -1))
    out = F.when((F.size(w) >= 2) & ~first.isin(*L.PLACE_STARTS) & ~last.isin(*L.PLACE_ENDS), "PERSON")
    out = F.when(phrase.rlike("(" + "|".join(L.TEAM_ENDS) + ")$"), "SPORTS_TEAM").otherwise(out)
    for words, label in ((L.REGIONS, "LOCATION"), (L.KNOWN_COUNTRIES + L.LONG_COUNTRIES, "COUNTRY"), (L.KNOWN_NATIONALITIES, "NATIONALITY")):
        out = F.when(n.isin(*words), label).otherwise(out)
    for name, label in reversed(L.KNOWN_ENTITIES.items()):
        out = F.when(n.startswith(name + " "), label).otherwise(out)
    for name, label in L.KNOWN_ENTITIES.items():
        out = F.when(n == name, label).otherwise(out)
    return out


def _leading_person(text: Column) -> Column:
    found = F.regexp_extract(text, L.LEADING_PERSON, 1)
    return F.when(found != "", F.array(entity(found, "PERSON"))).otherwise(_none())


def _as_teams(entities: Column, text: Column, labels: list[str]) -> Column:
    """Places and organisations that somebody plays for, leads and so on, as teams with the words of that phrase."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(L.TEAM_OF), F.lit(1)), strip)

    def one(e: Column, ts: Column) -> Column:
        n = F.lower(strip(e["text"]))
        hit = F.get(F.filter(ts, lambda t: F.contains(F.lower(t), n) | F.contains(n, F.lower(t))), F.lit(0))
        return F.when(e["label"].isin(*labels) & hit.isNotNull(), entity(hit, "SPORTS_TEAM")).otherwise(e)

    return let(targets, lambda ts: F.transform(entities, lambda e: one(e, ts)))


def _without_parts(entities: Column) -> Column:
    """Without places that are a word of the longest person's name."""
    persons = F.transform(F.filter(entities, lambda e: e["label"] == "PERSON"), lambda e, i: F.struct(F.length(e["text"]).alias("n"), (-i).alias("i"), e["text"].alias("t")))
    words = F.split(F.lower(F.array_max(persons)["t"]), r"\s+")
    return let(words, lambda ws: F.filter(entities, lambda e: ~F.coalesce(e["label"].isin("LOCATION", "GPE", "ORG") & F.array_contains(ws, F.lower(e["text"])), F.lit(False))))


def extract_entities(text: Column) -> Column:
    """array<struct<text, label>>: names in order, dates, numbers; then a leading person, national teams and competitions.

    What lies in the phrase of a national team or competition is not recognised again.
    """
    t = F.coalesce(text, F.lit(""))
    competition = "(?i)(" + "|".join(L.COMPETITIONS) + ")"
    rest = F.regexp_replace(F.regexp_replace(t, L.NATIONAL_TEAM, " ; "), competition, " ; ")
    phrases = F.transform(F.regexp_extract_all(rest, F.lit(L.PROPER_NOUN), F.lit(1)), lambda p: F.regexp_replace(p, r"(?i)^(?:" + "|".join(L.ARTICLES) + r")\s+", ""))
    names = F.filter(F.transform(phrases, lambda p: entity(p, _label(p))), lambda e: e["label"].isNotNull())
    dates = F.transform(F.regexp_extract_all(rest, F.lit(L.DATE), F.lit(0)), lambda x: entity(x, "DATE"))
    numbers = F.transform(F.regexp_extract_all(rest, F.lit(r"\b\d+(?:\.\d+)?%?"), F.lit(0)), lambda x: entity(x, "NUMBER"))
    teams = F.transform(F.regexp_extract_all(t, F.lit(L.NATIONAL_TEAM), F.lit(0)), lambda x: entity(x, "SPORTS_TEAM"))
    contests = F.transform(F.regexp_extract_all(t, F.lit(competition), F.lit(0)), lambda x: entity(x, "COMPETITION"))
    kept = _as_teams(F.concat(names, dates, numbers), t, ["LOCATION", "ORGANIZATION", "CITY", "COUNTRY", "GPE"])
    return let(F.concat(kept, _leading_person(t), teams, contests), _without_parts)


def alias_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded(c), "[^a-z0-9]+", " "))


def extract_aliases(text: Column) -> Column:
    """array<struct<text, label>>: a leading person, then known aliases, each once by its folded form."""
    t = F.coalesce(text, F.lit(""))
    found = F.array_compact(F.array(*[F.when(F.concat(F.lit(" "), alias_key(t), F.lit(" ")).contains(f" {a} "), entity(F.lit(name), label)) for a, (name, label) in L.ALIASES.items()]))
    every = F.concat(_leading_person(t), found)
    once = F.filter(every, lambda e, i: F.array_position(F.transform(every, lambda x: alias_key(x["text"])), alias_key(e["text"])) == i + 1)
    return once


def link_entities(entities: Column, text: Column) -> Column:
    """array<struct<text, label, title>>: each title once; a name with several meanings goes by its context."""
    low = F.lower(text)

    def title(e: Column) -> Column:
        out = strip(e["text"])
        for name, meanings in L.MEANINGS.items():
            meant = F.lit(meanings[-1][1])
            for word, t in reversed(meanings[:-1]):
                meant = F.when(low.contains(word), t).otherwise(meant)
            out = F.when(F.lower(strip(e["text"])) == name, meant).otherwise(out)
        return out

    linked = F.transform(entities, lambda e: F.struct(strip(e["text"]).alias("text"), e["label"].alias("label"), title(e).alias("title")))
    return let(linked, lambda xs: F.filter(xs, lambda x, i: F.array_position(F.transform(xs, lambda y: F.lower(y["title"])), F.lower(x["title"])) == i + 1))


def by_priority(entities: Column) -> Column:
    """Entities by kind, persons first, and by place among equals."""
    rank = F.lit(99)
    of = lambda e: F.coalesce(*[F.when(e["label"] == label, r) for label, r in L.PRIORITY.items()], rank)
    rows = F.transform(entities, lambda e, i: F.struct(of(e).alias("rank"), i.alias("i"), e["text"].alias("text"), e["label"].alias("label")))
    return F.transform(F.array_sort(rows), lambda x: entity(x["text"], x["label"]))


def searchable(entities: Column) -> Column:
    return F.filter(entities, lambda e: ~e["label"].isin("DATE", "NUMBER"))


def retrieval_terms(claim: Column, entities: Column, most: int = 3) -> Column:
    """What is looked up for a claim: its first searchable entities, each with the person if it is short, then its text."""
    named = searchable(entities)
    person = F.get(F.filter(named, lambda e: e["label"] == "PERSON"), F.lit(0))["text"]
    short = lambda e: person.isNotNull() & (e["text"] != person) & (F.size(F.split(e["text"], r"\s+")) <= 2)
    of = lambda e: F.when(short(e), F.array(e["text"], F.concat_ws(" ", person, e["text"]))).otherwise(F.array(e["text"]))
    terms = F.flatten(F.transform(F.slice(by_priority(named), 1, most), of))
    return F.filter(F.array_distinct(F.concat(terms, F.array(F.regexp_replace(claim, r"[.!?]+$", "")))), lambda t: t != "")


def side_type(c: Column) -> Column:
    """Type of a triple's side from its words."""
    n, w = F.lower(strip(c)), F.split(strip(c), r"\s+")
    capital = F.forall(F.filter(w, lambda x: ~F.lower(x).isin("the", "a", "an", "this", "that", "these", "those", "is", "are", "was", "were")), lambda x: x.rlike(r"^\p{Lu}"))
    out = F.when(F.size(w).isin(2, 3) & capital, "Person").otherwise("General")
    for label, words in (("City", L.CITY_WORDS), ("Country", L.COUNTRY_WORDS), ("Organization", L.ORG_WORDS)):
        out = F.when(_one_of(n, words), label).otherwise(out)
    return F.when(n == "", "General").otherwise(out)


#: Pattern, confidence, and what of it is subject, relation and object.
_OF = (r"(?i)^(?:the\s+)?([a-z0-9\s]+?)\s+of\s+([A-Z][a-zA-Z0-9\s\.\&]+?)(?:\s+is|\s+was|\s+are|\s+were|\s*,|\s*$)\s*(.*)$", 0.95, (2,), (1,), (3,))
_IN = (r"(?i)^([A-Z][a-zA-Z0-9\s\.\&]+?)\s+(is|was|were|are|has\s+been|had\s+been)\s+([a-z0-9\s]+?)\s+(in|by|at|from)\s+([A-Z][a-zA-Z0-9\s\.\&]+)", 0.92, (1,), (3, 4), (5,))
_DOES = (r"^([A-Z][a-zA-Z0-9\s\.\&]+?)\s+([a-z]+ed|[a-z]+s)\s+([A-Z][a-zA-Z0-9\s\.\&]+)", 0.90, (1,), (2,), (3,))
TRIPLES = [_OF, _IN, _DOES]


def triple(text: Column) -> Column:
    """struct(subject, relation, object, subject_type, object_type, confidence) of the first pattern that fits, else null."""
    t = strip(text)
    bare = lambda c: F.regexp_replace(c, r"^[.,!? ]+|[.,!? ]+$", "")
    out = F.lit(None).cast("struct<subject:string,relation:string,object:string,subject_type:string,object_type:string,confidence:double>")
    for pattern, confidence, s, r, o in reversed(TRIPLES):
        part = lambda gs, p=pattern: F.concat_ws(" ", *[strip(F.regexp_extract(t, p, g)) for g in gs])
        obj = F.regexp_replace(bare(part(o)), r"(?i)^(is|was) ", "")
        row = F.struct(bare(part(s)).alias("subject"), part(r).alias("relation"), obj.alias("object"))
        typed = lambda x: F.struct(x["subject"].alias("subject"), x["relation"].alias("relation"), x["object"].alias("object"), side_type(x["subject"]).alias("subject_type"), side_type(x["object"]).alias("object_type"))
        full = let(row, typed).withField("confidence", F.lit(confidence))
        out = F.when(t.rlike(pattern), full).otherwise(out)
    return out


def provenance(claim: Column, entities: Column) -> Column:
    """struct(subject, relation, object): the first person (else entity), the first of a few verbs, and what follows it."""
    person = F.get(F.filter(entities, lambda e: e["label"] == "PERSON"), F.lit(0))["text"]
    subject = F.coalesce(person, F.get(entities, F.lit(0))["text"], F.lit(""))
    verb, obj = F.lit(""), F.lit("")
    for v in reversed(L.PROVENANCE_VERBS):
        at = F.instr(F.lower(claim), v)
        verb = F.when(at > 0, v).otherwise(verb)
        obj = F.when(at > 0, F.regexp_replace(strip(F.substr(claim, at + len(v))), r"[.!?]+$", "")).otherwise(obj)
    return F.struct(subject.alias("subject"), verb.alias("relation"), obj.alias("object"))


def expected_type(query: Column) -> Column:
    """Type of page that a query asks for."""
    q = F.lower(query)
    out = F.lit("GENERIC")
    for label, words in reversed(L.EXPECTED_TYPE):
        out = F.when(_one_of(q, words), label).otherwise(out)
    rel = relation(query)["relation"]
    return F.coalesce(*[F.when(rel == r, t) for r, t in L.RELATION_SUBJECT.items()], out)


def page_type(title: Column, text: Column) -> Column:
    t, e = F.lower(title), F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 500)
    out = F.when(_one_of(e, L.PLACE_WORDS), "LOCATION").otherwise("GENERIC")
    out = F.when(_one_of(e, L.PLANT_WORDS) & ~_one_of(e, L.NOT_PLANT_WORDS), "PLANT_FRUIT_ANIMAL").otherwise(out)
    for label, words in reversed(L.PAGE_TYPE):
        hit = _one_of(e, words) | (_one_of(t, ["inc", "company"]) if label == "ORGANIZATION" else F.lit(False))
        out = F.when(hit, label).otherwise(out)
    return out


def entity_similarity(target: Column, title: Column, text: Column, query: Column | None = None, wanted: Column | None = None) -> Column:
    """How likely a page is about ``target``: 0.98 for its title, less for words in common, 0.15 for another type."""
    t, p, e = F.lower(strip(target)), F.lower(strip(title)), F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 300)
    wanted, got = wanted if wanted is not None else expected_type(query if query is not None else target), page_type(title, text)
    own = F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 2)
    in_title, words = F.split(p, r"\s+"), F.size(own)
    share = F.size(F.filter(own, lambda w: F.array_contains(in_title, w) | F.contains(e, w))) / words
    near = F.when(F.exists(own, lambda w: F.contains(p, w)), F.greatest(F.lit(0.85), share)).when(F.exists(own, lambda w: F.contains(e, w)), F.greatest(F.lit(0.65), share * 0.8)).otherwise(0.20)
    other = (wanted == "ORGANIZATION") & (got != "ORGANIZATION") & ~_one_of(p, ["inc", "company"]) & ~F.contains(e, F.lit("tech"))
    same = F.contains(p, F.concat(t, F.lit(" inc"))) | F.contains(p, F.concat(t, F.lit(" (company)"))) | F.startswith(p, t)
    out = F.when((wanted == "ORGANIZATION") & (got == "PLANT_FRUIT_ANIMAL"), 0.15).when(same, F.when(other, 0.15).otherwise(0.98)).when(words > 0, near).otherwise(0.50)
    return F.when((F.coalesce(t, F.lit("")) == "") | (F.coalesce(p, F.lit("")) == ""), 0.50).otherwise(out)


def query_terms(text: Column) -> Column:
    """Names to look a query up by: the relation's subject and object, its capitalised or longer words together and one by one."""
    bare = lambda c: F.regexp_replace(c, r"""^[.,!?"']+|[.,!?"']+$""", "")
    asked = lambda c: F.lower(c).isin(*L.QUESTION_WORDS)
    rel = relation(text)
    s, o = bare(rel["subject"]), bare(rel["object"])
    some = lambda c, ok: F.when(F.coalesce(ok, F.lit(False)), F.array(c)).otherwise(F.array().cast("array<string>"))
    of_relation = F.concat(some(s, (s != "") & ~asked(s)), some(o, (o != "") & ~asked(o) & ~F.contains(F.lower(s), F.lower(o))))
    caps = F.transform(F.filter(F.split(strip(text), r"\s+"), lambda w: (w.rlike(r"^\p{Lu}") | (F.length(w) > 3)) & ~asked(w)), bare)
    names = F.filter(caps, lambda w: ~F.lower(w).isin(*L.ROLE_NOUNS))
    joined = F.array_join(names, " ")
    firm = _one_of(F.lower(text), ["ceo", "company", "corporate", "president", "revenue", "inc"]) & ~F.contains(F.lower(joined), F.lit("inc"))
    by_name = F.concat(some(F.concat(joined, F.lit(" Inc.")), firm), some(joined, ~asked(joined)), F.filter(names, lambda w: (F.length(w) > 2) & ~asked(w)))
    terms = F.filter(F.array_distinct(F.concat(of_relation, F.when(F.size(names) > 0, by_name).otherwise(F.filter(caps, lambda w: ~asked(w))))), lambda t: ~asked(t))
    return F.when(F.size(terms) > 0, terms).otherwise(F.array(text))


def plain(c: Column) -> Column:
    """Folded letters and digits with single spaces."""
    return F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def accept_fact(similarity: Column, primary: Column, text: Column, least: float = 0.55) -> Column:
    """Whether a fact reinforces a claim: similar enough, and about its first entity (or a region near it), if it has one."""
    t, p = plain(text), plain(primary)
    near = F.lit(False)
    for name, regions in L.RELATED.items():
        near = near | ((p == name) & _one_of(t, [r for r, _ in regions]))
    return (similarity >= least) & (primary.isNull() | ((p != "") & F.contains(t, p)) | near)


def entity_consistency(exact: Column, names: Column, *texts: Column) -> Column:
    """Whether a document is about one of the claim's entities: found by title, or one of them in its texts; without entities it is."""
    t = plain(F.concat_ws(" ", *texts))
    return F.coalesce(exact, F.lit(False)) | (F.coalesce(F.size(names), F.lit(0)) <= 0) | F.exists(names, lambda n: F.contains(t, plain(n)))


def primary_relevance(primary: Column, title: Column, text: Column) -> Column:
    """1 for a document with the claim's first entity, part of it for a region near it, else 0."""
    t, p = plain(F.concat_ws(" ", title, text)), plain(primary)
    out = F.lit(0.0)
    for name, regions in L.RELATED.items():
        for region, value in reversed(regions):
            out = F.when((p == name) & t.contains(region), value).otherwise(out)
    return F.when(primary.isNull(), 0.0).when((p != "") & F.contains(t, p), 1.0).otherwise(out)
