"""One sentence out of an answer's supported claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Sentences about the source are left out; first words that begin no subject; small words within names; verbs that end a subject.
ABOUT_SOURCE = ["reference information", "provided information", "according to", "there is no mention", "that is not accurate", "the reference"]
NO_SUBJECT = "the there according this that in based it".split()
NAME_WORDS = "de da von van".split()
VERBS = "is was are plays has captains signed represented".split()


def _once(a: Column) -> Column:
    """Each text once, whatever its case; the first stays."""
    return F.filter(a, lambda x, i: F.array_position(F.transform(a, F.lower), F.lower(x)) == i + 1)


def clean_sentence(c: Column) -> Column:
    """Stripped, with a capital, without the marks at its end."""
    s = F.regexp_replace(strip(c), r"[.!?]+$", "")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def subject_prefix(sentence: Column) -> Column:
    """The capitalised words before the verb; empty where the sentence begins with no name."""
    words = F.transform(F.filter(F.split(sentence, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"[.!?,]+$", ""))
    named = lambda w: (w != "") & ~w.isin(*VERBS) & (w.rlike(r"^\p{Lu}") | w.isin(*NAME_WORDS))
    ends = F.filter(F.transform(words, lambda w, i: F.when(~named(w), i)), lambda i: i.isNotNull())
    upto = F.coalesce(F.get(ends, F.lit(0)), F.size(words))
    return F.when(F.lower(F.get(words, F.lit(0))).isin(*NO_SUBJECT), "").otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(upto, F.lit(0))), " "))


def _rest(s: Column, subjects: Column, main: Column) -> Column:
    """A sentence without its subject: the first of the subjects that it begins with, or the main one."""
    own = F.get(F.filter(subjects, lambda x: F.startswith(s, x)), F.lit(0))
    lead = F.coalesce(own, F.when((main != "") & F.startswith(s, main), main), F.lit(""))
    return strip(F.substr(s, F.length(lead) + 1))


def merged_claims(claims: Column) -> Column:
    """One sentence that says what the supported claims (array of texts) say of their longest subject; null without any."""
    about = lambda s: F.exists(F.array(*map(F.lit, ABOUT_SOURCE)), lambda p: F.contains(F.lower(s), p))
    clean = F.filter(F.transform(claims, clean_sentence), lambda s: (s != "") & ~about(s))

    def told(x: Column) -> Column:
        rest, main = x["rest"], x["main"]
        low = lambda r: F.lower(r)
        after = lambda p: F.transform(F.filter(rest, lambda r: F.startswith(low(r), F.lit(p))), lambda r: strip(F.substr(r, F.lit(len(p) + 1))))
        full = lambda a: F.transform(a, lambda t: F.when(F.lower(t) == "barcelona", "FC Barcelona").otherwise(t))
        states = _once(F.filter(rest, lambda r: low(r).rlike("^(is|was|are) ")))
        roles = _once(after("plays as "))
        plays = F.flatten(F.filter(F.transform(rest, lambda r: F.when(low(r).startswith("plays for "), full(F.array(strip(F.substr(r, F.lit(11)))))).when(low(r).startswith("has played for "), full(F.array(strip(F.substr(r, F.lit(16)))))).when(low(r).startswith("plays ") & ~low(r).startswith("plays as "), F.array(strip(F.substr(r, F.lit(7)))))), lambda a: a.isNotNull()))
        plays = _once(plays)
        leads = _once(F.transform(after("captains "), lambda t: F.regexp_replace(t, "(?i)^both ", "")))
        others = F.filter(rest, lambda r: ~low(r).rlike("^(is|was|are|plays|captains) ") & ~low(r).startswith("has played for ") & (F.size(F.split(r, r"\s+")) >= 2))
        return F.struct(main.alias("main"), states.alias("states"), roles.alias("roles"), plays.alias("plays"), leads.alias("leads"), others.alias("others"))

    def said(x: Column) -> Column:
        joined = lambda a: F.array_join(a, " and ")
        text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
        main, states, roles, plays, leads = (x[n] for n in ("main", "states", "roles", "plays", "leads"))
        teams = _once(F.concat(plays, leads))
        some = lambda a: F.size(a) > 0
        several = lambda a: F.when(F.size(a) >= 2, text("captains both ", joined(a))).otherwise(text("captains ", joined(a)))
        clause = (
            F.when(some(roles) & some(leads) & some(plays), text("plays as ", joined(roles), " for and captains ", joined(teams)))
            .when(some(roles) & some(leads), text("plays as ", joined(roles), " and captains ", joined(teams)))
            .when(some(roles) & some(plays), text("plays as ", joined(roles), " for ", joined(teams)))
            .when(some(roles), text("plays as ", joined(roles)))
            .when(some(leads) & some(plays), several(teams))
            .when(some(leads), several(leads))
            .when(some(plays), text("plays for ", joined(plays)))
        )
        clauses = F.concat(F.when(clause.isNotNull(), F.array(clause)).otherwise(F.array().cast("array<string>")), x["others"])
        head = F.when(some(states), F.when(main != "", text(main, " ", joined(states))).otherwise(joined(states))).when(main != "", main)
        return text(F.concat_ws(" ", head, F.when(F.size(clauses) > 0, text("who ", joined(clauses)))), ".")

    def whole(ss: Column) -> Column:
        subjects = F.filter(F.transform(ss, subject_prefix), lambda x: x != "")
        longest = F.array_max(F.transform(subjects, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
        main = F.coalesce(longest, F.lit(""))
        rest = let(F.struct(subjects.alias("s"), main.alias("m")), lambda y: F.struct(F.transform(ss, lambda s: _rest(s, y["s"], y["m"])).alias("rest"), y["m"].alias("main")))
        return F.when(F.size(ss) > 0, let(let(rest, told), said))

    return let(clean, whole)
