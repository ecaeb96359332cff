"""View of people and companies over ``customer``: claims, evidence pages and answers about them.

The sentences use the rules' own words, so that each rule has rows it hits and rows it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .registry import table

FIRST = ["Anna", "Boris", "Clara", "David", "Elena", "Felix", "Greta", "Hugo"]
LAST = ["Abbott", "Becker", "Castro", "Dupont", "Eriksen", "Fischer", "Garcia", "Hansen", "Ivanov"]
FIRM = ["Nordwind", "Acme", "Bluestone", "Orchard", "Vertex"]
FORM = [" Inc", " Group", " Holdings"]
PLACE = ["France", "Germany", "Spain", "India", "Brazil", "South Korea"]
TEAM = ["Harbor City", "Red Rovers", "Alpine United", "Coastal FC", "Iron Wanderers", "Barcelona"]

_COLUMNS = ["k", "person", "company", "place", "other", "team", "former", "year"]


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, person, company, place, other (another place), team, former (another team), year: one row a customer."""
    c = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k")
    k = F.col("k")
    return c.select(
        "k", F.concat(pick(FIRST, k), F.lit(" "), pick(LAST, F.floor(k / 8))).alias("person"), F.concat(pick(FIRM, k), pick(FORM, F.floor(k / 5))).alias("company"),
        pick(PLACE, F.col("c_nationkey")).alias("place"), pick(PLACE, F.col("c_nationkey") + 1).alias("other"),
        pick(TEAM, k).alias("team"), pick(TEAM, k + 1).alias("former"), (1950 + k % 70).cast("string").alias("year"),
    )


_of = lambda xs, at: "[" + ", ".join(f"'{x}'" for x in xs) + f"][(({at}) % {len(xs)} + 1)::INT]"
PEOPLE = f"""ppl AS (SELECT c_custkey AS k, {_of(FIRST, 'c_custkey')} || ' ' || {_of(LAST, 'c_custkey // 8')} AS person, {_of(FIRM, 'c_custkey')} || {_of(FORM, 'c_custkey // 5')} AS company,
  {_of(PLACE, 'c_nationkey')} AS place, {_of(PLACE, 'c_nationkey + 1')} AS other, {_of(TEAM, 'c_custkey')} AS team, {_of(TEAM, 'c_custkey + 1')} AS former, (1950 + c_custkey % 70)::VARCHAR AS year
  FROM customer)"""


def _text(*parts: str) -> Column:
    """Columns by name, other strings as they are."""
    return F.concat(*[F.col(p) if p in _COLUMNS else F.lit(p) for p in parts])


def _sql(*parts: str) -> str:
    return " || ".join(p if p in _COLUMNS else "'" + p.replace("'", "''") + "'" for p in parts)


_CEO, _PLAYS = ("person", " is the CEO of ", "company", "."), ("person", " plays for ", "team", ".")
_BASED = ("company", " is headquartered in ", "place", ".")
#: Alternatives of each claim of a response, by k: (every so many rows, parts), the last for the rest.
CLAIMS = [
    [(4, ("The CEO of ", "company", " is ", "person", ".")), (1, _CEO)],
    [(3, ("company", " is headquartered in ", "other", ".")), (1, _BASED)],
    [(4, ("person", " plays for ", "former", ".")), (5, ("person", " is not a singer.")), (1, _PLAYS)],
    [(5, ("person", " has never played cricket.")), (7, ("person", " is a cricketer.")), (1, ("It was founded in ", "year", "."))],
]
_PERSON_PAGE = ("person", " is a footballer from ", "place", ". ", "person", " plays for ", "team", ". He previously played for ", "former", " in 2019. He is not a painter.")
_COMPANY_PAGE = ("company", " is a company headquartered in ", "place", ". It was founded in ", "year", ". ", "person", " is the CEO of ", "company", ". The firm employs 250 people.")
_NOISE_PAGE = ("Harbor news lists a warehouse and a carrier near the river in ", "other", ".")
#: title, text, source, score of each page.
PAGES = [(("person",), _PERSON_PAGE, "Wikipedia", 0.9), (("company",), _COMPANY_PAGE, "FEVER", 0.7), (("Harbor news (disambiguation)",), _NOISE_PAGE, "other", 0.2)]
#: Answers about a person, by k.
ANSWERS = [
    (6, ("I couldn't find any information about ", "person", ".")),
    (5, ("I couldn't find any information about ", "person", ". He is a footballer.")),
    (4, ("I couldn't find any information about ", "person", ". However, I found Mira Novak, a singer. Mira Novak is a singer.")),
    (1, ("Well, ", "person", " plays for ", "team", ". ", "company", " is a firm. It is actually a separate firm in ", "place", ". I think that is all. It was founded in ", "year", ".")),
]


def _either(cases) -> Column:
    out = _text(*cases[-1][1])
    for n, parts in reversed(cases[:-1]):
        out = F.when(F.col("k") % n == 0, _text(*parts)).otherwise(out)
    return out


def _sql_either(cases) -> str:
    return "CASE " + " ".join(f"WHEN k % {n} = 0 THEN {_sql(*parts)}" for n, parts in cases[:-1]) + f" ELSE {_sql(*cases[-1][1])} END"


def claims(ppl: DataFrame) -> DataFrame:
    """claim_id, response_id, pos, text, k, person, company, team, place: four claims a person."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), _either(c).alias("text")) for i, c in enumerate(CLAIMS)])
    kept = ["k", "person", "company", "team", "place"]
    each = ppl.select(*kept, F.explode(rows).alias("c"))
    return each.select(F.concat_ws("-", "k", "c.pos").alias("claim_id"), F.concat(F.lit("P"), "k").alias("response_id"), "c.*", *kept)


def pages(ppl: DataFrame) -> DataFrame:
    """page_id, k, n, title, text, source, score: three pages a person; every seventh person has none."""
    rows = F.array(*[F.struct(F.lit(i).alias("n"), _text(*t).alias("title"), _text(*x).alias("text"), F.lit(s).alias("source"), F.lit(r).alias("score")) for i, (t, x, s, r) in enumerate(PAGES)])
    return ppl.where("k % 7 <> 0").select("k", F.explode(rows).alias("p")).select(F.concat_ws("-", "k", "p.n").alias("page_id"), "k", "p.*")


def answers(ppl: DataFrame) -> DataFrame:
    """response_id, k, person, query, response."""
    return ppl.select(F.concat(F.lit("P"), "k").alias("response_id"), "k", "person", _text("Who is ", "person", "?").alias("query"), _either(ANSWERS).alias("response"))


P_CLAIMS = "pcl AS (" + " UNION ALL ".join(f"SELECT k || '-{i}' AS claim_id, 'P' || k AS response_id, {i} AS pos, {_sql_either(c)} AS text, k, person, company, team, place FROM ppl" for i, c in enumerate(CLAIMS)) + ")"
P_PAGES = "ppg AS (" + " UNION ALL ".join(f"SELECT k || '-{i}' AS page_id, k, {i} AS n, {_sql(*t)} AS title, {_sql(*x)} AS text, '{s}' AS source, {r}::DOUBLE AS score FROM ppl WHERE k % 7 <> 0" for i, (t, x, s, r) in enumerate(PAGES)) + ")"
P_ANSWERS = f"pan AS (SELECT 'P' || k AS response_id, k, person, {_sql('Who is ', 'person', '?')} AS query, {_sql_either(ANSWERS)} AS response FROM ppl)"
PROFILES = f"{PEOPLE}, {P_CLAIMS}, {P_PAGES}, {P_ANSWERS}"


# --- claims whose words and whose evidence's words are drawn apart, so that rules hit some of each kind and miss others ---
_WHO, _FIRMS, _FROM = ["Bill Gates", "Nikola Tesla", "Neil Armstrong", "Virat Kohli", "Albert Einstein"], ["Microsoft", "Google", "Apple", "Amazon"], ["Indian", "Spanish", "German", "French"]
_FIELD = ["cricketer", "footballer", "tennis player", "singer"]
_ODD = [
    ("Photosynthesis absorbs oxygen.", "Photosynthesis absorbs carbon dioxide."), ("The currency of the United Kingdom is the euro.", "The pound sterling is its currency."), ("The heart is the largest organ.", "The skin is the largest organ."),
    ("The number 1 is the smallest prime number.", "The smallest prime number is 2."), ("The wall is visible from the moon with the naked eye.", "It is not visible from there."), ("The wall is visible from space.", "That is a myth."),
]
#: Of each kind of case: parts of the claim and of the evidence; (list, n) picks by k // n.
_CASES = [
    (((_FIRMS, 7), " was founded by ", (_WHO, 14), "."), ((_FIRMS, 21), " is a company. It was created by ", (_WHO, 35), ".")),
    (((_WHO, 7), " invented the engine."), ("In 1900 ", (_WHO, 14), " discovered a law.")),
    ((([c for c, _ in _ODD], 7),), (([e for _, e in _ODD], 28),)),
    (((_WHO, 7), " was not born in Paris."), ((_WHO, 7), (["was born in Paris in 1901.", "has never been to Paris.", "lives in Rome."], 14))),
    (((_WHO, 7), (["was never a ", "is a ", "is not a "], 21), (_FIELD, 14), "."), ((_WHO, 35), " is a ", (_FIELD, 42), " and a player.")),
    (((_WHO, 7), " is an ", (_FROM, 14), " singer."), ((_WHO, 28), " is a ", (_FROM, 21), " singer. This is ", (["not a painter.", "a painter."], 7))),
    (((_WHO, 7), (["never played ", "plays "], 14), (["cricket", "football", "tennis"], 21), "."), ("It is false that ", (_WHO, 14), " sings. ", (_WHO, 7), " plays ", (["cricket", "football", "tennis"], 28), ".")),
]


def _drawn(parts) -> Column:
    out = [F.lit(p) if isinstance(p, str) else F.concat(F.lit(" "), pick(p[0], F.floor(F.col("k") / p[1]))) if p[0][0][0].islower() else pick(p[0], F.floor(F.col("k") / p[1])) for p in parts]
    return F.concat(*out)


def _sql_drawn(parts) -> str:
    one = lambda p: "'" + p.replace("'", "''") + "'" if isinstance(p, str) else ("' ' || " if p[0][0][0].islower() else "") + _of(p[0], f"k // {p[1]}")
    return " || ".join(map(one, parts))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, text, texts: a claim a customer and the texts of its evidence; every ninth has a second text, every eleventh none."""
    k = F.col("k")
    kind = (k % len(_CASES)).cast("int")
    said = F.element_at(F.array(*[_drawn(c) for c, _ in _CASES]), kind + 1)
    found = F.element_at(F.array(*[_drawn(e) for _, e in _CASES]), kind + 1)
    both = F.when(k % 9 == 0, F.array(F.lit("Harbor news lists a warehouse."), found)).otherwise(F.array(found))
    c = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")
    return c.select(F.concat(F.lit("K"), "k").alias("claim_id"), said.alias("text"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(both).alias("texts"))


CASES = f"""kc AS (SELECT c_custkey AS k FROM customer), kd AS (SELECT k, [{', '.join(_sql_drawn(c) for c, _ in _CASES)}][(k % {len(_CASES)} + 1)::INT] AS text, [{', '.join(_sql_drawn(e) for _, e in _CASES)}][(k % {len(_CASES)} + 1)::INT] AS found FROM kc),
cases AS (SELECT 'K' || k AS claim_id, text, CASE WHEN k % 11 = 0 THEN []::VARCHAR[] WHEN k % 9 = 0 THEN ['Harbor news lists a warehouse.', found] ELSE [found] END AS texts FROM kd)"""
