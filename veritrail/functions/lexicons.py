"""Word lists and patterns of the rules. Patterns are matched without regard to case."""

GREETING = [r"^\s*(hi|hello|hey|greetings)\b"]
QUESTION = [r"\?\s*$"]
SUGGESTION = [
    r"^\s*(you (could|should|might|can)|i (recommend|suggest|would recommend))\b",
    r"\b(let me know|feel free to|please note that you)\b",
]
CLOSING = [
    r"^\s*(in conclusion|to summarize|to conclude|overall|thanks|thank you)\b",
    r"^\s*(hope this helps|let me know if)\b",
]
META = [
    r"^\s*(i'?m afraid|i'?m sorry|sorry|unfortunately)\b",
    r"^\s*actually,?\s+(i'?m|i (don'?t|do not)|i'?m not sure)\b",
    r"^\s*(that'?s|this is) (not |in)?correct\b",
    r"^\s*(i (should|must|want to) (note|mention|point out|clarify)|to be clear|to clarify)\b",
    r"^\s*(i (don'?t|do not) (know|think)|i'?m not sure)\b",
    r"^\s*(that|this)\s+(is|'s)\s+(not\s+)?(accurate|correct|true|false|right)\b",
    r"^\s*(yes|no|correct|indeed),?\s+(that|this)\b",
    r"^\s*(there\s+is\s+no\s+(mention|record|evidence)\s+of|according\s+to\s+the\s+(provided\s+)?(information|context|reference|sources?)|in\s+the\s+provided\s+information)\b",
    r"^\s*(based\s+on\s+the\s+(provided\s+)?(text|information|context|reference))\b",
    r"^\s*in\s+the\s+(provided|given)\s+(information|context|reference)\b",
]
FRAGMENT = [r":\s*(\(?\d{1,2}[.):]?|[-*•])?\s*$"]
NON_FACTUAL = [*GREETING, *QUESTION, *SUGGESTION, *CLOSING, *META, *FRAGMENT]

REDUNDANT = r"^\s*(the\s+sport\s+of\s+association\s+football|association\s+football\s+\(soccer\),?\s+not\s+cricket|the\s+term|this\s+means\s+that|in\s+other\s+words)\b"
COMMON_VERB = (
    r"\b(is|are|was|were|be|been|being|plays|played|playing|works|worked|working|has|have|had|having|does|did|done|doing|located|born|served|won|"
    r"competes|compete|represented|joined|known|called|became|belongs|consists|contains|includes|used|created|built|written|directed|produced|lives|lived|"
    r"found|said|stated|showed|shows|indicates|indicated|means|meant|serves|not|no|cannot|could|would|should|runs|ran)\b"
)
LEAD_IN = (
    r"^\s*(i'?m\s+(not\s+)?(aware\s+of|sure\s+of|confident\s+that)(\s+any\s+(information|sources?|evidence)\s+(suggesting|indicating|that\s+suggests|that\s+indicates)?)?|"
    r"i\s+(couldn'?t|cannot|can\s+not)\s+(find|locate)\s+(any\s+)?(reliable\s+)?(information|sources?|records?|evidence)\s+(suggesting|indicating|that\s+suggests|that\s+indicates)?|"
    r"there\s+is\s+no\s+(evidence|record|information)\s+(suggesting|indicating|that\s+suggests|that)?|i\s+(don'?t|do\s+not)\s+(believe|think|know)\s+(that)?)\s*"
)

ASSISTANT_STATE = (
    r"^\s*(i'?m\s+(not\s+)?(confident|sure|certain)|i\s+(don'?t|do\s+not)\s+(know|recall|believe|have)|to\s+my\s+knowledge|as\s+far\s+as\s+i\s+know|as\s+an\s+ai|"
    r"my\s+knowledge\s+base|i\s+cannot\s+verify|i\s+am\s+unable\s+to\s+(confirm|verify))\b"
)
CONVERSATIONAL = (
    r"^\s*(if\s+you\s+(could|can|would)|could\s+you|please\s+(provide|clarify)|feel\s+free\s+to|i'?d\s+be\s+happy\s+to|let\s+me\s+know|hope\s+this\s+helps|"
    r"(that|this)\s+(is|'s)\s+(not\s+)?(accurate|correct|true|false|right)|there\s+is\s+no\s+mention\s+of|according\s+to\s+the\s+(provided\s+)?(information|context|reference|sources?)|"
    r"in\s+the\s+provided\s+information|based\s+on\s+the\s+(provided\s+)?(text|information|context|reference))\b"
)
NEGATIVE_FACT = r"\b(couldn'?t\s+find|cannot\s+find|no\s+(information|record|evidence|data)|does\s+not\s+exist|no\s+such|is\s+not\s+a|was\s+not\s+a|never\s+served|never\s+played)\b"
UNCERTAIN = r"\b(probably|likely|maybe|perhaps|it\s+may\s+be|i\s+think|i\s+believe)\b"

#: Words that do not count as content: of claims, of overlaps, of sentence scores.
STOP_CLAIM = (
    "a an the is are was were be been being and or but if then so as of to in on at by for with about against between into through during before after above below from "
    "up down out off over under again further this that these those it its he she they his her their not no"
).split()
STOP_OVERLAP = "the a an is are was were in on at of and or to for with by that this it".split()
STOP_SCORE = (
    "a an the and or but if because as what which this that these those then just so than such both through about for is of to in it by with from at on was were be been being "
    "have has had do does did also not only"
).split()
ACTION_VERBS = "is was are were formed founded debuted released became served located headquartered born produced created directed governs known".split()
PREDICATES = "formed founded established born debuted created located directed built won".split()
TEMPORAL_PREDICATES = "formed founded established born created debuted".split()

DOMAINS = [["cricket", "cricketer", "batsman", "bowler"], ["football", "footballer", "soccer", "striker", "forward"], ["basketball", "cformatter", "hooper"], ["tennis", "tennis player"]]
NATIONALITIES = [
    ["argentine", "argentina"], ["portuguese", "portugal"], ["french", "france"], ["spanish", "spain"], ["indian", "india"], ["english", "england"], ["german", "germany"],
    ["brazilian", "brazil"], ["south korean", "korean", "south korea"], ["australian", "australia"], ["american", "united states", "usa"],
]
BIOGRAPHY = "football soccer cricket player athlete band group korean korea boy".split()
SYNONYMS = {
    "soccer": ["football", "footballer", "soccer", "player"], "football": ["soccer", "footballer", "football", "player"],
    "accolades": ["awards", "trophies", "honours", "honors", "titles", "accolades"], "awards": ["accolades", "trophies", "honours", "honors", "awards"],
    "greatest": ["best", "greatest", "top", "premier", "legendary", "leading"], "best": ["greatest", "best", "top", "premier", "legendary", "leading"],
    "batsmen": ["batters", "batsman", "batsmen", "cricketer", "batter"], "batters": ["batsmen", "batsman", "batsmen", "cricketer", "batter"],
}

COMPANIES = ["jyp", "sm entertainment", "yg entertainment", "cube", "starship", "big hit", "hybe", "microsoft", "apple", "google", "amazon"]
PERSONS = [
    "steve jobs", "bill gates", "thomas edison", "alexander graham bell", "pablo picasso", "michelangelo", "napoleon bonaparte", "christopher columbus", "nikola tesla", "albert einstein",
    "charles dickens", "william shakespeare", "yuri gagarin", "neil armstrong", "virat kohli", "guido van rossum", "christopher nolan", "alexander fleming", "lionel messi", "steve wozniak",
]
PLACES = {
    "india": "india", "mumbai": "india", "new delhi": "india", "south korea": "korea", "korea": "korea", "seoul": "korea", "germany": "germany", "berlin": "germany", "munich": "germany",
    "france": "france", "paris": "france", "spain": "spain", "madrid": "spain", "nepal": "nepal", "australia": "australia", "sydney": "australia", "usa": "usa", "united states": "usa",
    "new york": "usa", "california": "usa", "egypt": "egypt", "cairo": "egypt", "london": "uk", "uk": "uk", "england": "uk", "japan": "japan", "tokyo": "japan", "canada": "canada",
    "toronto": "canada", "ottawa": "canada", "china": "china", "rome": "italy", "italy": "italy", "brazil": "brazil", "kilimanjaro": "tanzania", "south america": "south_america",
}
ENTITY_RANK = {"PERSON": 0, "ORG": 1, "SPORTS_TEAM": 1, "GPE": 2, "LOC": 2, "EVENT": 3, "PRODUCT": 3, "DATE": 4, "NUMBER": 5}

#: Titles of pages that derive from a subject's own; pages beside the subject.
DERIVATIVE = ["film", "movie", "season", "discography", "album", "list of", "tribute"]
TANGENTIAL = r"(rivalry|[\u2013\-]ronaldo|[\u2013\-]messi|\(\d{4}\s+film\)|national.+team\s+(record|cap|stat))"

#: Names whose kind is known; a longer name that begins with one is of its kind.
KNOWN_ENTITIES = {
    "lamine yamal": "PERSON", "lionel messi": "PERSON", "kylian mbappé": "PERSON", "openai": "ORGANIZATION", "nasa": "ORGANIZATION", "barcelona": "LOCATION", "real madrid": "SPORTS_TEAM",
    "fc barcelona": "SPORTS_TEAM", "paris saint-germain": "SPORTS_TEAM", "psg": "SPORTS_TEAM", "inter miami": "SPORTS_TEAM", "inter miami cf": "SPORTS_TEAM", "manchester united": "SPORTS_TEAM",
    "manchester city": "SPORTS_TEAM",
}
KNOWN_NATIONALITIES = (
    "indian spanish french german american british english italian chinese japanese argentine argentinian brazilian australian canadian african asian european dutch portuguese "
    "russian mexican egyptian"
).split()
KNOWN_COUNTRIES = "india france germany spain brazil argentina china japan canada mexico italy russia egypt nigeria".split()
LONG_COUNTRIES = [
    "united states", "united kingdom", "new zealand", "south africa", "south korea", "north korea", "saudi arabia", "united arab emirates", "czech republic", "sri lanka", "costa rica",
]
REGIONS = ["africa", "asia", "india", "europe", "antarctica", "australia", "north america", "south america", "middle east"]
PLACE_STARTS = "united new south north saudi west east paris".split()
PLACE_ENDS = "states kingdom republic emirates nations union islands city team league airlines corporation inc".split()
TEAM_ENDS = ["FC", "United", "City", "Rovers", "Athletic", "Wanderers"]
COMPETITIONS = ["ligue 1", "ligue 2", "premier league", "la liga", "serie a", "bundesliga", "champions league", "europa league", "major league soccer"]
ARTICLES = "the a an this that these those".split()
_NAME = "[A-ZÀ-Þ][a-zà-ÿA-ZÀ-Þ'-]"
PROPER_NOUN = rf"\b({_NAME}*(?:\s+{_NAME}*)*)"
NATIONAL_TEAM = rf"\b({_NAME}*(?:\s+{_NAME}*)*)\s+national\s+team\b"
LEADING_PERSON = rf"^\s*({_NAME}+(?:\s+{_NAME}+){{1,3}})\s+(?:is|was|are|plays|has|signed|captains|transferred)\b"
TEAM_OF = (
    r"(?i)\b(?:(?:has\s+)?plays?\s+for|(?:has\s+)?played\s+for|signed\s+(?:for|with)|transferred\s+to|manages?|manager\s+of|coach\s+of|captain\s+of|member\s+of|represents?)\s+"
    r"([A-ZÀ-Þ][a-zà-ÿA-ZÀ-Þ' -]+)"
)
DATE = r"(?i)\b(\d{4}|\d{1,2}/\d{1,2}/\d{2,4}|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?)\b"
#: Names by their folded form.
ALIASES = {
    "mbappe": ("Kylian Mbappé", "PERSON"), "kylian mbappe": ("Kylian Mbappé", "PERSON"), "african": ("African", "NATIONALITY"), "asian": ("Asian", "NATIONALITY"),
    "european": ("European", "NATIONALITY"), "american": ("American", "NATIONALITY"), "indian": ("Indian", "NATIONALITY"), "spanish": ("Spanish", "NATIONALITY"),
    "french": ("French", "NATIONALITY"), "german": ("German", "NATIONALITY"), "british": ("British", "NATIONALITY"),
}
#: Of a name with several meanings: words of the context and the title they ask for, the first that occurs; the last is the default.
MEANINGS = {
    "apple": [
        ("tech", "Apple Inc."), ("company", "Apple Inc."), ("iphone", "Apple Inc."), ("jobs", "Apple Inc."), ("wozniak", "Apple Inc."), ("cupertino", "Apple Inc."), ("fruit", "Apple"), ("tree", "Apple"),
        ("music", "Apple Records"), ("records", "Apple Records"), (None, "Apple Inc."),
    ],
    "bts": [("band", "BTS"), ("group", "BTS"), ("k-pop", "BTS"), ("music", "BTS"), (None, "BTS")],
    "amazon": [
        ("river", "Amazon River"), ("rainforest", "Amazon rainforest"), ("company", "Amazon (company)"), ("tech", "Amazon (company)"), ("bezos", "Amazon (company)"), (None, "Amazon (company)"),
    ],
    "mercury": [("planet", "Mercury (planet)"), ("element", "Mercury (element)"), ("car", "Mercury (automobile)"), ("freddie", "Freddie Mercury"), (None, "Mercury (planet)")],
    "python": [
        ("snake", "Python (snake)"), ("language", "Python (programming language)"), ("code", "Python (programming language)"), ("programming", "Python (programming language)"),
        (None, "Python (programming language)"),
    ],
}
PRIORITY = {"PERSON": 0, "ORGANIZATION": 1, "SPORTS_TEAM": 1, "LOCATION": 2, "COUNTRY": 2, "CITY": 2, "EVENT": 3, "PRODUCT": 3, "DATE": 4, "NUMBER": 5}
PROVENANCE_VERBS = ["plays for", "plays as", "is a", "is an", "was a", "was an", "signed with", "signed for", "manages", "transferred to"]
#: Type of a triple's side: words, anywhere in it.
ORG_WORDS = ["inc", "corp", "ltd", "gmbh", "co.", "company", "group", "agency", "organization", "who", "nasa"]
COUNTRY_WORDS = ["germany", "france", "india", "japan", "china", "usa", "uk", "italy", "spain", "canada", "australia"]
CITY_WORDS = ["berlin", "munich", "paris", "tokyo", "london", "seattle", "geneva", "rome", "madrid", "city"]
#: Type of a relation's subject.
RELATION_SUBJECT = {"capital_of": "COUNTRY", "ceo_of": "ORGANIZATION", "president_of": "COUNTRY", "headquarters_of": "ORGANIZATION", "founded_by": "ORGANIZATION"}
#: Type that a query expects, and type of a page by its beginning: words, anywhere, in this order.
EXPECTED_TYPE = [
    ("ORGANIZATION", ["ceo", "company", "corporate", "revenue", "inc", "ltd", "headquartered", "business"]), ("PERSON", ["born", "player", "cricketer", "footballer", "actor", "author", "singer"]),
    ("COUNTRY", ["capital of germany", "capital of france", "capital of india", "country"]), ("CITY", ["capital of", "located in", "city"]),
]
PAGE_TYPE = [
    ("COUNTRY", ["country located", "country in", "sovereign state", "federal republic", "french republic", "republic of", "country of europe", "country of asia"]),
    ("CITY", ["capital of bavaria", "capital and largest city", "capital city", "city in germany", "city in france", "city in us", "commune in france"]),
    ("ORGANIZATION", ["company", "corporation", "multinational", "tech company", "inc", "ltd", "headquartered", "founded in"]),
    ("PERSON", ["born", "player", "politician", "actor", "singer", "author", "he is", "she is"]),
]
PLANT_WORDS = ["edible fruit", "botanical species", "flowering plant", "genus of", "snake species", "reptile"]
NOT_PLANT_WORDS = ["country", "republic", "state", "city", "company"]
PLACE_WORDS = ["region", "territory", "mountain", "river", "sea", "ocean"]
QUESTION_WORDS = "what who where when how which why from that this is are was were the".split()
ROLE_NOUNS = [
    "ceo", "chief executive officer", "president", "prime minister", "captain", "manager", "director", "founder", "author", "head", "chairman", "leader", "coach", "governor", "minister",
    "vice president", "executive",
]
#: Regions near a name that count in part.
RELATED = {"india": [("south asia", 0.7), ("asia", 0.5)]}
#: Regions that tell a user's claim from a fact; sentences that are talk; the subject of a sentence; denials, and something else offered instead.
CONFLICT_REGIONS = ["african", "africa", "asian", "asia", "european", "europe", "south asia"]
TALK = (
    r"^\s*(?:i(?:'m| am)\s+afraid\s+that(?:'s| is)?\s+not\s+correct|that(?:'s| is)\s+not\s+accurate|that(?:'s| is)\s+incorrect|i\s+think|in\s+my\s+opinion|however|therefore|overall|"
    r"it(?:'s| is)\s+worth\s+noting|if\s+you\s+have\s+any\s+questions|is\s+there\s+anything\s+else\s+i\s+can\s+help\s+clarify|would\s+you\s+like\s+more\s+information|"
    r"i(?:'d| would)\s+be\s+happy\s+to\s+help|feel\s+free\s+to\s+ask)\b"
)
SUBJECT = r"^([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,3})\s+(?:is|are|was|were|has|have|had|located)\b"
DENIAL = r"\b(couldn'?t find|could not find|no information|not aware of|don'?t have (?:any )?information|unable to find)\b"
ALTERNATIVE = r"(?is)(couldn'?t find|could not find|no information).{0,300}?(however|but|instead|alternatively).{0,60}?\bfound\b"
STANCE = (
    r"(?i)^\s*(?:that(?:'s| is)\s+not(?:\s+entirely)?\s+accurate|that(?:'s| is)\s+not\s+entirely\s+correct|i\s+think(?:\s+that)?|however|it(?:'s| is)\s+worth\s+noting(?:\s+that)?|"
    r"it(?:'s| is)\s+possible\s+that|while|if|in\s+my\s+opinion|overall|therefore|thus)\b[,:\s]*"
)
