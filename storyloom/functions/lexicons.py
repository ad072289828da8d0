"""Default lexicons. Operators take them as arguments; nothing here depends on data.

Fixed values: these word lists decide results, so they are stated as they are.
"""

from __future__ import annotations

STOPWORDS = "a an the and or but for nor so yet to of in on with at by from as is are was were be been being this that these those it its into over after before about new report reports".split()

TOKEN_ALIASES = {"lausd": ["los", "angel", "unifi", "school", "district"], "la": ["los", "angel"], "supe": ["superintendent"]}

#: Canonical token -> its forms.
CANONICAL_FORMS = {
    "lawsuit": "sue sues sued suing lawsuit lawsuits filed filing challenge challenges challenged",
    "closure": "close closes closed closing closure closures",
    "vote": "vote votes voted voting approve approves approved",
    "raid": "raid raids raided warrant warrants",
    "investigation": "probe probes investigated investigation investigations",
    "ruling": "block blocks blocked find finds found side sides sided rule rules ruled ruling decide decides decided decision decisions uphold upholds upheld overturn overturns overturned strike strikes struck",
}
ACTION_TOKENS = "lawsuit closure vote raid investigation ruling strike ban funding budget layoff leave".split()
GENERIC_TOKENS = "school district student teacher parent public charter education policy state union supreme court board law bill legislation program plan system official".split()

#: The same for tokens of what is displayed.
TOPIC_STOPWORDS = "the and for with from this that into over under after before about amid amidst will would could should what why how says say report reports latest update updates school schools district districts board boards education educator educators teacher teachers student students public official officials plan plans bill bills lawmakers legislature session union unions state states".split()
TOPIC_FORMS = {
    "lawsuit": "sue sues sued suing lawsuit lawsuits filed filing challenge challenges challenged challenging",
    "closure": "close closes closed closing closure closures shutdown shutdowns shut shuts",
    "vote": "vote votes voted voting approve approves approved approval",
    "funding": "fund funds funded funding finance financial",
    "raid": "raid raids raided warrant warrants",
    "investigation": "probe probes investigated investigation investigations inquiry inquiries",
}
TOPIC_ACTIONS = "lawsuit closure vote raid investigation strike ban funding budget layoff leave".split()
TOPIC_GENERIC = "school district student teacher parent public charter education policy state union board law bill legislation program plan system official".split()
NOVELTY_HINTS = ["new details", "developing", "latest", "breaking", "now", "names acting", "appoints", "approved", "passes", "settlement", "charged", "indicted", "resigns", "steps down"]
#: Words that say nothing of what an article covers.
COVERAGE_STOPWORDS = "a an and are as at be by for from how in is it new of on or over report reports says school schools student students teacher teachers the this to was what when where why will with".split()
SUMMARY_STOPWORDS = "that this with from which their there about after before under over into while where when".split()

IMPACT = "legislation bill policy funding budget superintendent district statewide board mandate".split()
URGENCY = "emergency closure lockdown safety security threat shooting outbreak urgent".split()
NOVELTY = "pilot launch new first rollout initiative program expansion".split()
RELEVANCE = "teacher students classroom curriculum school k-12 k12 principal edtech".split()
POLICY = "policy bill law mandate regulation funding budget board superintendent federal state".split()
BREAKING = ["breaking", "just announced", "emergency", "court blocks", "lawsuit", "injunction", "passes house", "passes senate", "signed into law", "state of emergency", "closure"]
OPINION = ["opinion", "op-ed", "analysis", "commentary", "essay", "guest column", "letter to the editor"]
EVERGREEN = ["how to", "guide", "tips", "checklist", "strategies", "lesson plan", "best practices", "classroom management", "worksheets", "activities", "explainer"]
INSTRUCTIONAL = ["teaching", "classroom", "lesson", "student engagement", "instructional", "activity", "activities", "professional development", "how educators", "for teachers"]

TEACHERS = ["teacher", "teachers", "classroom", "instruction", "curriculum", "lesson", "professional development", "literacy", "math", "student learning"]
ADMINS = ["superintendent", "principal", "district", "school board", "budget", "funding", "policy", "state", "accountability", "compliance"]
EDTECH_EXPLICIT = ["edtech", "education technology", "student data privacy", "school cybersecurity", "learning management system", "digital learning", "technology procurement"]
EDTECH_TECH = ["ai", "artificial intelligence", "chatbot", "software", "platform", "cybersecurity", "privacy", "screen time", "device", "devices", "technology", "tech", "digital", "lms"]
EDTECH_CONTEXT = "school schools district districts student students teacher teachers classroom classrooms k-12 curriculum instruction superintendent".split()
HIGHER_ED = ["college", "colleges", "university", "universities", "community college", "community colleges", "campus", "campuses", "higher ed", "higher education"]
K12_OVERRIDE = ["school", "schools", "teacher", "teachers", "classroom", "classrooms", "public school", "k-12", "elementary school", "middle school", "high school"]
LANE_POLICY = "bill law lawsuit funding budget board regulation state federal court mandate".split()

FAMILY_ALIASES = {"apnews.com": "associated-press", "reuters.com": "reuters"}
MULTIPART_SUFFIXES = ["co.uk", "org.uk", "com.au", "co.nz", "k12.ca.us"]
AGGREGATORS = ["apple.news", "aol.com", "finance.yahoo.com", "flipboard.com", "ground.news", "msn.com", "news.google.com", "newsbreak.com", "smartnews.com", "yahoo.com"]

#: Lexicon for the driver's invented prose: frequent words stand for the classes that the default lists seldom hit there.
DATA = {
    "impact": ["tion", "with", "that"],
    "urgency": ["leur", "nicht", "onth"],
    "novelty": ["que", "ing"],
    "relevance": ["the", "und", "les"],
    "policy": ["ent", "sch"],
    "breaking": ["thth", "einber"],
    "opinion": ["êê", "ßß"],
    "evergreen": ["edble", "ciónra"],
    "instructional": ["hahe", "oumen"],
    "actions": ["onnd", "thth", "stst", "inth", "eror", "erth"],
    "generic": ["the", "and", "est", "les", "und", "der", "die", "que", "dan", "for", "this"],
    "teachers": ["tion", "was"],
    "admins": ["with", "des"],
    "states": [["north", "the and"], ["south", "of the"], ["west", "in the"], ["east", "que la"], ["mid", "und der"]],
}


#: States of the US with their aliases, in the order in which they are tried.
STATES = [
    ["alabama", "alabama"], ["alaska", "alaska"], ["arizona", "arizona", "phoenix"], ["arkansas", "arkansas"], ["california", "california", "los angeles", "lausd", "oakland", "sacramento", "san diego", "san francisco"], ["colorado", "colorado", "denver"],
    ["connecticut", "connecticut"], ["delaware", "delaware"], ["florida", "florida", "miami", "orlando", "tampa"], ["georgia", "georgia", "atlanta"], ["hawaii", "hawaii"], ["idaho", "idaho"], ["illinois", "illinois", "chicago", "cps"], ["indiana", "indiana", "indianapolis", "indy"],
    ["iowa", "iowa"], ["kansas", "kansas"], ["kentucky", "kentucky"], ["louisiana", "louisiana", "new orleans"], ["maine", "maine"], ["maryland", "maryland", "baltimore"], ["massachusetts", "massachusetts", "boston"], ["michigan", "michigan", "detroit"],
    ["minnesota", "minnesota", "minneapolis", "st paul"], ["mississippi", "mississippi"], ["missouri", "missouri", "st louis", "kansas city"], ["montana", "montana"], ["nebraska", "nebraska"], ["nevada", "nevada", "las vegas"], ["new hampshire", "new hampshire"], ["new jersey", "new jersey", "newark"],
    ["new mexico", "new mexico"], ["new york", "new york", "new york city", "nyc", "brooklyn", "bronx", "queens"], ["north carolina", "north carolina", "charlotte", "raleigh"], ["north dakota", "north dakota"], ["ohio", "ohio", "columbus", "cleveland", "cincinnati"], ["oklahoma", "oklahoma"],
    ["oregon", "oregon", "portland"], ["pennsylvania", "pennsylvania", "philadelphia", "philly", "pittsburgh"], ["rhode island", "rhode island"], ["south carolina", "south carolina"], ["south dakota", "south dakota"], ["tennessee", "tennessee", "memphis", "nashville"],
    ["texas", "texas", "houston", "dallas", "austin", "san antonio"], ["utah", "utah"], ["vermont", "vermont"], ["virginia", "virginia", "richmond"], ["washington", "washington state", "seattle"], ["west virginia", "west virginia"], ["wisconsin", "wisconsin", "milwaukee"], ["wyoming", "wyoming"],
    ["district of columbia", "district of columbia", "washington dc", "washington d c", "dc"],
]

#: Topics by the first pattern that hits, in this order.
TOPICS = [
    ("immigration", r"\b(immigration|immigrant|immigrants|migrant|migrants|ice|deport|deportation|undocumented|enforcement)\b"), ("closure", r"\b(closure|close|closed|closing|shutdown)\b"),
    ("lawsuit", r"\b(lawsuit|sue|sues|sued|suing|court|judge|legal|litigation)\b"), ("funding", r"\b(funding|budget|deficit|cuts?|tax|taxes|finance|financial)\b"), ("governance", r"\b(board|vote|voting|election|policy|bill|law|legislation|lawmakers)\b"),
    ("safety", r"\b(safety|security|threat|violence|shooting|weapon)\b"), ("curriculum", r"\b(curriculum|instruction|reading|math|science|assessment|testing)\b"),
]

#: Words that name no entity though they are written like names.
ENTITY_STOPWORDS = "school schools district districts student students teacher teachers state states board boards education public official officials families parents parent lawsuit investigation closure vote funding budget policy bill bills union unions house senate legislature legislative session news report reports amid after before over new latest".split()
