"""Default patterns for quality and topic rules, valid in Java and in RE2 alike. Operators take them as arguments.

Fixed values: these expressions decide results, so they are stated as they are.
"""

from __future__ import annotations

NON_STORY_TITLE = (
    r"(?i)^(privacy policy([,:-].*)?|terms( of (service|use|services|conditions))?|cookie policy|work with us|about us|contact us|sitemap|(all )?topics|grade levels?|north america|politics\s*&\s*policy"
    r"|(the\s+)?state of the union|(pre[-\s]?k|pk|k|\d{1,2})\s*-\s*\d{1,2}\s+(primary|elementary|middle|high)\s+school)$"
)
NON_STORY_SHORT = r"(?i)^(privacy policy\b|terms of (service|use|services|conditions)\b)"
NON_STORY_PATH = r"(?i)/(privacy(-policy)?|terms(-of-(service|use|services|conditions))?|cookie(-policy)?|work-with-us|about-us|contact-us|sitemap|tags?)(/|$|\.)|/grade-level(/|-|$|\.)"
REJECT_TITLE = r"(?i)\bslug\s*permalinkurl\b|\bcharacters?\s+or\s+less\b|^untitled$|^from\s+|^(news|opinion|podcast|video)\s*\|"

NON_ARTICLE_PATH = r"(?i)/(profiles?|authors?|about|bio|people|person|team|experts?|staff|events?|tags?|category|topics?|search)(/|$)"
ARTICLE_PATH = r"(?i)/(news|articles?|story|[12][0-9]{3}/[01]?[0-9])(/|$)"
BIOGRAPHY = r"(?i)\b(with over \d+ years of experience|i have served|i was a|nonresident fellow|founder and principal|about the author|this biography)\b"
PROMOTION = r"(?i)\b(subscribe|newsletter|republish|sponsored|partner content)\b"
SECTION_TITLE = r"(?i)^from\s+[a-z]|^(latest|breaking)\s+news\b|^(news|opinion|podcast|video)\s*\|\s*[a-z]"
PERSON_NAME = r"^[A-Z][A-Za-z'-]+(\s+[A-Z][A-Za-z'-]+){1,2}$"
SECTION_SEGMENTS = "news latest topics topic opinion video podcast events national newyork philadelphia tennessee colorado".split()
PERSONAL = [
    r"(?i)\b(my classroom|my students|my school|in my class)\b",
    r"(?i)\b(I teach|I use|I created|I started|I love|I decided|I tried)\b",
    r"(?i)\b(here are \d+ ways|tips for teachers|how I)\b",
    r"(?i)\brunning (a|your|student) .*\bclub\b",
    r"(?i)\b(teacher tip|classroom hack|lesson idea|activity idea)\b",
    r"(?i)\b(give feedback|share your thoughts|take our survey|join us|sign up for)\b",
]

#: What a text in lower case has where one of these patterns matches, and the patterns with it: each is tried only there.
GUARDED = {
    BIOGRAPHY: ["years of experience", "i have served", "i was a", "nonresident fellow", "founder and principal", "about the author", "this biography"],
    PROMOTION: ["subscribe", "newsletter", "republish", "sponsored", "partner content"],
    PERSONAL[0]: ["my classroom", "my students", "my school", "in my class"],
    PERSONAL[1]: ["i teach", "i use", "i created", "i started", "i love", "i decided", "i tried"],
    PERSONAL[2]: ["here are ", "tips for teachers", "how i"],
    PERSONAL[3]: ["running "],
    PERSONAL[4]: ["teacher tip", "classroom hack", "lesson idea", "activity idea"],
    PERSONAL[5]: ["give feedback", "share your thoughts", "take our survey", "join us", "sign up for"],
}

JOB_URL = r"(?i)/jobs/|/careers/|://jobs\."
JOB_TITLE = r"(?i)^job:|job opening|now hiring"
PROFILE_URL = r"(?i)/(profiles?|authors?|about|bio|people|person|team|experts?)/"
SECTION_URL = r"(?i)https?://[^/]+/[a-z]{2,24}/?$"
WIRE_TITLE = r"(?i)^(brookings metro|the hamilton project|home|about|projects?)$|\bslug\s*permalinkurl\b|\bcharacters?\s+or\s+less\b|^from\s+"
SOCIAL = ["facebook.com", "instagram.com", "linkedin.com", "reddit.com", "threads.net", "tiktok.com", "twitter.com", "x.com", "youtube.com"]

TOPIC = {
    "explicit": r"(?i)\b(k-?12|pre-?k|public schools?|school districts?|district schools?|school boards?|superintendents?|elementary schools?|middle schools?|high schools?|charter schools?|board of education|department of education|dept\.?\s+of education|state education agency)\b",
    "strong": [
        r"(?i)\b(classrooms?|curriculum|literacy|attendance|absenteeism|assessment|special education|students? with disabilities|english learners?|graduation rates?|school safety|weapons detection|school meals?|school breakfast|school lunch|school supplies|vouchers?|esa|teacher pay|teacher shortage|student data privacy|school cybersecurity|edtech|education technology)\b",
        r"(?i)\b(school principals?|school closures?|school reopening|school accountability|school funding|district budget|district operations|curriculum adoption|teacher pipeline|principal pipeline)\b",
        r"(?i)\b(ai in education|ai in classrooms?|digital learning|instructional materials?)\b",
    ],
    "who": r"(schools?|districts?|classrooms?|students?|teachers?)",
    "what": r"(board|budget|funding|policy|law|lawsuit|curriculum|assessment|accountability|attendance|absenteeism|literacy|math|meal|safety|superintendent|voucher|special education|iep|graduation|english learners?)",
    "higher": r"(?i)\b(colleges?|teachers college|university|universities|university system|state university|state universities|cal state|campus|campuses|undergraduate|graduate schools?|fraternity|sorority|ncaa|ivy league|community colleges?|college athletics|pell grant|degrees?|credentials?)\b",
    "higher_but": r"(?i)\b(k-?12|teacher prep|educator prep|school district|public school|principal pipeline|teacher pipeline|teacher residency)\b",
    "event": r"(?i)\b(virtual information session|info(rmation)? session|webinar|register now|register today|join us for|eventbrite|tickets?\b|session \||conference\s+\d{4}|summit\s+\d{4}|workshop\s+\d{4})",
    "sports": r"(?i)\b(nfl|nba|mlb|nhl|formula 1|grand prix|quarterback|receiver|running back|trade with the|touchdown|goalkeeper|race weekend|aston martin)\b",
    "conflict": r"(?i)\b(airstrike|ceasefire|missile|iranian|gaza|ukraine|israel|military strike|foreign ministry)\b",
    "crime": r"(?i)\b(pornographic images|sexual exploitation|tricking hundreds of teens|prank gone wrong|teacher was killed|teacher is dead|brought to us)\b",
    "crime_but": r"(?i)\b(district|school board|superintendent|policy|law|lawsuit|security|safety plan|weapons detection|state education|department of education|board of education)\b",
}
#: The same roles for the driver's invented prose.
DATA_TOPIC = {
    "explicit": r"(?i)\b(with the|que la|der die)\b", "strong": [r"(?i)\b(that|avec|nicht)\b", r"(?i)\b(from|pour)\b", r"(?i)\b(have|sur)\b"], "who": "(of|le|und)", "what": "(thing|mento|heit)",
    "higher": r"(?i)\b(edth|tionth)\b", "higher_but": r"(?i)\bthe\b", "event": r"(?i)\b(thest|ouou)\b", "sports": r"(?i)\b(eaon|ciónla)\b", "conflict": r"(?i)\b(itst|pfge)\b", "crime": r"(?i)\b(onor|ingth)\b", "crime_but": r"(?i)\bof\b",
}
