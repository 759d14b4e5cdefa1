"""Fixed values of the claim rules: word lists, weights, registries and limits."""

# fixed values: weights of sensational terms, in declaration order
SENSATIONAL = {
    "shocking": 9, "miracle": 9, "you won't believe": 10, "you will not believe": 10,
    "exposed": 8, "secretly": 8, "secret": 6, "leaked": 7, "rumours": 7, "rumors": 7,
    "viral": 5, "hoax": 6, "conspiracy": 8, "unbelievable": 8, "overnight": 5, "furious": 5,
    "hidden truth": 10, "they don't want you to know": 10, "doctors hate": 10,
    "share before": 9, "forward this": 9, "must read": 7, "anonymous": 5, "cure": 5,
    "cures": 5, "banned": 5, "wake up": 6, "mainstream media": 7, "big pharma": 9,
    "100 guaranteed": 10, "guaranteed": 6, "act now": 7, "quietly": 4,
}

# fixed values: term lists, in declaration order
HEDGING = ["claims", "claimed", "allegedly", "no evidence", "reportedly"]
SUPPRESSED = ["no evidence", "claims", "viral", "hoax", "rumours", "rumors", "allegedly"]
DEBUNK = ["fact check", "fake news", "false claim", "misleading", "debunked", "debunk"]
EMOTION = ["shocking", "outrageous", "furious", "terrifying", "disgusting", "horrific", "unbelievable", "insane", "destroyed", "slammed", "panic", "chaos", "war"]
URGENCY = ["share before", "forward this", "act now", "urgent", "immediately", "last chance", "breaking", "just in", "before it's deleted", "before it gets deleted", "deleted", "hurry", "only today"]
FORWARD = ["forward this", "share before", "forward to everyone", "share with everyone", "send to everyone", "forward to all", "share this", "forward it", "to everyone"]
CLICKBAIT = ["you won't believe", "you will not believe", "what happened next", "this one trick", "doctors hate", "will shock you", "gone wrong", "the truth about"]
BODIES = [
    "ministry of finance", "ministry of health", "ministry of home affairs", "ministry", "government",
    "reserve bank of india", "rbi", "niti aayog", "isro", "icmr", "imd", "india meteorological department",
    "election commission", "uidai", "pib", "press information bureau", "cert in", "sebi",
    "world health organization", "commission", "department", "authority", "officials", "spokesperson", "governor",
]
VERBS = ["said", "says", "announced", "announces", "confirmed", "confirms", "issued", "issues", "stated", "states", "clarified", "notified", "told"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]

# fixed values: topic keywords, topics in declaration order
TOPICS = {
    "health": ["health", "vaccine", "vaccination", "covid", "virus", "disease", "hospital", "doctor", "doctors", "medicine", "drug", "cure", "cures", "patient", "cancer", "outbreak", "world health organization", "icmr", "mohfw"],
    "economy": ["gdp", "inflation", "rupee", "bank", "banks", "rbi", "reserve bank", "economy", "tax", "gst", "budget", "unemployment", "stock market", "share market", "sensex", "nifty", "loan", "currency", "currency note", "currency notes", "rupee notes", "repo rate", "price", "prices", "salary", "cash transactions"],
    "policy": ["ministry", "government", "policy", "scheme", "parliament", "lok sabha", "rajya sabha", "lok sabha bill", "ordinance", "cabinet", "niti aayog", "reform", "subsidy", "yojana"],
    "science": ["isro", "satellite", "satellite launch", "rocket launch", "mission", "research", "researchers", "study", "scientists", "space", "chandrayaan", "experiment", "moon", "mars", "peer reviewed"],
    "weather": ["cyclone", "rain", "rainfall", "flood", "heatwave", "monsoon", "storm", "earthquake", "imd", "weather", "orange alert", "red alert", "temperature"],
    "elections": ["election", "elections", "election commission", "vote", "voting", "evm", "vvpat", "exit poll", "opinion poll", "polling", "candidate", "constituency", "ballot", "voter"],
    "digital": ["aadhaar", "uidai", "upi", "otp", "cyber", "hacked", "data breach", "data protection", "mobile app", "whatsapp", "online", "digital", "phone", "sim", "sim cards", "phishing", "internet", "it stocks"],
    "transport": ["train", "railway", "railways", "metro", "highway", "expressway", "toll", "flight", "airport", "licence", "license", "bus fare", "bus service"],
    "agriculture": ["farmer", "farmers", "crop", "msp", "wheat", "rice", "harvest", "fertiliser", "fertilizer", "agriculture", "mandi"],
    "defence": ["army", "navy", "air force", "defence", "soldier", "border", "missile", "military", "agniveer"],
}

# fixed values: official sources (id, name, url, topics), in registry order
SOURCES = [
    ("pib-factcheck", "PIB Fact Check — Press Information Bureau", "https://pib.gov.in/factcheck.aspx", ["general", "policy", "health", "economy", "digital", "elections"]),
    ("niti-aayog", "NITI Aayog", "https://www.niti.gov.in/", ["policy", "economy", "agriculture", "health", "general"]),
    ("mohfw", "Ministry of Health & Family Welfare", "https://www.mohfw.gov.in/", ["health"]),
    ("icmr", "Indian Council of Medical Research", "https://www.icmr.gov.in/", ["health", "science"]),
    ("rbi", "Reserve Bank of India", "https://www.rbi.org.in/", ["economy", "digital"]),
    ("mospi", "Ministry of Statistics & Programme Implementation", "https://www.mospi.gov.in/", ["economy", "policy"]),
    ("imd", "India Meteorological Department", "https://mausam.imd.gov.in/", ["weather"]),
    ("ndma", "National Disaster Management Authority", "https://ndma.gov.in/", ["weather", "general"]),
    ("isro", "Indian Space Research Organisation", "https://www.isro.gov.in/", ["science"]),
    ("eci", "Election Commission of India", "https://www.eci.gov.in/", ["elections"]),
    ("meity", "Ministry of Electronics & Information Technology", "https://www.meity.gov.in/", ["digital", "policy"]),
    ("cert-in", "Indian Computer Emergency Response Team", "https://www.cert-in.org.in/", ["digital"]),
    ("uidai", "Unique Identification Authority of India", "https://uidai.gov.in/", ["digital", "policy"]),
    ("railways", "Ministry of Railways", "https://indianrailways.gov.in/", ["transport"]),
    ("morth", "Ministry of Road Transport & Highways", "https://morth.nic.in/", ["transport"]),
    ("agricoop", "Ministry of Agriculture & Farmers' Welfare", "https://agriwelfare.gov.in/", ["agriculture", "economy"]),
    ("mod", "Ministry of Defence", "https://www.mod.gov.in/", ["defence"]),
    ("data-gov", "Open Government Data Platform India", "https://data.gov.in/", ["general", "economy", "policy", "science"]),
]

# fixed values: reputable outlets
OUTLETS = [
    "thehindu.com", "indianexpress.com", "hindustantimes.com", "timesofindia.indiatimes.com", "economictimes.indiatimes.com",
    "ndtv.com", "livemint.com", "business-standard.com", "indiatoday.in", "deccanherald.com", "thehindubusinessline.com",
    "scroll.in", "theprint.in", "newindianexpress.com", "telegraphindia.com", "news18.com", "moneycontrol.com", "pib.gov.in",
    "reuters.com", "apnews.com", "bbc.com", "bbc.co.uk", "aljazeera.com", "theguardian.com",
]

# fixed values: buckets of fact-check ratings, by normalised name
RATINGS = {
    "false": "false", "fake": "false", "fake news": "false", "totally false": "false", "completely false": "false", "pants on fire": "false", "incorrect": "false", "wrong": "false", "untrue": "false", "not true": "false", "hoax": "false", "fabricated": "false", "baseless": "false", "scam": "false",
    "misleading": "misleading", "partly false": "misleading", "partially false": "misleading", "mostly false": "misleading", "missing context": "misleading", "lacks context": "misleading", "needs context": "misleading", "out of context": "misleading", "false context": "misleading", "distorted": "misleading", "exaggerated": "misleading", "exaggeration": "misleading", "altered": "misleading", "manipulated": "misleading", "edited video": "misleading", "satire": "misleading",
    "true": "true", "correct": "true", "accurate": "true", "mostly true": "true", "verified": "true", "genuine": "true",
    "half true": "mixed", "partly true": "mixed", "partially true": "mixed", "mixture": "mixed", "mixed": "mixed",
}

# fixed values: stop words of the news search
NEWS_STOP = (
    "a an the and or but if then than that this these those is are was were be been being to of in on at by for "
    "with from as into about over after before under above it its they them their there here he she his her we our "
    "you your i me my has have had do does did will would shall should can could may might must not no nor so very "
    "just also only all any each every some such more most other new said says say according per via who whom whose "
    "which what when where why how up down out off again further once now today tomorrow yesterday next last week month "
    "year years share forward urgent breaking viral claim claims claimed people news report reports"
).split()
BREAKING = ["breaking", "today", "tonight", "right now", "just now", "urgent", "this morning", "this evening", "hours ago"]

# fixed values: the planner's costs and gains (hundredths), checks in index order
CHECKS = ["sensational", "attribution", "emotion", "urgency", "specificity", "style", "clickbait", "corroboration", "factcheck", "news", "gemini"]
LABELS = ["Sensational vocabulary", "Claimed attribution", "Emotional tone", "Urgency & forwarding pressure", "Checkable details", "Writing style", "Clickbait framing", "Official-source lookup", "Fact-check lookup", "News search", "Gemini (evidence-only)"]
COSTS = [1, 1, 1, 1, 1, 1, 1, 1, 2, 3, 4]
FACTCHECKED = ["health", "policy", "elections", "economy", "digital"]
TAU = 0.6
LIMITS = {"predict": 30, "verify": 10, "extract": 5, "opinion": 10}
#: The budget that each action draws on, and its limit: reading the evidence shares that of verification.
BUDGETS = {"predict": ("predict", 30), "verify": ("verify", 10), "ground": ("verify", 10), "extract": ("extract", 5), "opinion": ("opinion", 10)}

# fixed values: the summary sentences (text that isn't read, text under pressure, before and after the risk)
SUMMARIES = (
    "The rule engine only reads English. Use the fact-check lookup for this text.",
    "The wording shows strong risk signals plus pressure to forward. That pattern is common in misleading messages — check before sharing.",
    "Language risk is ",
    ". This reads the wording only, not the facts — the claim is unverified until confirmed with an official source.",
)
