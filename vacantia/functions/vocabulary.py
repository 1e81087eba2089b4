"""Word lists, codes and thresholds that results depend on. Order matters where rules are lists of pairs."""

# Titles. The first rule with a matching needle wins.
SENIORITY_RULES = [
    (6, ["distinguished", "fellow"]),
    (6, ["principal"]),
    (5, ["staff"]),
    (4, ["senior", "sr.", "sr ", "lead "]),
    (3, ["intermediate", "mid-level", "mid level"]),
    (2, ["junior", "jr.", "jr ", "entry level", "entry-level", "graduate", "associate"]),
    (1, ["intern", "internship", "apprentice", "trainee"]),
]
SENIORITY_LABELS = {1: "intern", 2: "junior", 3: "mid", 4: "senior", 5: "staff", 6: "principal"}
MANAGEMENT_NEEDLES = ["manager", "director", "vp ", "vice president", "head of", "chief", "cto", "ceo", "cfo"]
ROLE_FAMILY_RULES = [
    ("ml", ["machine learning", "ml engineer", "deep learning", "nlp", "computer vision", "ai engineer", "research scientist"]),
    ("data", ["data engineer", "data scientist", "analytics engineer", "data analyst", "data platform", "bi ", "business intelligence"]),
    ("security", ["security", "appsec", "infosec", "threat", "vulnerability", "penetration"]),
    ("platform", ["site reliability", " sre", "sre ", "devops", "platform engineer", "infrastructure engineer", "cloud engineer"]),
    ("mobile", ["ios", "android", "mobile engineer", "react native", "flutter"]),
    ("frontend", ["frontend", "front-end", "front end", "ui engineer", "web engineer"]),
    ("backend", ["backend", "back-end", "back end", "server-side"]),
    ("fullstack", ["fullstack", "full-stack", "full stack"]),
    ("qa", ["qa ", "quality engineer", "test engineer", "sdet", "automation engineer"]),
    ("design", ["designer", "ux ", "ui/ux", "product design"]),
    ("product", ["product manager", "product owner", "technical program manager", "tpm "]),
    ("sales", ["account executive", "sales", "business development", "solutions engineer", "pre-sales"]),
    ("support", ["support engineer", "customer success", "solutions architect", "technical account"]),
    ("marketing", ["marketing", "content strategist", "demand generation"]),
    ("people", ["recruiter", "talent acquisition", "people partner", "human resources", "employee relations"]),
    ("finance", ["accountant", "financial analyst", "controller", "payroll"]),
    ("engineering", ["engineer", "developer", "programmer", "architect"]),
]

# Spellings of each country.
COUNTRIES = {
    "US": ["united states", "usa", "us", "u.s.", "u.s.a.", "america"],
    "GB": ["united kingdom", "uk", "u.k.", "great britain", "england", "scotland", "wales", "northern ireland"],
    "CA": ["canada"], "MX": ["mexico"], "BR": ["brazil"], "AR": ["argentina"], "CL": ["chile"],
    "CO": ["colombia"], "PE": ["peru"], "UY": ["uruguay"], "CR": ["costa rica"],
    "DE": ["germany"], "FR": ["france"], "ES": ["spain"], "PT": ["portugal"], "IT": ["italy"],
    "NL": ["netherlands", "the netherlands"], "BE": ["belgium"], "LU": ["luxembourg"],
    "IE": ["ireland"], "DK": ["denmark"], "SE": ["sweden"], "NO": ["norway"], "FI": ["finland"],
    "IS": ["iceland"], "PL": ["poland"], "CZ": ["czechia", "czech republic"],
    "SK": ["slovakia"], "HU": ["hungary"], "RO": ["romania"], "BG": ["bulgaria"],
    "GR": ["greece"], "HR": ["croatia"], "SI": ["slovenia"], "RS": ["serbia"],
    "AT": ["austria"], "CH": ["switzerland"], "EE": ["estonia"], "LV": ["latvia"],
    "LT": ["lithuania"], "UA": ["ukraine"], "TR": ["turkey", "türkiye"],
    "IL": ["israel"], "AE": ["united arab emirates", "uae", "u.a.e."],
    "SA": ["saudi arabia"], "QA": ["qatar"], "EG": ["egypt"], "ZA": ["south africa"],
    "KE": ["kenya"], "NG": ["nigeria"], "MA": ["morocco"],
    "IN": ["india"], "PK": ["pakistan"], "BD": ["bangladesh"], "LK": ["sri lanka"],
    "CN": ["china"], "JP": ["japan"], "KR": ["south korea", "korea"],
    "SG": ["singapore"], "MY": ["malaysia"], "ID": ["indonesia"], "TH": ["thailand"],
    "VN": ["vietnam"], "PH": ["philippines"], "TW": ["taiwan"], "HK": ["hong kong"],
    "AU": ["australia"], "NZ": ["new zealand"],
}
REMOTE_HINTS = ["remote", "work from home", "wfh", "anywhere", "distributed"]
HYBRID_HINTS = ["hybrid"]
MODE_PREFIXES = ["remote", "hybrid", "onsite", "on-site", "on site", "wfh"]
NOT_PLACES = ["any", "anywhere", "global", "worldwide", "multiple locations", "various", "flexible", "n/a", "-"]

# Words that block keys and title comparisons leave out.
STOP_WORDS = ["a", "an", "and", "the", "of", "for", "to", "in", "at", "with", "or"]

# Duplicate decisions.
MAX_HAMMING = 9
MIN_TEXT = 400
MIN_TITLE_TOKENS = 3
AUTO_MERGE = 0.75

# Pipeline states in order.
STATES = ["discovered", "fetched", "parsed", "normalized", "deduped", "enriched", "embedded", "ready"]
FAILED = "failed_permanent"
DEGRADABLE = ["enriched", "embedded"]
MAX_ATTEMPTS = 5

# Source health.
MIN_SAMPLE = 20
YIELD_DROP = 0.10
FILL_DROP = 0.20
FILL_FLOOR = 0.30
QUARANTINE_AFTER = 3
ALERTING_FIELDS = ["company", "location", "apply_url", "language"]
