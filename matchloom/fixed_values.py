"""Word lists, lookup tables, patterns and weights that must stay as they are for right results."""

# ---- fixed values: word lists ----------------------------------------------------------------------------------
STOPWORDS = [
    "and", "with", "for", "the", "that", "from", "into", "your", "their", "have", "will", "this", "role", "team",
    "work",
]
SCORING_NOISE = [
    "experience", "years", "project", "projects", "system", "platform", "development", "engineering", "application",
]
NON_SKILL_PHRASES = [
    "no experience needed", "no experience required", "no prior experience", "fresher", "freshers", "entry level",
]
PROJECT_TAIL_TOKENS = [
    "app", "apps", "application", "project", "projects", "website", "site", "portal", "dashboard",
]
TERM_STOPWORDS = [
    "and", "are", "for", "from", "into", "the", "this", "that", "with", "will", "using", "your", "you", "our", "job",
    "role", "work", "build", "modern", "applications",
]
EVIDENCE_STOPWORDS = [
    "and", "are", "for", "from", "into", "the", "this", "that", "with", "will", "role", "team", "work", "build",
    "candidate", "engineer",
]
TOOL_MARKERS = [
    "tool", "tools", "technology", "technologies", "framework", "frameworks", "platform", "platforms", "tech stack",
    "stack",
]
KNOWN_EDUCATION = [
    "b.tech", "bachelor", "bachelors", "master", "m.tech", "mba", "bsc", "msc", "phd", "computer science",
    "engineering",
]
CONTACT_HINTS = ["@", "linkedin", "github", "portfolio", "phone", "mobile", "+"]
LINK_HINTS = ["linkedin", "github", "portfolio", "www.", "http"]
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
DEGREE_WORDS = [
    "btech", "mtech", "bachelor", "bachelors", "master", "masters", "bsc", "msc", "phd", "degree", "diploma",
]
DOTTED_DEGREES = ["b.tech", "m.tech", "b.e.", "b.sc", "m.sc"]
JOB_WORDS = [
    "assistant", "researcher", "professor", "lecturer", "intern", "developer", "dev", "engineer", "software",
    "fullstack", "frontend", "backend", "manager", "lead", "coordinator", "tutor", "instructor", "faculty", "staff",
    "postdoc", "fellow", "consultant", "freelance", "freelancer", "founder", "mentor", "creator", "writer",
    "designer", "editor", "analyst", "specialist", "executive", "administrator", "scientist", "architect",
    "technician", "associate", "expert", "officer", "director", "head", "principal", "president", "vp", "ui", "ux",
]
OWNERSHIP_VERBS = [
    "led", "designed", "architected", "owned", "built", "launched", "shipped", "drove", "founded", "created",
    "established", "defined",
]
CONTRIBUTOR_VERBS = ["worked", "assisted", "helped", "supported", "contributed", "participated"]
BACHELOR_MARKS = ["b.tech", "b.e", "bachelor", "bachelors"]
MASTER_MARKS = ["m.tech", "m.e", "master", "masters", "msc", "m.sc"]
BACHELOR_TERMS = ["bachelor", "b.tech", "bachelor of technology", "bachelor of engineering"]
MASTER_TERMS = ["master", "m.tech", "master of technology", "master of engineering"]

# ---- fixed values: lookup tables -------------------------------------------------------------------------------
ROLE_ALIASES = {"fullstack": "full stack"}
SKILL_ALIASES = {
    "ml": "machine learning", "ai": "artificial intelligence", "reactjs": "react", "node": "node.js",
    "nodejs": "node.js", "js": "javascript", "ts": "typescript", "k8s": "kubernetes", "py": "python",
}
SENIORITY_LEVELS = {
    "intern": 1, "trainee": 1, "junior": 2, "associate": 2, "sde-1": 2, "sde 1": 2, "sde1": 2, "l3": 2, "ic3": 3,
    "engineer": 3, "developer": 3, "analyst": 3, "mts": 3, "sde-2": 3, "sde 2": 3, "sde2": 3, "l4": 3, "senior": 4,
    "sse": 4, "sde-3": 4, "sde 3": 4, "sde3": 4, "mts-2": 4, "l5": 4, "ic4": 4, "staff": 5, "lead": 5,
    "principal": 5, "architect": 5, "tl": 5, "mts-3": 5, "l6": 5, "ic5": 5, "manager": 6, "head": 6, "director": 6,
    "em": 6, "l7": 6, "ic6": 6,
}
SECTION_ALIASES = {
    "[SUMMARY]": ["professional summary", "profile summary", "summary", "objective", "about me"],
    "[SKILLS]": [
        "skills", "technical skills", "technical expertise", "core competencies", "tech stack", "key skills",
        "technologies", "technology stack",
    ],
    "[TOOLS]": ["tools", "tools platforms", "tools and platforms", "platforms", "tooling", "development tools"],
    "[EXPERIENCE]": [
        "experience", "work experience", "employment history", "professional experience", "professional journey",
    ],
    "[EDUCATION]": ["education", "academic background", "academic qualifications", "qualifications"],
    "[CERTIFICATIONS]": ["certifications", "licenses", "credentials", "courses certifications"],
    "[PROJECTS]": ["projects", "project experience", "key projects", "selected projects", "personal projects"],
    "[LINKS]": ["links", "profiles", "portfolio", "online presence"],
}
# archetype substring (first hit wins) -> points for skills, experience, education, keyword, completeness
BUDGETS = {
    "research": (32, 28, 25, 10, 5),
    "management": (20, 35, 15, 15, 15),
    "data_ml": (35, 25, 22, 13, 5),
    "product": (20, 30, 15, 20, 15),
    "senior": (35, 35, 10, 10, 10),
    "analyst": (30, 25, 15, 20, 10),
    "finance": (25, 30, 25, 15, 5),
}
DEFAULT_BUDGET = (40, 30, 15, 10, 5)
SHORT_JOB_CONTEXT = {
    r"\b(ai|ml|machine learning|artificial intelligence)\b": (
        ["python", "deep learning", "natural language processing"],
        ["artificial intelligence", "machine learning"],
    ),
    r"\b(full stack|fullstack)\b": (
        ["javascript", "react", "node.js"],
        ["web development", "backend api", "frontend"],
    ),
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LATEST_SHORT_YEAR = "74"  # two figures below this are years from 2000, others from 1900

# ---- fixed values: patterns (explicit classes, so that they mean the same in every regex dialect) ------------------
WHITESPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
LIST_SPLIT = r"[\n,;/|]+"
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
PHONE = r"(?:(?:\+[0-9]{1,3}[\s\-]?)?(?:\(?[0-9]{2,4}\)?[\s\-]?)?[0-9][0-9\s\-]{7,}[0-9])"
PII_EMAIL = r"\b[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}\b"
PII_PHONE = r"(?:\+?[0-9][0-9\s\-\(\)]{8,14}[0-9])"
LINK = r"(?i)\b(?:https?://|www\.)\S+\b"
YEARS = r"([0-9]+(?:\.[0-9]+)?)\+?\s*(?:years|yrs)"
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
MONTH_YEAR = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)?\.?\s*[0-9]{4}"
DATE_RANGE = (
    r"(?i)\b(?:" + MONTH_YEAR + r"|[0-9]{4})\s*(?:-|to|\x{2013})\s*(?:present|current|now|" + MONTH_YEAR + r"|[0-9]{4})"
)
RANGE_SEPARATOR = r"(?i)\s*(?:-|to|\x{2013})\s*"
IMPACT = [
    r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:reduction|increase|improvement|decrease|faster|growth)",
    r"(?i)\b(?:reduced|improved|increased|decreased|optimized)\b.{0,60}\b[0-9]+",
    r"(?i)\b(?:served|handling|processed|supporting)\b.{0,40}\b([0-9][0-9,]*)\s*"
    r"(?:users|requests|events|transactions)",
]
EVIDENCE_IMPACT = (
    r"(?i)\b(?:built|designed|led|owned|launched|improved|reduced|optimized|scaled|shipped)\b|"
    r"\b[0-9]+(?:\.[0-9]+)?\s*(?:%|k|m|users|requests|transactions|ms|seconds|monthly|daily)?\b"
)
LOCATION_LABEL = r"(?im)^\s*(?:location|address|city|based in)\s*[:\-]\s*(.+)$"
CITY_REGION = (
    r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)?,\s*[A-Z][a-z]+(?:\s[A-Z][a-z]+)?(?:,\s*[A-Z][a-z]+)?)"
)
JOB_TITLE_LABEL = r"(?im)^(?:job title|role|position)\s*:\s*(.+)$"
INTERN_TITLE = r"\b(intern|internship|trainee|apprentice)\b"

# ---- fixed values: weights ---------------------------------------------------------------------------------------
EVIDENCE_DECAY = 0.85
LISTED_WEIGHT = 0.60
ENTRY_SKILL_WEIGHT = 0.75
HIGHLIGHT_WEIGHT = 0.60
PROJECT_WEIGHT = 0.50
NON_DECREASING_WEIGHT = 0.65
UPWARD_GAIN_WEIGHT = 0.35
BREADTH_MIN_SKILLS = 4
BREADTH_FLOOR = 0.7
