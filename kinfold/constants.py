"""Fixed values that results depend on: priorities, weights, aliases, keywords."""

from __future__ import annotations

# How much a kind of source is trusted, and its base confidence.
PRIORITY = {"pdf": 100, "csv": 80}
BASE_CONFIDENCE = {"pdf": 0.92, "csv": 0.84}
METHOD_FACTOR = {"structured_field": 1.00, "regex": 0.95, "section_heuristic": 0.90, "fuzzy_match": 0.85}
EXTENSIONS = {".csv": "csv", ".pdf": "pdf"}

# Weights of fields in the overall confidence.
FIELD_WEIGHTS = {
    "full_name": 3.0, "emails": 2.0, "phones": 2.0, "skills": 2.0, "experience": 2.0,
    "education": 1.0, "location": 1.0, "headline": 1.0, "years_experience": 1.0, "links": 0.5,
}
DEFAULT_WEIGHT = 1.0
CORROBORATION = 0.03
SKILL_BASE, SKILL_BOOST, SKILL_BOOST_CAP = 0.8, 0.05, 0.10
FUZZY_SKILL_RATIO = 90.0

# Words that mean "still there" in place of an end date.
ONGOING = ("present", "current", "now", "ongoing")

# Skill aliases, lower case, to canonical names.
SKILL_ALIASES = {
    "javascript": "JavaScript", "js": "JavaScript", "ecmascript": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript",
    "react": "React", "reactjs": "React", "react.js": "React", "react js": "React",
    "angular": "Angular", "angularjs": "Angular", "angular.js": "Angular", "vue": "Vue.js", "vuejs": "Vue.js", "vue.js": "Vue.js",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "express": "Express.js", "expressjs": "Express.js",
    "express.js": "Express.js", "next": "Next.js", "nextjs": "Next.js", "next.js": "Next.js",
    "python": "Python", "python3": "Python", "py": "Python", "django": "Django", "flask": "Flask", "fastapi": "FastAPI",
    "pandas": "pandas", "numpy": "NumPy", "scipy": "SciPy", "scikit-learn": "scikit-learn", "sklearn": "scikit-learn",
    "pytorch": "PyTorch", "torch": "PyTorch", "tensorflow": "TensorFlow", "tf": "TensorFlow",
    "java": "Java", "kotlin": "Kotlin", "spring": "Spring", "spring boot": "Spring Boot", "springboot": "Spring Boot",
    "c": "C", "c++": "C++", "cpp": "C++", "rust": "Rust", "go": "Go", "golang": "Go",
    "sql": "SQL", "mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mongodb": "MongoDB", "mongo": "MongoDB",
    "redis": "Redis", "aws": "AWS", "amazon web services": "AWS", "gcp": "GCP", "google cloud": "GCP", "google cloud platform": "GCP",
    "azure": "Azure", "microsoft azure": "Azure", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "git": "Git", "github": "GitHub", "ci/cd": "CI/CD", "cicd": "CI/CD", "rest": "REST", "restful": "REST", "graphql": "GraphQL",
    "html": "HTML", "html5": "HTML", "css": "CSS", "css3": "CSS", "sass": "Sass", "scss": "Sass",
    "tailwind": "Tailwind CSS", "tailwindcss": "Tailwind CSS", "machine learning": "Machine Learning", "ml": "Machine Learning",
    "deep learning": "Deep Learning", "dl": "Deep Learning", "nlp": "NLP", "natural language processing": "NLP",
    "computer vision": "Computer Vision", "cv": "Computer Vision", "agile": "Agile", "scrum": "Scrum", "jira": "Jira",
    "linux": "Linux", "bash": "Bash", "shell": "Shell Scripting", "shell scripting": "Shell Scripting",
    "r": "R", "ruby": "Ruby", "rails": "Ruby on Rails", "ruby on rails": "Ruby on Rails", "php": "PHP", "swift": "Swift",
    "objective-c": "Objective-C", "objectivec": "Objective-C",
}

# Header aliases, lower case, to canonical columns.
HEADER_ALIASES = {
    "name": "full_name", "full_name": "full_name", "full name": "full_name", "candidate_name": "full_name", "candidate name": "full_name",
    "email": "email", "email_address": "email", "email address": "email", "e-mail": "email",
    "phone": "phone", "phone_number": "phone", "phone number": "phone", "mobile": "phone", "telephone": "phone", "tel": "phone",
    "city": "city", "state": "region", "region": "region", "province": "region", "country": "country", "location": "location",
    "title": "headline", "current_title": "headline", "current title": "headline", "headline": "headline",
    "job_title": "headline", "job title": "headline", "position": "headline",
    "company": "current_company", "current_company": "current_company", "current company": "current_company", "employer": "current_company",
    "years_experience": "years_experience", "years experience": "years_experience", "years_of_experience": "years_experience",
    "experience_years": "years_experience", "yoe": "years_experience",
    "skills": "skills", "skill": "skills", "technologies": "skills", "tech_stack": "skills", "tech stack": "skills",
    "linkedin": "linkedin", "linkedin_url": "linkedin", "linkedin url": "linkedin",
    "github": "github", "github_url": "github", "github url": "github",
    "portfolio": "portfolio", "website": "portfolio", "portfolio_url": "portfolio",
}

# Country aliases, lower case, to ISO 3166 alpha-2 codes.
COUNTRY_ALIASES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "america": "US",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "northern ireland": "GB", "india": "IN", "canada": "CA", "australia": "AU", "germany": "DE", "france": "FR", "japan": "JP",
    "china": "CN", "brazil": "BR", "south korea": "KR", "korea": "KR", "singapore": "SG", "israel": "IL", "ireland": "IE",
    "netherlands": "NL", "holland": "NL", "spain": "ES", "italy": "IT", "sweden": "SE", "switzerland": "CH", "norway": "NO",
    "denmark": "DK", "finland": "FI", "new zealand": "NZ", "uae": "AE", "united arab emirates": "AE", "russia": "RU", "mexico": "MX",
    "indonesia": "ID", "philippines": "PH", "taiwan": "TW", "poland": "PL", "portugal": "PT", "belgium": "BE", "austria": "AT",
    "czech republic": "CZ", "czechia": "CZ",
}

# Section headers of a resume.
SECTION_KEYWORDS = {
    "experience": ["experience", "work experience", "professional experience", "employment history", "work history", "career history"],
    "education": ["education", "academic background", "academic history", "qualifications"],
    "skills": ["skills", "technical skills", "technologies", "core competencies", "competencies", "tech stack", "proficiencies"],
    "contact": ["contact", "contact information", "personal information", "personal details"],
    "summary": ["summary", "professional summary", "objective", "career objective", "about", "profile", "about me"],
}

# Parts of words that mark a degree.
DEGREE_KEYWORDS = (
    "bachelor", "master", "phd", "ph.d", "doctorate", "associate", "b.s.", "b.a.", "m.s.", "m.a.", "m.b.a.",
    "b.tech", "m.tech", "b.sc", "m.sc", "b.e.", "m.e.",
)

# Patterns, in Java's syntax.
EMAIL_LOCAL = r"[a-zA-Z0-9._%+\-]"
EMAIL_HOST = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL = f"{EMAIL_LOCAL}+@{EMAIL_HOST}"
PHONE = r"(?U)(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{1,4})?"
LINKEDIN = r"(?iU)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w\-]+/?"
GITHUB = r"(?iU)(?:https?://)?(?:www\.)?github\.com/[\w\-]+/?"
URL = r"(?iU)https?://[^\s,;|]+"
NOT_NAME = r"(?iU)(?:@|https?://|www\.|\.com|\.org|\.edu|resume|curriculum|vitae|page \d)"
STATE = r"(?U),\s*([A-Z]{2})\b"
ENTRY = r"(?U)^(.+?)\s*[|•·–—]\s*(.+?)\s*[|•·–—]\s*(.+)$"
_MONTH_YEAR = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}"
DATE_RANGE = (
    rf"(?iU)({_MONTH_YEAR}|(?:\d{{1,2}}[/\-]\d{{4}})|(?:\d{{4}}[/\-]\d{{1,2}})|(?:\d{{4}}))\s*[-–—to]+\s*"
    rf"({_MONTH_YEAR}|(?:\d{{1,2}}[/\-]\d{{4}})|(?:\d{{4}}[/\-]\d{{1,2}})|(?:\d{{4}})|[Pp]resent|[Cc]urrent|[Nn]ow)"
)
YEAR = r"(?U)\b((?:19|20)\d{2})\b"
YEARS_OF = r"(?iU)(\d+)\+?\s*(?:years?|yrs?)\s*(?:of)?\s*(?:experience|exp)?"
BULLET = r"^[-•·–→▪►]"
PATH = r"^[a-zA-Z_]\w*(?:\.\w+)*(?:\[\d+\]|\[\]\.[\w.]+)?$"
OUTPUT_PATH = r"\w+"
HEADER_EDGE = r"[:\-–—_=]+"
YEAR_ONLY = r"^\d{4}$"
MONTH_YEAR, YEAR_MONTH = r"^(\d{1,2})[/\-](\d{4})$", r"^(\d{4})[/\-](\d{1,2})$"

# Country calling codes in use, by their first digits.
CALLING_CODE = r"(?:1|7|2[07]|2[1-69]\d|3[0-469]|3[578]\d|4[013-9]|42\d|5[1-8]|5[09]\d|6[0-6]|6[7-9]\d|8[1246]|8[0578]\d|9[0-58]|9[679]\d)"

# Least and most digits behind a calling code.
NATIONAL_LENGTHS = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9),
    "40": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "51": (8, 9), "52": (10, 10),
    "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (10, 10), "61": (9, 9), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9),
    "81": (9, 10), "82": (8, 11), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "93": (9, 9), "94": (9, 9),
    "98": (10, 10), "212": (9, 9), "213": (8, 9), "216": (8, 8), "234": (8, 10), "254": (9, 10), "351": (9, 9), "353": (7, 9), "354": (7, 7),
    "357": (8, 8), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9),
    "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (9, 9), "971": (8, 9), "972": (8, 9),
}

# North American area codes that are kept free, and numbers with exchange codes that are none.
NORTH_AMERICAN = {"free": ("200", "300", "400", "37", "555", "96"), "no_exchange": r"^1[0-9]{3}(?:[01]|[2-9]11)"}
