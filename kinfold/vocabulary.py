"""Names, field types and fixed values of the linkage engine."""

from __future__ import annotations

# Sources, trust, extraction methods and their confidence.
SOURCES = ("csv", "ats_json", "recruiter_notes")
SOURCE_TRUST = {"csv": 0.95, "ats_json": 0.90, "recruiter_notes": 0.60}
SOURCE_METHOD = {"csv": "direct_field_read", "ats_json": "ats_mapped", "recruiter_notes": "regex_extracted"}
METHOD_CONFIDENCE = {"direct_field_read": 0.95, "ats_mapped": 0.90, "regex_extracted": 0.80, "fuzzy_matched": 0.75, "derived": 0.70}
NOTE_FACTORS = {"emails": 1.0, "phones": 0.95, "full_name": 0.85, "current_company": 0.85, "title": 0.80, "skills": 0.90, "location": 0.75}

# Thresholds of matching and of the skill dictionary.
NAME_THRESHOLD, CONTEXT_THRESHOLD, SURE_NAME, FALLBACK_FACTOR, SKILL_THRESHOLD = 85.0, 80.0, 95.0, 0.7, 85.0
UNKNOWN_SKILL, DEFAULT_REGION, LOCATION_PARTS_ONLY = 0.5, "IN", 0.5

# Weights of the overall confidence, in the order they are summed.
FIELD_WEIGHTS = {
    "full_name": 3.0, "current_company": 2.0, "title": 1.5, "headline": 1.0, "years_experience": 1.0,
    "emails": 3.0, "phones": 2.0, "skills": 2.0, "location": 1.0,
}

SCALARS = ("full_name", "current_company", "title", "headline", "years_experience")
LISTS = ("emails", "phones", "skills")
LOCATION_PARTS = ("city", "region", "country")
LINKS = ("linkedin", "github", "portfolio")

# Delimited-file headers by canonical field.
CSV_HEADERS = {
    "full_name": ("name", "full_name", "full name", "candidate_name", "candidate name"),
    "emails": ("email", "emails", "email_address", "email address", "contact_email"),
    "phones": ("phone", "phones", "phone_number", "phone number", "contact_phone", "mobile"),
    "current_company": ("company", "current_company", "current company", "employer", "organization"),
    "title": ("title", "job_title", "job title", "position", "role"),
    "location": ("location",),
    "location.city": ("city",),
    "location.region": ("state", "region"),
    "location.country": ("country",),
    "skills": ("skills", "skill", "technical_skills", "technical skills"),
    "headline": ("headline", "summary"),
    "links.linkedin": ("linkedin", "linkedin_url"),
    "links.github": ("github", "github_url"),
    "years_experience": ("years_experience", "years of experience", "experience_years"),
}

# Applicant-system keys by canonical field, in the order they are tried.
ATS_KEYS = {
    "full_name": ("candidate_name", "applicant_name"),
    "emails": ("contact_email", "email_address"),
    "phones": ("contact_phone", "phone_number"),
    "current_company": ("current_employer", "company", "organization"),
    "title": ("job_title", "position", "role"),
    "location.city": ("city",),
    "location.region": ("state", "region"),
    "location.country": ("country",),
    "skills": ("technical_skills", "competencies", "skill_set"),
    "links.linkedin": ("linkedin_url",),
    "links.github": ("github_url",),
    "links.portfolio": ("portfolio_url",),
    "headline": ("headline", "summary", "professional_summary"),
    "years_experience": ("years_of_experience", "total_experience"),
    "experience": ("work_history", "employment_history"),
    "education": ("education_history", "academic_background"),
}
ATS_LIST_KEYS = ("candidates", "applicants", "records", "data", "results")
ATS_SIGNAL_KEYS = ("name", "email", "phone", "candidate_name", "applicant_name", "contact_email", "full_name")
ATS_EMPLOYER_KEYS = ("employer", "current_employer", "current_position")

# Canonical skill names by alias.
SKILL_ALIASES = {
    "python": "Python", "python3": "Python", "py": "Python", "cpython": "Python", "javascript": "JavaScript", "js": "JavaScript", "es6": "JavaScript",
    "ecmascript": "JavaScript", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "react": "React", "reactjs": "React", "react.js": "React",
    "angular": "Angular", "angularjs": "Angular", "vue": "Vue.js", "vuejs": "Vue.js", "vue.js": "Vue.js", "typescript": "TypeScript", "ts": "TypeScript",
    "java": "Java", "spring": "Spring Framework", "spring boot": "Spring Boot", "springboot": "Spring Boot", "ml": "Machine Learning",
    "machine learning": "Machine Learning", "machine-learning": "Machine Learning", "deep learning": "Deep Learning", "deep-learning": "Deep Learning",
    "dl": "Deep Learning", "ai": "Artificial Intelligence", "artificial intelligence": "Artificial Intelligence", "nlp": "Natural Language Processing",
    "natural language processing": "Natural Language Processing", "cv": "Computer Vision", "computer vision": "Computer Vision",
    "data science": "Data Science", "data-science": "Data Science", "tensorflow": "TensorFlow", "tf": "TensorFlow", "pytorch": "PyTorch",
    "torch": "PyTorch", "pandas": "Pandas", "numpy": "NumPy", "scikit-learn": "scikit-learn", "sklearn": "scikit-learn", "aws": "AWS",
    "amazon web services": "AWS", "gcp": "Google Cloud Platform", "google cloud": "Google Cloud Platform", "azure": "Microsoft Azure",
    "microsoft azure": "Microsoft Azure", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "sql": "SQL", "mysql": "MySQL",
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mongodb": "MongoDB", "mongo": "MongoDB", "redis": "Redis", "c++": "C++", "cpp": "C++",
    "c#": "C#", "csharp": "C#", "golang": "Go", "go": "Go", "rust": "Rust", "ruby": "Ruby", "scala": "Scala", "kotlin": "Kotlin", "swift": "Swift",
    "r": "R", "html": "HTML", "html5": "HTML", "css": "CSS", "css3": "CSS", "rest": "REST APIs", "rest api": "REST APIs", "restful": "REST APIs",
    "graphql": "GraphQL", "git": "Git", "github": "GitHub", "ci/cd": "CI/CD", "cicd": "CI/CD", "agile": "Agile", "scrum": "Scrum", "linux": "Linux",
    "unix": "Linux",
}

# Informal country names.
COUNTRY_ALIASES = {
    "usa": "US", "u.s.a.": "US", "u.s.": "US", "united states of america": "US", "united states": "US", "america": "US",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "india": "IN", "germany": "DE", "france": "FR",
    "canada": "CA", "australia": "AU", "japan": "JP", "china": "CN", "brazil": "BR", "south korea": "KR", "korea": "KR", "singapore": "SG",
    "netherlands": "NL", "holland": "NL", "sweden": "SE", "switzerland": "CH", "israel": "IL", "ireland": "IE", "spain": "ES", "italy": "IT",
    "russia": "RU", "uae": "AE", "united arab emirates": "AE",
}

# Words for a job that goes on.
ONGOING = ("present", "current", "now", "ongoing", "till date", "to date", "till now", "to present")

#: Calling code, trunk prefix and national numbers of the regions phones are validated for (public numbering plans).
PHONE_PLANS = {
    "IN": ("91", "0", r"[6-9]\d{9}|11\d{8}|[2-5]\d{9}"), "US": ("1", "1", r"[2-9][0-8]\d[2-9]\d{6}"), "CA": ("1", "1", r"[2-9][0-8]\d[2-9]\d{6}"),
    "GB": ("44", "0", r"7[1-57-9]\d{8}|[12]\d{8,9}|3\d{9}|[58]\d{9}"), "SG": ("65", "", r"[3689]\d{7}"), "AE": ("971", "0", r"5[024-68]\d{7}|[2-4679]\d{7}"),
    "NG": ("234", "0", r"[789][01]\d{8}|[1-9]\d{6,7}"), "EG": ("20", "0", r"1[0125]\d{8}|[23]\d{7,8}"), "BR": ("55", "0", r"[1-9][1-9]9\d{8}|[1-9][1-9][2-5]\d{7}"),
    "DE": ("49", "0", r"1[5-7]\d{8,9}|[2-9]\d{6,10}"), "FR": ("33", "0", r"[1-79]\d{8}"), "AU": ("61", "0", r"[23478]\d{8}"), "JP": ("81", "0", r"[789]0\d{8}|[1-9]\d{8}"),
}

#: Calling codes of the world's other numbering plans (public list), whose numbers are checked by length only.
CALLING_CODES = r"7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6]\d|29[0-9]|3[578]\d|42[013]|50\d|59\d|6[789]\d|85[02356]|88\d|9[67]\d|99[2-68]"
LEAST_NATIONAL, MOST_DIGITS = 5, 15

CONFIDENT = "struct<value:{},confidence:double>"
_LOCATION = "struct<city:string,region:string,country:string,text:string,bad:boolean>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field_of_study:string,end_year:int>"
#: Raw fields of a fragment. A null struct is an absent field.
RAW_FIELDS = (
    {f: CONFIDENT.format("string") for f in SCALARS}
    | {f: CONFIDENT.format("array<string>") for f in LISTS}
    | {"location": CONFIDENT.format(_LOCATION)}
    | {f"location_{p}": CONFIDENT.format("string") for p in LOCATION_PARTS}
    | {f"link_{p}": CONFIDENT.format("string") for p in LINKS}
    | {
        "experience": CONFIDENT.format(f"array<struct<key:string,item:{EXPERIENCE},bad:boolean>>"),
        "education": CONFIDENT.format(f"array<struct<key:string,item:{EDUCATION},bad:boolean>>"),
    }
)
#: After normalising, skills are named and scored one by one.
FIELDS = RAW_FIELDS | {"skills": CONFIDENT.format("array<struct<name:string,confidence:double,raw:string>>")}
FRAGMENT_KEYS = {"fid": "long", "source": "string", "trust": "double", "method": "string"}
