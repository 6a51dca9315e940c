"""Vocabularies as literal tables.

A vocabulary is an ordered mapping ``domain -> [keyword, ...]`` (or ``keyword ->
weight``). Order matters: ties in ``argmax`` go to the first domain, skill lists
keep vocabulary order. They are tiny and fixed, so operators broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the matched application's tables for equal results.
# Stated as text, in their natural order.
# ---------------------------------------------------------------------------

DOMAINS = [
    "informatique_reseaux",
    "automatismes_info_industrielle",
    "finance",
    "genie_civil_btp",
    "genie_industriel",
]

# label alias used by the training / embedding side
DOMAIN_ALIASES = {"civil_btp": "genie_civil_btp"}

DOMAIN_RELATIONS = {
    "informatique_reseaux": ["automatismes_info_industrielle", "genie_industriel"],
    "automatismes_info_industrielle": ["informatique_reseaux", "genie_industriel"],
    "finance": ["genie_industriel"],
    "genie_civil_btp": ["genie_industriel"],
    "genie_industriel": ["automatismes_info_industrielle", "informatique_reseaux"],
}

# related domains of the embedding matcher (similarity 0.5), directed
RELATED_DOMAINS = {
    "informatique_reseaux": ["automatismes_info_industrielle"],
    "automatismes_info_industrielle": ["informatique_reseaux", "genie_industriel"],
    "finance": [],
    "civil_btp": ["genie_industriel"],
    "genie_industriel": ["automatismes_info_industrielle", "civil_btp"],
}

DOMAIN_KEYWORDS = {
    "informatique_reseaux": [
        "développeur", "devops", "fullstack", "backend", "frontend", "cloud", "architecture",
        "réseau", "système", "logiciel", "web", "sécurité", "software", "java", "python",
        "javascript", "react", "angular", "node", "spring", "kubernetes", "docker", "aws",
        "azure", "devops", "ci/cd", "api", "microservices", "machine learning", "data",
        "database", "sql", "nosql", "git", "agile", "scrum", "php", "c++", "c#", ".net"],
    "automatismes_info_industrielle": [
        "automate", "plc", "programmable", "scada", "supervision", "automaticien", "robot",
        "automatisme", "contrôle", "régulation", "mesure", "capteur", "actionneur", "siemens",
        "schneider", "rockwell", "abb", "dcs", "step7", "industrie 4.0", "m2m", "iot",
        "industrial", "embarqué", "temps réel", "modbus", "profibus", "profinet", "ethernet/ip",
        "can", "visu", "hmi", "ihm", "wincc", "wonderware", "labview", "matlab"],
    "finance": [
        "finance", "comptabilité", "comptable", "audit", "fiscal", "trésorerie", "contrôle",
        "gestion", "budgétaire", "ifrs", "consolidation", "analyste", "financier", "controller",
        "investissement", "risques", "économiste", "bancaire", "banque", "assurance", "actif",
        "passif", "bilan", "portfolio", "marchés", "financiers", "trading", "trésorier",
        "analyste crédit", "fusion", "acquisition", "private equity", "fiscal", "sap", "sage"],
    "genie_civil_btp": [
        "génie civil", "btp", "construction", "bâtiment", "structure", "chantier", "ouvrage",
        "travaux", "architecte", "immobilier", "fondation", "pont", "route", "hydraulique",
        "géotechnique", "topographie", "autocad", "revit", "bim", "béton", "armé", "coffreur",
        "maçon", "vrd", "conducteur", "chef de chantier", "second œuvre", "gros œuvre",
        "matériaux", "bureau d'études", "métreur", "structure", "urbain", "aménagement"],
    "genie_industriel": [
        "production", "industriel", "maintenance", "qualité", "méthode", "amélioration",
        "continue", "lean", "supply chain", "logistique", "stock", "approvisionnement",
        "planification", "ordonnancement", "kaizen", "six sigma", "usine", "atelier",
        "fabrication", "process", "procédé", "performance", "productivité", "efficience",
        "fiabilité", "sécurité", "ergonomie", "environnement", "iso", "norme", "5s"],
}

DOMAIN_SKILLS = {
    "informatique_reseaux": [
        "programmation", "développement web", "devops", "cloud", "cybersécurité",
        "bases de données", "réseaux", "systèmes", "machine learning", "data science"],
    "automatismes_info_industrielle": [
        "automates", "PLC", "SCADA", "robotique", "IIoT", "supervision",
        "électronique", "instrumentation", "capteurs", "actionneurs"],
    "finance": [
        "comptabilité", "contrôle de gestion", "analyse financière", "audit",
        "trésorerie", "fiscalité", "reporting", "budgétisation", "ERP financier"],
    "genie_civil_btp": [
        "structure", "béton", "construction", "géotechnique", "hydraulique",
        "thermique", "BIM", "chantier", "matériaux", "environnement"],
    "genie_industriel": [
        "production", "qualité", "maintenance", "logistique", "méthodes",
        "amélioration continue", "lean", "gestion de projet", "supply chain"],
}

# keyword classifier used when no analysis service answers (scores 0.5 + bonuses)
FALLBACK_KEYWORDS = {
    "informatique_reseaux": [
        "python", "java", "javascript", "html", "css", "php", "ruby", "c++", "c#",
        "développeur", "software", "frontend", "backend", "fullstack", "web", "mobile",
        "cloud", "devops", "aws", "azure", "docker", "kubernetes", "linux", "windows",
        "réseau", "network", "cisco", "cybersécurité", "sécurité", "security", "data",
        "database", "sql", "nosql", "mongodb", "mysql", "postgresql", "oracle", "git"],
    "automatismes_info_industrielle": [
        "automatisme", "automate", "plc", "api", "scada", "supervision", "vba", "hmi",
        "modbus", "profinet", "profibus", "ethernet/ip", "siemens", "schneider", "rockwell",
        "automation", "robot", "abb", "kuka", "fanuc", "step7", "tia portal", "unity",
        "grafcet", "électrotechnique", "électrique", "électronique", "capteur", "actionneur"],
    "finance": [
        "finance", "comptabilité", "comptable", "audit", "analyste", "financial", "accounting",
        "bilan", "trésorerie", "fiscal", "impôt", "taxe", "budget", "forecast", "prévision",
        "contrôle", "contrôleur", "gestion", "management", "reporting", "kpi", "tableau de bord",
        "sap", "sage", "cegid", "consolidation", "ifrs", "us gaap", "pcg", "bâle", "solvabilité"],
    "genie_civil_btp": [
        "génie civil", "btp", "bâtiment", "travaux publics", "construction", "chantier",
        "béton", "structure", "fondation", "maçonnerie", "charpente", "menuiserie", "plomberie",
        "électricité", "hvac", "autocad", "revit", "bim", "sketchup", "archicad", "catia",
        "génie", "géotechnique", "topographie", "architecture", "urbanisme", "environnement"],
    "genie_industriel": [
        "génie industriel", "production", "fabrication", "usine", "atelier", "lean", "kaizen",
        "5s", "six sigma", "qualité", "iso", "supply chain", "logistique", "stock", "inventory",
        "amélioration continue", "maintenance", "méthodes", "temps", "ergonomie", "sécurité",
        "hse", "environnement", "gestion projet", "planification", "ordonnancement", "mrp", "erp"],
}

TECHNICAL_SKILLS = [
    "Python", "Java", "JavaScript", "HTML", "CSS", "PHP", "Ruby", "C++", "C#", ".NET",
    "React", "Angular", "Vue.js", "Node.js", "Django", "Flask", "Spring", "Laravel",
    "AWS", "Azure", "GCP", "Docker", "Kubernetes", "Git", "DevOps", "CI/CD", "Jenkins",
    "MongoDB", "MySQL", "PostgreSQL", "SQL Server", "Oracle", "Redis", "ElasticSearch",
    "Machine Learning", "Deep Learning", "TensorFlow", "PyTorch", "NLP", "Data Science",
    "Linux", "Windows", "macOS", "Bash", "PowerShell", "Agile", "Scrum", "Kanban",
    "PLC", "SCADA", "HMI", "Siemens", "Allen Bradley", "Schneider", "Fanuc", "ABB",
    "TIA Portal", "Step7", "Unity Pro", "RSLogix", "Factory Talk", "WinCC", "Ignition",
    "Modbus", "Profinet", "Profibus", "EtherNet/IP", "OPC UA", "MQTT", "IoT", "IIoT",
    "SAP", "SAP FI", "SAP CO", "Oracle Finance", "Sage", "Cegid", "NAV", "Dynamics",
    "Excel VBA", "Power BI", "Tableau", "Qlik", "IFRS", "US GAAP", "PCG", "Consolidation",
    "AutoCAD", "Revit", "BIM", "SketchUp", "ArchiCAD", "CATIA", "Tekla", "Robot",
    "Abaqus", "ETABS", "SAP2000", "STAAD.Pro", "Plaxis", "MS Project", "Primavera",
    "ERP", "MRP", "GMAO", "GPAO", "SAP MM", "SAP PP", "SAP QM", "SAP PM", "SAP WM",
    "Lean", "Six Sigma", "Kaizen", "5S", "SMED", "TPM", "TQM", "JIT", "Kanban",
    "ISO 9001", "ISO 14001", "ISO 45001", "HACCP", "BRC", "IFS", "IATF 16949",
]

COMMON_SKILLS = [
    "Python", "Java", "JavaScript", "C++", "C#", "SQL", "PHP", "Ruby", "Swift",
    "Kotlin", "TypeScript", "HTML", "CSS", "Angular", "React", "Vue.js", "Node.js",
    "Django", "Flask", "Spring", "AWS", "Azure", "GCP", "Docker", "Kubernetes",
    "Git", "Linux", "DevOps", "CI/CD", "Jenkins", "Terraform", "Ansible",
    "Machine Learning", "Deep Learning", "TensorFlow", "PyTorch", "Data Science",
    "Agile", "Scrum", "Product Management", "Communication", "Leadership",
    "Problem Solving", "Team Management", "Project Management",
]

# sub-domain vocabulary of the basic analyser (+1 per keyword, +0.5 per skill)
IDENTIFY_BASIC = {
    "informatique_reseaux": ["réseau", "network", "systèmes", "infrastructure", "cloud"],
    "developpement_web": ["web", "html", "css", "javascript", "php", "react", "angular"],
    "data_science": ["data", "machine learning", "statistique", "python", "tensorflow", "pytorch"],
    "cybersecurite": ["sécurité", "security", "hacking", "cryptographie", "firewall"],
    "ia": ["intelligence artificielle", "ai", "machine learning", "deep learning"],
}

COMMON_TITLES = [
    "Développeur", "Ingénieur", "Architecte", "Chef de projet",
    "Data Scientist", "DevOps", "Admin Système", "Admin Réseau",
    "Consultant", "Analyste", "Full Stack", "Frontend", "Backend",
    "Tech Lead", "Product Owner", "Scrum Master",
]
DEFAULT_TITLES = ["Développeur", "Ingénieur Logiciel", "Consultant IT"]
DEFAULT_SKILLS_EXTENDED = ["Data Science", "Agile", "Scrum"]

# keyword -> weight per CV domain, used by the weighted scorer
WEIGHTED_DOMAIN_KEYWORDS = {
    "informatique_reseaux": {
        "développeur": 0.08, "programmeur": 0.07, "informatique": 0.05,
        "logiciel": 0.06, "web": 0.05, "cloud": 0.06, "devops": 0.07,
        "data": 0.05, "système": 0.04, "réseau": 0.05, "fullstack": 0.07,
        "backend": 0.06, "frontend": 0.06, "application": 0.05,
        "python": 0.07, "java": 0.06, "javascript": 0.06, "c++": 0.05,
        "php": 0.05, "react": 0.06, "angular": 0.06, "node": 0.06,
        "database": 0.05, "sql": 0.05, "nosql": 0.05, "django": 0.06,
        "machine learning": 0.07, "intelligence artificielle": 0.07},
    "automatismes_info_industrielle": {
        "automaticien": 0.08, "robot": 0.07, "automate": 0.08,
        "production": 0.05, "industrie": 0.05, "maintenance": 0.06,
        "système embarqué": 0.07, "plc": 0.08, "scada": 0.08,
        "siemens": 0.07, "schneider": 0.07, "abb": 0.07,
        "supervision": 0.06, "contrôle": 0.05, "industrielle": 0.05},
    "finance": {
        "finance": 0.08, "comptable": 0.08, "comptabilité": 0.08,
        "audit": 0.07, "analyste": 0.06, "financier": 0.07,
        "budget": 0.06, "investissement": 0.06, "banque": 0.05,
        "trésorerie": 0.07, "fiscal": 0.07, "gestion": 0.05,
        "contrôle de gestion": 0.08, "ifrs": 0.07, "consolidation": 0.06},
    "genie_civil_btp": {
        "btp": 0.08, "construction": 0.08, "génie civil": 0.08,
        "chantier": 0.07, "bâtiment": 0.07, "architecte": 0.06,
        "infrastructure": 0.06, "structure": 0.07, "béton": 0.06,
        "travaux": 0.05, "ouvrage": 0.06, "immobilier": 0.05},
    "genie_industriel": {
        "production": 0.08, "ingénieur": 0.06, "procédé": 0.06,
        "qualité": 0.07, "méthode": 0.06, "industriel": 0.07,
        "supply chain": 0.07, "lean": 0.07, "amélioration continue": 0.06,
        "maintenance": 0.06, "logistique": 0.07, "process": 0.06},
}

# domain vocabulary of the page scraper (occurrence counts, null when nothing hits)
SCRAPER_DOMAINS = {
    "informatique_reseaux": ["informatique", "développeur", "software", "web", "python", "java",
                             "javascript", "devops", "cloud", "réseau", "cybersécurité", "IT"],
    "automatismes_info_industrielle": ["automatisme", "automaticien", "automate", "plc", "scada",
                                       "robot", "industrie 4.0"],
    "finance": ["finance", "comptabilité", "comptable", "audit", "analyste financier",
                "contrôle de gestion"],
    "genie_civil_btp": ["génie civil", "btp", "bâtiment", "construction", "structure", "architecte"],
    "genie_industriel": ["production", "lean", "qualité", "maintenance", "supply chain", "logistique"],
}

# embedding-side text classifier (distinct keywords present, confidence = min(1, n/5))
CLASSIFY_KEYWORDS = {
    "informatique_reseaux": ["informatique", "réseau", "devops", "docker", "kubernetes", "cloud",
                             "développeur", "python", "javascript"],
    "automatismes_info_industrielle": ["automatisme", "siemens", "automate", "scada", "industriel",
                                       "tia portal", "s7"],
    "finance": ["finance", "bancaire", "investissement", "analyste", "financier", "économie",
                "budget", "comptabilité"],
    "civil_btp": ["génie civil", "btp", "structure", "bâtiment", "construction", "chantier", "béton",
                  "architecture"],
    "genie_industriel": ["production", "industrielle", "lean", "logistique", "supply chain",
                         "amélioration continue", "usine"],
}

CITIES_BY_COUNTRY = {
    "fr": ["Paris", "Lyon", "Marseille", "Toulouse", "Nice", "Nantes", "Strasbourg", "Montpellier",
           "Bordeaux", "Lille"],
    "ma": ["Casablanca", "Rabat", "Marrakech", "Tanger", "Fès", "Meknès", "Agadir", "Tétouan",
           "Oujda", "Kénitra", "El Jadida", "Mohammedia"],
}
COUNTRY_NAMES = {"fr": "France", "ma": "Maroc"}

CATEGORY_MAPPING = {
    "IT": "informatique_reseaux",
    "Data Science": "informatique_reseaux",
    "Computer Engineering": "informatique_reseaux",
    "Finance": "finance",
    "Civil Engineering": "civil_btp",
    "Industrial Engineering": "genie_industriel",
    "Automation": "automatismes_info_industrielle",
    "Mechanical": "genie_industriel",
    "Accountant": "finance",
    "Business Analyst": "finance",
    "DevOps Engineer": "informatique_reseaux",
    "Network Engineer": "informatique_reseaux",
    "Software Engineer": "informatique_reseaux",
    "Database Administrator": "informatique_reseaux",
    "Web Developer": "informatique_reseaux",
    "Electrical Engineer": "automatismes_info_industrielle",
    "Mechatronics": "automatismes_info_industrielle",
    "Civil Engineer": "civil_btp",
    "Construction Manager": "civil_btp",
}

TRAINING_DOMAINS = ["informatique_reseaux", "automatismes_info_industrielle", "finance",
                    "civil_btp", "genie_industriel"]

JOB_TITLE_QUERY = {
    "informatique_reseaux": "développeur OR devops OR ingénieur",
    "automatismes_info_industrielle": "automaticien OR robotique OR programmation",
    "finance": "finance OR comptable OR audit",
    "genie_civil_btp": "génie civil OR btp OR construction",
    "genie_industriel": "ingénieur OR production OR logistique",
}
DEFAULT_SEARCH_QUERY = "développeur OR ingénieur"

# salary patterns, tried in order, case-insensitive, group 1 stripped
SALARY_PATTERNS = [
    r"(\d+\s*[kK€][\s\-àa]*\d+\s*[kK€])",
    r"(\d+\s*[kK€])",
    r"(\d+\s*000[\s\-àa]*\d+\s*000[\s€]*)",
    r"(\d+\s*000[\s€]*)",
    r"(\d+[\s\-àa]*\d+[\s]*[€KDHdh]*)",
    r"(entre[\s]+\d+[\s]*[€KDHdh]*[\s\-àaet]+\d+[\s]*[€KDHdh]*)",
]

CV_TEMPLATES = [
    "Analyse ce CV pour un poste en {domain}.",
    "Évalue les compétences de ce candidat pour {domain} :",
    "Pour un rôle en {domain}, que penses-tu de ce profil ?",
    "Examine cette candidature pour {domain}.",
    "Donne ton avis sur ce CV pour un poste en {domain}.",
]
JOB_TEMPLATES = [
    "Analyse cette offre d'emploi en {domain}.",
    "Évalue les compétences requises pour ce poste en {domain} :",
    "Quelles sont les exigences clés de cette offre en {domain} ?",
    "Examine cette description de poste en {domain}.",
    "Résume les qualifications demandées pour ce rôle en {domain}.",
]
CV_INSTRUCTION_TERMS = ["cv", "candidat", "profil", "candidature"]

# chat request intent, first matching group wins
INTENT_KEYWORDS = [
    ("competences", ["compétence", "skill", "capacité", "savoir-faire"]),
    ("entretien", ["entretien", "interview", "question", "embauche"]),
]

# offer-card layouts: (tag, css class) alternatives tried in order per field
JOB_SITE_SELECTORS = {
    "card": [("div", "job_seen_beacon"), ("div", "jobsearch-SerpJobCard")],
    "title": [("h2", "jobTitle"), ("a", "jobtitle")],
    "company": [("span", "companyName"), ("span", "company")],
    "location": [("div", "companyLocation"), ("div", "location")],
    "description": [("div", "job-snippet"), ("div", "summary")],
    "link": [("a", "jcs-JobTitle"), ("a", "jobtitle")],
}
SAMPLE_CARD_SELECTORS = {
    "card": [("div", "job-card")],
    "title": [("h2", "job-title")],
    "company": [("div", "company-name")],
    "location": [("div", "job-location")],
    "description": [("div", "job-description")],
    "link": [("a", None)],
}

DISPLAY_NAMES = {
    "informatique_reseaux": "Informatique & Réseaux",
    "automatismes_info_industrielle": "Automatismes & Info. Industrielle",
    "finance": "Finance",
    "genie_civil_btp": "Génie Civil & BTP",
    "genie_industriel": "Génie Industriel",
}

# ---------------------------------------------------------------------------
# builders
# ---------------------------------------------------------------------------

VOCAB_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("domain_ord", T.IntegerType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("kw_ord", T.IntegerType(), False),
    T.StructField("kw", T.StringType(), False),          # lower-cased match form
    T.StructField("weight", T.DoubleType(), True),
])


def vocab_rows(vocab) -> list[tuple]:
    """Flatten ``{domain: [kw...]}`` or ``{domain: {kw: w}}`` to ordered rows.

    Duplicated keywords are kept: they count twice, as in the source tables.
    """
    rows = []
    for d_ord, (domain, kws) in enumerate(vocab.items()):
        items = kws.items() if isinstance(kws, dict) else ((k, None) for k in kws)
        for k_ord, (kw, w) in enumerate(items):
            rows.append((domain, d_ord, kw, k_ord, kw.lower(), None if w is None else float(w)))
    return rows


def vocab_frame(spark: SparkSession, vocab) -> DataFrame:
    """The vocabulary as a DataFrame (a literal: size known at plan time)."""
    return spark.createDataFrame(vocab_rows(vocab), VOCAB_SCHEMA)


def skill_frame(spark: SparkSession, skills: list[str]) -> DataFrame:
    """An ordered skill list as ``(skill, skill_ord, kw)``."""
    return spark.createDataFrame(
        [(s, i, s.lower()) for i, s in enumerate(skills)],
        "skill string, skill_ord int, kw string")


def canonical_domain_map(aliases=None) -> dict:
    return dict(DOMAIN_ALIASES if aliases is None else aliases)

# FIXED VALUES — stop words of the key-term extractor
KEY_TERM_STOP_WORDS = ["le", "la", "les", "un", "une", "des", "et", "ou", "de", "du", "ce", "cette", "ces"]

# FIXED VALUES: words by which columns of training files are found, and the columns of known files
TRAINING_COLUMN_WORDS = {
    "text": ["description", "resume", "text"],
    "category": ["category", "role", "job_title"],
    "skills": ["skills", "competences", "requirements"],
}
KNOWN_TRAINING_FILES = {
    "job_descriptions.csv": {"text": "job_description", "category": "category", "skills": "skills_required"},
    "Resume.csv": {"text": "Resume", "category": "Category"},
    "job_skills.csv": {"text": "job_description", "skills": "skills"},
    "job_postings.csv": {"text": "job_description", "category": "role"},
}
