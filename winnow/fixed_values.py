"""Fixed values.

Everything here is a constant that results depend on: word lists, thresholds,
caps, default texts and entity names. They are data, kept in one place and in
their natural order, so that no operator hides a literal of its own.
"""

# --- screening -------------------------------------------------------------
SHORTLIST_MIN_SCORE = 0.5
DEFAULT_REQUIRED_YEARS = 8.0
DEFAULT_CANDIDATE_YEARS = 0.0
ROUTE_SHORTLIST = "ShortList"
ROUTE_REJECT = "Reject"
MESSAGE_SHORTLIST = "Shortlisted for %s at %s - %s"
MESSAGE_REJECT = "Rejected for %s at %s - %s"
DEFAULT_ROLES = ["Lead AI Engineer", "Software Engineer", "General Professional Experience"]

# Where skills are looked for, in order; a nested name is struct.field.
SKILL_SOURCES = [
    "matched_skills",
    "candidate_skills",
    "resume_skills",
    "skills",
    "extracted_skills",
    "required_skills",
    "resume_data.skills",
    "resume_data.core_skills",
    "resume_analysis.skills",
    "resume_analysis.core_skills",
]
LIST_ONLY_SOURCES = ["matched_skills", "candidate_skills"]

# --- seniority fallback ----------------------------------------------------
SENIORITY_TITLE = "Lead AI Engineer"
SENIORITY_TITLE_DEFAULT = "AI Engineer"
SENIORITY_YEARS = [(("lead", "principal"), 8.0), (("senior",), 5.0)]
SENIORITY_YEARS_DEFAULT = 0.0

# --- patterns, in Python's notation ----------------------------------------
HANDLE_PATTERN = r"github\.com/([a-zA-Z0-9_-]+)"
POSTING_PATTERN = r"(?:/jobs/view/|currentJobId=)(\d+)"
IMAGE_PATTERN = r"!\[.*?\]\(.*?\)"
LINK_PATTERN = r"\[(.*?)\]\(https?://\S+\)"
ADDRESS_PATTERN = r"https?://\S+"
TAG_PATTERN = r"<[^>]+>"
BLANK_LINES_PATTERN = r"\n\s*\n"

# --- page text -------------------------------------------------------------
BOILERPLATE_PHRASES = [
    "accept cookies",
    "privacy policy",
    "terms of service",
    "manage preferences",
    "all rights reserved",
]
WEB_DROP_TAGS = ["script", "style", "nav", "footer", "header", "form", "aside", "svg"]
POSTING_DROP_TAGS = ["script", "style", "button", "nav"]
BODY_DROP_TAGS = ["script", "style", "head"]
WEB_MIN_CHARS = 100
POSTING_MIN_CHARS = 150
JD_TEXT_CAP = 3500
WEB_TITLE = "Position (Scraped via Web Fallback)"
POSTING_TITLE_DEFAULT = "LinkedIn Job Position"
BODY_TITLE_DEFAULT = "Job Position"
JOB_TITLE_DEFAULT = "Job Position"

# --- gap report ------------------------------------------------------------
NO_MISSING_SKILLS = "No specific technical skills flagged."
DEFAULT_SUGGESTIONS = "Focus on building hands-on projects related to core JD requirements."
DEFAULT_CRITIQUE_NOTES = "Verified skill gaps against candidate resume."
FLAG_VALID_GAP = "NO_GAPS_FOUND"
FLAG_WRONG_GAP = "MISIDENTIFIED_GAP"
MAX_REFLECTIONS = 2

# --- personal data ---------------------------------------------------------

# --- code search -----------------------------------------------------------
README_NAME = "README.md"
CODE_EXTENSIONS = ["py", "ts", "js", "swift", "ipynb"]
VENDOR_PATH_PARTS = [".venv", "node_modules", ".git", "build", "dist"]
MIN_TERM_CHARS = 3
MAX_PROJECTS = 15
MAX_HITS_PER_SKILL = 3
MAX_PROOF_SKILLS = 4
SNIPPET_BEFORE = 8
SNIPPET_AFTER = 7
README_OVERVIEW_CHARS = 400

# --- repositories ----------------------------------------------------------
ACTIVITY_CUTOFF = "2026-01-01"
MAX_REPOS_SEARCHED = 100
MAX_REPOS_SHOWN = 10
MAX_COMMITS_SHOWN = 5
COMMIT_MESSAGE_CHARS = 60
COMMIT_SHA_CHARS = 7
DAY_CHARS = 10
NO_DESCRIPTION = "No description provided."
NO_LANGUAGE = "N/A"
NO_NAME = "N/A"
NO_URL = "#"
NO_COMMIT_MESSAGE = "No commit message"
UNKNOWN_AUTHOR = "Unknown"

# --- profile store ---------------------------------------------------------
PROFILE_TABLES = ["skills", "projects", "responsibilities", "challenges", "misc"]
DEFAULT_CONTEXT_TITLE = "General Experience"
PROJECT_STACK_CATEGORY = "Project Stack (%s)"
ROLE_CONTEXT_TITLE = "Role Context #%d"

# --- vectors ---------------------------------------------------------------
VECTOR_DIMENSION = 384
