"""Declared schemas of the data model."""

from __future__ import annotations

from winnow import fixed_values as fixed

SKILL_ENTRY = "category string, skills array<string>"
PROJECT_ENTRY = "project_name string, tech_stack array<string>, description string"
RESPONSIBILITY_ENTRY = "context_title string, responsibilities array<string>"
CHALLENGE_ENTRY = "title string, scenario string, solution string, impact string"
MISC_ENTRY = "category string, content string"

PROFILE_ENTRIES = {
    "skills": SKILL_ENTRY,
    "projects": PROJECT_ENTRY,
    "responsibilities": RESPONSIBILITY_ENTRY,
    "challenges": CHALLENGE_ENTRY,
    "misc": MISC_ENTRY,
}

# A store row: whose entry it is and its place among theirs.
ENTRY_KEY = "candidate_id bigint, seq bigint"
STORED = {table: f"{ENTRY_KEY}, {entry}" for table, entry in PROFILE_ENTRIES.items()}

# Parsed resume: what an extraction step hands to the fan-out.
PARSED_RESUME = """
    candidate_id bigint,
    roles array<string>,
    categorized_skills array<struct<category:string,skills:array<string>>>,
    projects array<struct<project_name:string,tech_stack:array<string>,description:string>>,
    responsibilities array<struct<role_title:string,responsibilities:array<string>>>,
    misc array<struct<category:string,content:string>>
"""

# Model -> column -> (required, default). A required column has no default.
REQUIRED = object()
MODELS = {
    "screening": {
        "company_name": ("string", REQUIRED),
        "candidate_name": ("string", REQUIRED),
        "job_title": ("string", REQUIRED),
        "candidate_experience": ("double", REQUIRED),
        "experience_required": ("double", fixed.DEFAULT_REQUIRED_YEARS),
        "skill_match": ("double", 0.0),
        "required_skills": ("array<string>", []),
        "candidate_skills": ("array<string>", []),
        "matched_skills": ("array<string>", []),
        "detected_roles": ("array<string>", []),
    },
    "skill_entry": {"category": ("string", REQUIRED), "skills": ("array<string>", [])},
    "project_entry": {
        "project_name": ("string", REQUIRED),
        "tech_stack": ("array<string>", []),
        "description": ("string", REQUIRED),
    },
    "challenge_entry": {
        "title": ("string", REQUIRED),
        "scenario": ("string", REQUIRED),
        "solution": ("string", REQUIRED),
        "impact": ("string", REQUIRED),
    },
    "responsibility_entry": {
        "role_title": ("string", REQUIRED),
        "responsibilities": ("array<string>", []),
    },
    "misc_entry": {"category": ("string", REQUIRED), "content": ("string", REQUIRED)},
    "linkedin_reply": {
        "headline": ("string", ""),
        "about_section": ("string", ""),
        "featured_hashtags": ("array<string>", []),
    },
    "resume_reply": {
        "professional_summary": ("string", ""),
        "highlighted_bullets": ("array<string>", []),
        "technical_skills_formatted": ("string", ""),
    },
    "readme_reply": {"markdown_readme": ("string", "")},
    "job_description": {
        "job_title": ("string", fixed.JOB_TITLE_DEFAULT),
        "years_experience_required": ("double", 0.0),
        "required_skills": ("array<string>", []),
        "job_overview": ("string", ""),
    },
    "code_proof": {
        "requirement": ("string", REQUIRED),
        "project_name": ("string", REQUIRED),
        "file_path": ("string", REQUIRED),
        "code_snippet": ("string", REQUIRED),
        "interview_talking_points": ("string", REQUIRED),
    },
    "feedback": {
        "missing_skills": ("array<string>", []),
        "suggestions": ("string", fixed.DEFAULT_SUGGESTIONS),
    },
    "critique": {
        "is_valid_gap": ("boolean", True),
        "critique_notes": ("string", fixed.DEFAULT_CRITIQUE_NOTES),
    },
}
