"""Default heading tables, made by rule: plain nouns under common qualifiers.

Every operator takes other tables as arguments.
"""

from __future__ import annotations

from collections.abc import Iterable


def phrases(nouns: Iterable[str], qualifiers: Iterable[str] = ()) -> tuple[str, ...]:
    """Each noun alone and under each qualifier."""
    return tuple(f"{q} {n}".strip() for n in nouns for q in ("", *qualifiers))


#: Kinds of resume sections; one table for section and experience operators.
EXPERIENCE = phrases(("experience", "employment", "internship"), ("work", "professional", "industry")) + phrases(("history",), ("work", "job"))[1:]
PROJECTS = phrases(("projects",), ("own", "team", "student"))
SKILLS = phrases(("skills", "tools"), ("technical", "main", "software"))
OTHER = phrases(("education", "training", "languages", "references", "summary", "interests", "awards", "certificates", "publications")) + SKILLS
RESUME = {**dict.fromkeys(OTHER, "other"), **dict.fromkeys(PROJECTS, "projects"), **dict.fromkeys(EXPERIENCE, "experience")}
MAJOR = tuple(h for h in RESUME if h not in SKILLS)

#: What a job text asks for, headings that come before others, and headings that end the part.
ASKED = phrases(("requirements", "qualifications", "skills"), ("required", "minimum", "compulsory")) + ("must have",)
FIRST = phrases(("skills", "requirements"), ("compulsory",))
FIRST = tuple(h for h in FIRST if " " in h)
#: Parts of a job text that are not asked for, named by what an employer offers or describes; EXTENDABLE ones may have more words behind them.
BOUNDARIES = tuple(dict.fromkeys(
    phrases(("team", "office", "offer", "product"), ("our", "about our")) + phrases(("tasks", "goals", "rewards", "hours"), ("daily", "your"))
    + phrases(("skills", "qualifications"), ("optional", "extra")) + tuple(f"about {x}" for x in ("the company", "the team", "the work"))))
BOUNDARIES = tuple(b for b in BOUNDARIES if b not in ASKED)
EXTENDABLE = tuple(b for b in BOUNDARIES if " " in b or b.endswith("s"))
