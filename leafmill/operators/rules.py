"""Folders and rules by which documents are organised: data, which callers may replace."""

from __future__ import annotations

# The folder tree, as (id, name, children).
FOLDERS = (
    ("all-files", "All Files", ()), ("review-needed", "Review Needed", ()),
    ("exam-papers", "Exam Papers", (
        ("exam-papers-jee", "JEE"), ("exam-papers-university", "University"), ("exam-papers-computer-science", "Computer Science"),
        ("exam-papers-mathematics", "Mathematics"), ("exam-papers-physical-education", "Physical Education"),
        ("exam-papers-engineering", "Engineering"), ("exam-papers-other", "Other Exam Papers"))),
    ("assignments", "Assignments", (
        ("assignments-computer-science", "Computer Science"), ("assignments-python", "Python"), ("assignments-mathematics", "Mathematics"),
        ("assignments-engineering", "Engineering"), ("assignments-other", "Other Assignments"))),
    ("lab-manuals", "Lab Manuals", (
        ("lab-manuals-computer-science", "Computer Science"), ("lab-manuals-computer-organization", "Computer Organization"),
        ("lab-manuals-engineering", "Engineering"), ("lab-manuals-other", "Other Lab Manuals"))),
    ("notes-books", "Notes & Books", (
        ("notes-computer-science", "Computer Science"), ("notes-theory-of-computation", "Theory of Computation"),
        ("notes-computer-organization", "Computer Organization"), ("notes-mathematics", "Mathematics"),
        ("notes-physical-education", "Physical Education"), ("notes-english", "English"), ("notes-engineering", "Engineering"),
        ("notes-other", "Other Notes"))),
    ("academic-records", "Academic Records", (
        ("academic-records-marksheets", "Marksheets & Results"), ("academic-records-applications", "Applications & Admissions"),
        ("academic-records-toppers", "Toppers Lists"))),
    ("certificates", "Certificates", ()), ("career-interview", "Career & Interview", ()),
    ("code-projects", "Code & Projects", (("code-android", "Android"), ("code-web", "Web"), ("code-programming", "Programming"))),
    ("medical", "Medical", ()), ("images", "Images", ()), ("documents", "Documents", ()), ("presentations", "Presentations", ()),
    ("spreadsheets", "Spreadsheets", ()), ("other", "Other", ()),
)

# Document types, each with its least score and weighted terms.
TYPES = {
    "certificate": (7, {"certificate of completion": 10, "certificate": 8, "certification": 6, "awarded": 4, "participation": 4,
                        "verify certificate": 5, "certificate id": 6}),
    "academic-record": (8, {"marksheet": 10, "mark sheet": 10, "result": 6, "toppers": 8, "subject toppers": 10, "application form": 8,
                            "admission": 5, "counselling": 5, "roll no": 5, "student id": 4, "marks obtained": 6, "guardian": 3}),
    "assignment": (6, {"assignment": 10, "homework": 8, "submit": 4, "submission": 4, "deadline": 5, "rubric": 5}),
    "lab-manual": (7, {"lab manual": 10, "laboratory manual": 10, "experiment": 6, "experiment no": 8, "practical": 5, "procedure": 3,
                       "observation": 3}),
    "exam-paper": (7, {"question paper": 10, "paper code": 8, "paper": 5, "pyq": 9, "pyqs": 9, "previous year": 6, "solutions": 6, "exam": 5,
                       "examination": 6, "semester": 5, "maximum marks": 7, "attempt any": 6, "section": 2}),
    "career": (7, {"interview questions": 10, "interview": 7, "resume": 7, "assessment center": 8, "assessmentcenterreport": 10,
                   "candidate": 4, "job": 4, "communication skills": 4}),
    "medical": (7, {"patient": 8, "prescription": 9, "medicine": 6, "tablet": 5, "dosage": 6, "laboratory test report": 8, "hemoglobin": 7,
                    "leucocyte": 7}),
    "code-project": (6, {"#include": 10, "public static void": 10, "doctype html": 8, "android": 6, "gradle": 7, "junit": 6,
                         "source code": 8, "function": 3, "class": 2, "import": 2}),
    "notes-book": (7, {"notes": 9, "chapter": 7, "unit": 4, "lecture": 7, "book": 6, "grammar": 6, "definition": 4, "advantages": 3,
                       "features": 3, "cbseguide": 7}),
}

# Subjects; any score counts.
SUBJECTS = {
    "jee": {"jee": 10, "iit": 5, "nta": 5, "xii pass": 6, "xii": 3},
    "python": {"python": 10, "list": 2, "tuple": 3, "dictionary": 3},
    "android": {"android": 10, "kotlin": 8, "gradle": 7, "junit": 5, "resizer": 4},
    "web": {"html": 8, "css": 8, "javascript": 7, "frontend": 8, "react": 7},
    "algorithms": {"algorithm": 8, "data structure": 8, "dsa": 9, "leetcode": 8, "postfix": 7, "stack": 5, "queue": 4, "tree": 4, "graph": 4},
    "operating-systems": {"operating system": 10, "deadlock": 8, "banker algorithm": 8, "paging": 6, "semaphore": 6, "process scheduling": 7},
    "theory-of-computation": {"turing machine": 10, "turing": 6, "automata": 8, "finite control": 8, "grammar": 5, "regular language": 6,
                              "read write head": 8},
    "computer-organization": {"computer organization": 10, "coa": 9, "architecture": 5, "microprocessor": 7, "cpu": 5, "memory hierarchy": 6},
    "mathematics": {"mathematics": 9, "maths": 9, "calculus": 7, "statistics": 8, "differential": 6, "integral": 6, "bas102": 7,
                    "bas 102": 7, "bas202": 7, "bas 202": 7, "bas403": 7, "bas 403": 7},
    "physical-education": {"physical education": 10, "sports": 7, "yoga": 7, "asana": 7, "tournament": 6, "cbseguide": 5},
    "english": {"english": 9, "grammar": 8, "noun": 5, "verb": 5, "sentence": 5},
    "engineering": {"engineering": 6, "sensor": 7, "instrumentation": 7, "mechatronics": 7, "mechanical": 5, "electronics": 5, "bme101": 8,
                    "bve301": 8, "bve 301": 8},
    "computer-science": {"computer science": 8, "bcs": 7, "bcs303": 8, "bcs 303": 8, "bcs402": 8, "bcs 402": 8, "programming": 5, "database": 5},
    "admissions": {"admission": 8, "application form": 8, "uptac": 8, "counselling": 7, "seat": 4},
}

# Where a type's documents of a subject go, and where else.
SUBJECT_FOLDERS = {
    "exam-paper": {"jee": "exam-papers-jee", "computer-science": "exam-papers-computer-science", "algorithms": "exam-papers-computer-science",
                   "operating-systems": "exam-papers-computer-science", "theory-of-computation": "exam-papers-computer-science",
                   "computer-organization": "exam-papers-computer-science", "mathematics": "exam-papers-mathematics",
                   "physical-education": "exam-papers-physical-education", "engineering": "exam-papers-engineering"},
    "assignment": {"python": "assignments-python", "computer-science": "assignments-computer-science",
                   "algorithms": "assignments-computer-science", "operating-systems": "assignments-computer-science",
                   "theory-of-computation": "assignments-computer-science", "computer-organization": "assignments-computer-science",
                   "mathematics": "assignments-mathematics", "engineering": "assignments-engineering", "jee": "assignments-other"},
    "lab-manual": {"computer-organization": "lab-manuals-computer-organization", "computer-science": "lab-manuals-computer-science",
                   "algorithms": "lab-manuals-computer-science", "python": "lab-manuals-computer-science",
                   "android": "lab-manuals-computer-science", "engineering": "lab-manuals-engineering"},
    "notes-book": {"theory-of-computation": "notes-theory-of-computation", "computer-organization": "notes-computer-organization",
                   "computer-science": "notes-computer-science", "algorithms": "notes-computer-science",
                   "operating-systems": "notes-computer-science", "python": "notes-computer-science", "mathematics": "notes-mathematics",
                   "physical-education": "notes-physical-education", "english": "notes-english", "engineering": "notes-engineering",
                   "jee": "notes-other"},
    "code-project": {"android": "code-android", "web": "code-web", "python": "code-programming", "computer-science": "code-programming",
                     "algorithms": "code-programming"},
}
TYPE_FOLDERS = {
    "exam-paper": "exam-papers-university", "assignment": "assignments-other", "lab-manual": "lab-manuals-other", "notes-book": "notes-other",
    "certificate": "certificates", "academic-record": "academic-records", "career": "career-interview", "medical": "medical",
    "code-project": "code-projects",
}
RECORD_FOLDERS = (
    ("academic-records-marksheets", ("marksheet", "mark sheet", "result", "marks obtained", "internal marks", "consolidated internal marks")),
    ("academic-records-applications", ("application form", "applicationform", "admission", "uptac", "counselling")),
    ("academic-records-toppers", ("toppers", "subject toppers", "rank")),
)
CODE_EXTENSIONS = ".c .cpp .cs .css .go .h .hpp .html .java .js .jsx .kt .php .py .rb .rs .sql .swift .ts .tsx .xml".split()
FILE_FOLDERS = {
    "images": ".bmp .gif .jpeg .jpg .png .tif .tiff .webp".split(), "spreadsheets": ".csv .ods .xls .xlsx".split(),
    "documents": ".doc .docx .md .odt .pdf .rtf .txt".split(), "presentations": ".odp .ppt .pptx".split(),
}
# Categories in order, with weighted substrings, and the folder that a category adds to.
CATEGORIES = {
    "Certificate": {"certificate": 5, "participation": 3, "congratulations": 3, "organisation": 3, "organization": 3, "participant": 2, "summit": 2},
    "Resume": {"education": 2, "skills": 2, "experience": 2, "projects": 2},
    "Technical": {"database": 3, "sql": 3, "system": 2, "design": 2},
    "Medical": {"patient": 3, "hemoglobin": 3},
    "Identity": {"aadhaar": 4, "permanent account number": 4},
}
CATEGORY_FOLDERS = {"Certificate": ("certificates", 3.0), "Identity": ("documents", 1.5), "Medical": ("medical", 1.5),
                    "Resume": ("career-interview", 1.5), "Technical": ("code-projects", 1.5)}


def flat_folders(tree=FOLDERS) -> list[tuple[str, str, str | None, str, int]]:
    """(id, name, parent, display path, order) in the tree's order."""
    out: list[tuple[str, str, str | None, str, int]] = []
    for id_, name, children in tree:
        out.append((id_, name, None, name, len(out)))
        for child, child_name in children:
            out.append((child, child_name, id_, f"{name} / {child_name}", len(out)))
    return out
