"""Schemas of parsed records and canonical profiles."""

from __future__ import annotations

PROVENANCE = "struct<field:string,source:string,method:string,confidence:double>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:string>"
SKILL = "struct<name:string,confidence:double,sources:array<string>>"

#: One row a CSV line or resume.  ``seq`` is the global input order.
PARSED = {
    "source_type": "string", "source_file": "string", "seq": "bigint", "full_name": "string",
    "emails": "array<string>", "phones": "array<string>", "city": "string", "region": "string", "country": "string",
    "linkedin": "string", "github": "string", "portfolio": "string", "other_links": "array<string>",
    "headline": "string", "current_company": "string", "years_experience": "double", "skills": "array<string>",
    "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "summary": "string",
    "provenance": f"array<{PROVENANCE}>",
}

PROFILE = {
    "candidate_id": "string", "full_name": "string", "emails": "array<string>", "phones": "array<string>",
    "location": "struct<city:string,region:string,country:string>",
    "links": "struct<linkedin:string,github:string,portfolio:string,other:array<string>>",
    "headline": "string", "years_experience": "double", "skills": f"array<{SKILL}>",
    "experience": f"array<{EXPERIENCE}>", "education": f"array<{EDUCATION}>", "provenance": f"array<{PROVENANCE}>",
    "overall_confidence": "double",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
