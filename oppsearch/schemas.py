"""Declared schemas of inputs and stored tables."""

PROGRAMS_RAW = (
    "id STRING, program_name STRING, university_name STRING, field_category STRING, "
    "deadline_ir STRING, deadline_non_ir STRING, funding_type STRING"
)
PROGRAMS = (
    "id INT, program_name STRING, university_name STRING, field_category STRING, "
    "deadline_ir DATE, deadline_non_ir DATE, funding_type STRING"
)
FINANCES_RAW = (
    "university_id STRING, tuition_fee_eu_per_year STRING, tuition_fee_non_eu_per_year STRING, "
    "scholarship_available STRING, funding_category STRING, urls STRING"
)
FINANCES = (
    "university_id INT, tuition_fee_eu_per_year INT, tuition_fee_non_eu_per_year INT, "
    "scholarship_available BOOLEAN, funding_category ARRAY<STRING>, urls ARRAY<STRING>"
)
PROGRAM_DOCS = (
    "_source STRING, official_url STRING, program_name STRING, university_name STRING, "
    "description STRING, degree_type STRING, city STRING, subject STRING, duration STRING, "
    "languages ARRAY<STRING>, "
    "sections STRUCT<admission: STRUCT<content: STRING>, fees: STRUCT<content: STRING>>"
)
POSITION_DOCS = (
    "professor_name STRING, university STRING, position_type STRING, title STRING, "
    "country STRING, city STRING, department STRING, description STRING, requirements STRING, "
    "funding STRING, deadline STRING, email STRING, url STRING, research_areas ARRAY<STRING>"
)
PROGRAM_VECTORS = (
    "id BIGINT, record_key STRING, chunk_idx INT, n_chunks INT, university_name STRING, url STRING, "
    "description STRING, embedding ARRAY<FLOAT>"
)
POSITION_VECTORS = (
    "id BIGINT, record_key STRING, chunk_idx INT, n_chunks INT, professor_name STRING, university STRING, "
    "position_type STRING, title STRING, country STRING, city STRING, deadline STRING, "
    "email STRING, url STRING, funding STRING, description STRING, embedding ARRAY<FLOAT>"
)
ANCHORS = "route STRING, embedding ARRAY<FLOAT>"
PROFILE_FIELDS = ("degree_level", "field", "specialization", "current_education")
