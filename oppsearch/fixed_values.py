"""Names, texts, limits and patterns that results depend on.

They are the values of the search service whose results this package reproduces and must not be
tuned here; every operator that uses one takes it as a parameter default.
"""

# -- sizes ---------------------------------------------------------------------------------------
TOP_K = 5
WEB_TOP_K = 5
STRUCTURED_LIMIT = 20
EMBED_DIM = 1536
CHUNK_SIZE = 4000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ")
JUDGE_CONTEXT_CHARS = 2000
JUDGE_RESPONSE_CHARS = 800
HYBRID_MARGIN = 0.1

# -- sources -------------------------------------------------------------------------------------
EXCLUDED_SOURCES = ("scraped_universities",)
SHORT_LAYOUT_PREFIX = "scraped_"

# -- stored text lengths -------------------------------------------------------------------------
PROGRAM_TEXT_LENGTHS = {"university_name": 512, "url": 1024, "description": 8192}
POSITION_TEXT_LENGTHS = {
    "professor_name": 256,
    "university": 256,
    "position_type": 64,
    "title": 512,
    "country": 128,
    "city": 128,
    "deadline": 32,
    "email": 256,
    "url": 1024,
    "funding": 512,
    "description": 8192,
}

# -- routes --------------------------------------------------------------------------------------
ANCHOR_ROUTES = ("db", "semantic", "chat", "professor")
ROUTES = ("query_db", "vector_search", "hybrid", "professor_search", "respond")
ANCHOR_TEXTS = {
    "db": (
        "list programs, opportunities, show all scholarships, filter programs, find opportunities, "
        "programs with deadline, upcoming deadlines, passed deadlines, deadline before date, "
        "tuition fee, cost per year, how much does it cost, affordable programs, free tuition, "
        "programs in the field of, which universities offer, show me programs where, "
        "scholarship available, budget under, programs sorted by, programs by country"
    ),
    "semantic": (
        "what is this program about, program description, curriculum overview, coursework details, "
        "programs focused on, programs related to topic, programs about a subject area, "
        "digital transformation, sustainability, interdisciplinary, research area, specialization in, "
        "admission requirements, eligibility criteria, who can apply, language requirements, "
        "required documents, application process, prerequisites"
    ),
    "chat": (
        "general advice, greetings, visa process, how do I write, essay writing tips, "
        "explain the difference between, what does fully funded mean, definition of scholarship, "
        "what is the difference, compare two concepts, general knowledge about scholarships, "
        "understanding terms, what does X mean, how things work"
    ),
    "professor": (
        "professor research, PhD position, doctoral position, postdoc, "
        "research assistant, research internship, academic job, open position in lab, "
        "supervised research, professor looking for student, research group opening, "
        "research fellowship, join a lab, university research vacancy"
    ),
}

# -- funding -------------------------------------------------------------------------------------
FUNDING_VALUES = ("fully_funded", "tuition_free", "self_funded")

# -- context sections, in order ------------------------------------------------------------------
SECTION_HEADERS = {
    "db": "=== STRUCTURED DATA (deadlines, fees, funding) ===",
    "program": "=== PROGRAM DESCRIPTIONS (admission, eligibility, curriculum) ===",
    "position": "=== PROFESSOR RESEARCH OPPORTUNITIES ===",
    "web": "=== WEB SEARCH RESULTS ===",
}

# -- texts ---------------------------------------------------------------------------------------
ASK_DEGREE = "your degree level (BS, MS, or PhD)"
ASK_FIELD = "your field of study (e.g. Computer Science, Engineering, Business)"
ASK_BEFORE = "I'd love to find the most relevant programs for you! Could you quickly share "
ALL_PASSED_TEXT = (
    "All deadlines for this query have passed — here are the options for future reference."
)
EVAL_PROFILE = {"degree_level": "MS", "field": "Computer Science"}
SAMPLE_QUESTIONS = (
    "Show me fully funded master's programs",
    "CS programs with upcoming deadlines",
    "Programs in Germany under €5,000/year tuition",
    "PhD positions in machine learning at European universities",
    "How do I write a strong scholarship essay?",
    "Find fully funded CS programs with deadlines after March",
)
