"""Answering a table of questions: the retrieval part, up to one context text per turn."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F, types as T

from oppsearch import fixed_values as V, schemas as S
from oppsearch.functions import routing as R
from oppsearch.functions.profile import extract_profiles, question_filters
from oppsearch.operators import context as C, question_cards as Q
from oppsearch.operators.blocks import BROADCAST_BYTES
from oppsearch.operators.evaluate import DB_ROUTES, VECTOR_ROUTES, grounding, stage_timings
from oppsearch.operators.index import Embed
from oppsearch.operators.lexical import search_pages
from oppsearch.operators.structured import structured_hits
from oppsearch.operators.text_index import TextIndex
from oppsearch.operators.turns import BLOCK_BITS, gate, lengths, resolve_turns
from oppsearch.operators.vectors import vector_search
from oppsearch.session import written

STRUCTURED_COLUMNS = [
    "id", "program_name", "university_name", "field_category", "deadline_ir", "deadline_non_ir",
    "funding_type", "university_id", "tuition_fee_eu_per_year", "tuition_fee_non_eu_per_year",
    "scholarship_available", "funding_category", "urls"]
PROGRAM_COLUMNS = ["university_name", "url", "description"]
POSITION_COLUMNS = ["professor_name", "university", "position_type", "title", "country", "city",
                    "deadline", "email", "url", "funding", "description"]


def accept_questions(requests: DataFrame) -> DataFrame:
    """Requests with a question; trimmed, with the default thread where none is named."""
    return requests.filter(R.valid_question(F.col("question"))).select(
        *[c for c in requests.columns if c not in ("question", "thread")],
        R.thread_or_default(F.col("thread")).alias("thread"),
        R.ws_trim(F.col("question")).alias("question"))


Router = Callable[[DataFrame, str], DataFrame]


def prepare_turns(turns: DataFrame, dictionary: DataFrame, name: str,
                  route: Router = R.with_text_route) -> DataFrame:
    """Add each turn's own profile finds and route."""
    routed = route(turns, "question")
    return extract_profiles(routed, "question", dictionary, name)


def question_state(turns: DataFrame, dictionary: DataFrame, name: str,
                   route: Router = R.with_text_route) -> DataFrame:
    """State after each turn. Threads longer than one block are scanned twice, so what is extracted
    from the texts is written first."""
    prepared = prepare_turns(turns, dictionary, name, route)
    shape = lengths(turns, ["thread"], "turn")
    if shape.rows > 1 << BLOCK_BITS:
        prepared = written(prepared, "prepared-turns")
    return resolve_turns(prepared, shape=shape)


def vector_hits(asked: DataFrame, stored: DataFrame, columns: list[str],
                embed: Embed) -> DataFrame:
    """Top hits for each enriched question, texts defaulting to empty. The question vectors are
    written first: the search reads them twice and a model should be asked once."""
    queries = written(
        embed(asked.select("question_id", "enriched_query"), "enriched_query").select(
            "question_id", F.col("embedding").alias("query_vector")), "question-vectors")
    hits = vector_search(stored, queries, query_id="question_id", payload=columns)
    return hits.select("question_id", "rank", "score",
                       *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


@dataclass(frozen=True)
class Sources:
    """What questions are answered from, and how their texts are embedded. Pages are a crawled
    table or an index of one (``index_pages``)."""

    programs: DataFrame
    finances: DataFrame
    program_vectors: DataFrame
    position_vectors: DataFrame
    pages: DataFrame | TextIndex
    embed: Embed
    as_of: dt.date


def asked_filters(asked: DataFrame, programs: DataFrame) -> DataFrame:
    """The structured-search filters of questions with ``question_id, query, field``. Only a stored
    category restricts: a profile field of another name is no filter."""
    c = F.col
    stored = programs.select(c("field_category").alias("category")).distinct()
    # filters are read before the join, so it moves no texts
    named = question_filters(c("query"))
    found = asked.select("question_id", "field", *[v.alias(n) for n, v in named.items()])
    return found.join(stored, found["field"] == stored["category"], "left").select(
        "question_id", "category", *named)


@dataclass(frozen=True)
class Found:
    """The hits of every source for the questions that ask it, and what went wrong: the error of
    each source that could not be searched."""

    db: DataFrame
    program: DataFrame
    position: DataFrame
    web: DataFrame
    failed: dict[str, str]


def _hit_schemas(state: DataFrame, sources: Sources) -> dict[str, T.StructType]:
    """Columns of each source's hits."""
    asked = state.schema["question_id"].dataType
    stored = {f.name: f.dataType for t in (sources.programs, sources.finances) for f in t.schema}

    def hits(columns: list[str], types: dict[str, T.DataType]) -> T.StructType:
        out = T.StructType().add("question_id", asked).add("rank", T.IntegerType())
        for n in columns:
            out.add(n, types.get(n, T.StringType()))
        return out

    score = {"score": T.DoubleType()}
    return {"db": hits(STRUCTURED_COLUMNS, stored),
            "program": hits(["score", *PROGRAM_COLUMNS], score),
            "position": hits(["score", *POSITION_COLUMNS], score),
            "web": hits(["title", "url", "content"], {})}


def search_sources(state: DataFrame, sources: Sources, errors_as_data: bool = False) -> Found:
    """Search every source. ``state`` has ``question_id, query, enriched_query, choice, field,
    web_search`` and is read by every branch, so it should be a stored table; each branch filters by
    the retrieval choice before it embeds or joins anything.

    ``errors_as_data``: each source's hits are written at once; one whose search fails has no hits
    and is named in ``failed``, and the others are searched all the same. Otherwise an error ends
    the whole table of questions.
    """
    c = F.col

    def web() -> DataFrame:
        asked = state.filter(c("web_search") & (c("choice") != "end")).select(
            "question_id", "enriched_query")
        ids = {"query_id": "question_id", "query_text": "enriched_query"}
        if isinstance(sources.pages, TextIndex):
            return sources.pages.search(asked, V.WEB_TOP_K, payload=["title", "url", "content"],
                                        **ids)
        return search_pages(asked, sources.pages, V.WEB_TOP_K, **ids)

    searches = {
        "db": lambda: structured_hits(
            asked_filters(state.filter(R.uses_structured(c("choice"))), sources.programs),
            sources.programs, sources.finances, sources.as_of),
        "program": lambda: vector_hits(state.filter(R.uses_program_vectors(c("choice"))),
                                       sources.program_vectors, PROGRAM_COLUMNS, sources.embed),
        "position": lambda: vector_hits(state.filter(c("choice") == "professor_search"),
                                        sources.position_vectors, POSITION_COLUMNS, sources.embed),
        "web": web}
    if not errors_as_data:
        return Found(**{name: search() for name, search in searches.items()}, failed={})
    hits, failed = {}, {}
    for name, schema in _hit_schemas(state, sources).items():
        try:
            hits[name] = written(searches[name]().select(*schema.names), f"{name}-hits")
        except (PySparkException, Py4JError) as error:
            hits[name] = state.sparkSession.createDataFrame([], schema)
            failed[name] = str(error)
    return Found(**hits, failed=failed)


def context_sections(found: Found) -> DataFrame:
    return C.all_sections(
        C.json_section(found.db, "db", "question_id", "rank", STRUCTURED_COLUMNS),
        C.json_section(found.program, "program", "question_id", "rank", [*PROGRAM_COLUMNS, "score"]),
        C.json_section(found.position, "position", "question_id", "rank",
                       [*POSITION_COLUMNS, "score"]),
        C.web_section(found.web, "question_id", "rank"))


def retrieve(state: DataFrame, sources: Sources) -> DataFrame:
    """Context rows of all questions."""
    return context_sections(search_sources(state, sources))


COUNTS = [f"n_{s}" for s in C.SECTIONS]


def with_contexts(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Questions with context, hits per source and whether there is any data."""
    joined = state.join(C.assemble_contexts(rows), "question_id", "left")
    counts = {n: F.coalesce(n, F.lit(0)) for n in COUNTS}
    return joined.withColumns(counts | {"has_data": sum(counts.values()) > 0})


def answer_questions(turns: DataFrame, dictionary: DataFrame, name: str, sources: Sources,
                     route: Router = R.with_text_route) -> DataFrame:
    """One row per turn: choice, question to ask back, and the retrieved context with its counts."""
    state = question_state(accept_questions(turns), dictionary, name, route)
    # a number of its own for every request: thread and turn may be repeated
    state = written(state.withColumn(
        "question_id", F.monotonically_increasing_id().cast("string")), "state")
    c = F.col
    return with_contexts(state, retrieve(state, sources)).select(
        "thread", "turn", "choice", "ask", "enriched_query", "context", *COUNTS, "has_data",
        R.profile_summary(c("degree_level"), c("field"), c("specialization"),
                          c("current_education")).alias("profile"))


def evaluate_questions(labelled: DataFrame, sources: Sources,
                       profile: dict[str, str] = V.EVAL_PROFILE,
                       route: Router = R.with_text_route) -> DataFrame:
    """Labelled questions run through routing, gate and retrieval under one fixed profile:
    ``query, expected, predicted, route_correct, db_hits, vec_hits, prof_hits, has_data, context``.
    ``labelled`` has ``question_id, expected, query``. Scores and timings of answers, which are
    written elsewhere, join on ``question_id``."""
    state = labelled_state(labelled, profile, route)
    return _evaluated(with_contexts(state, retrieve(state, sources))).drop("enriched_query")


def _evaluated(answered: DataFrame) -> DataFrame:
    return answered.select(
        "question_id", "query", "enriched_query", "expected", F.col("route").alias("predicted"),
        (F.col("route") == F.col("expected")).alias("route_correct"),
        F.col("n_db").alias("db_hits"), F.col("n_program").alias("vec_hits"),
        F.col("n_position").alias("prof_hits"), "has_data", "context")


def labelled_state(labelled: DataFrame, profile: dict[str, str], route: Router) -> DataFrame:
    """Labelled questions with route and choice, all under one profile, stored before the gate, which
    puts a second copy of each text beside it and costs little to read through."""
    none = F.lit(None).cast("string")
    held = {f: F.lit(profile[f]) if f in profile else none for f in S.PROFILE_FIELDS}
    routed = route(labelled, "query").select(
        "*", *[v.alias(f) for f, v in held.items()], F.lit(False).alias("web_search"),
        R.profile_complete(held["degree_level"], held["field"]).alias("profile_complete"))
    return gate(written(routed, "labelled-state"))


#: A bold label at the head of a list line claims nothing.
LIST_LABEL = r"(?m)^- \*\*[^*\n]+\*\*:"
#: Quotes and escapes of a context's JSON rows, which would run on with the links beside them.
JSON_MARKS = r'\\[nrt"\\]|"'
Answerer = Callable[[DataFrame, Found], DataFrame]


def _narrowed(hits: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The hits a broadcast semi or anti join with ``keys`` leaves, so no texts are shuffled for it; all
    hits where the keys are too many. For those that a later step would drop as well."""
    keys = written(keys.distinct(), "hit-keys")
    row_bytes = sum(F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 32 for k in keys.columns)
    if (keys.agg(F.sum(row_bytes)).first()[0] or 0) > BROADCAST_BYTES:
        return hits
    return hits.join(F.broadcast(keys), keys.columns, how).select(hits.columns)


def cards_answer(questions: DataFrame, found: Found, as_of: dt.date) -> DataFrame:
    """Answers as result cards; a question without hits gets none. Texts that no card shows are left
    behind before the cards of a question meet: descriptions of questions with better hits, and of
    universities without a structured hit."""
    day, pair = F.lit(as_of), ["question_id", "university_name"]
    better = found.db.select("question_id").union(found.position.select("question_id"))
    shared = found.db.select(pair).join(found.program.select(pair), pair, "left_semi")
    cards = Q.question_cards(
        Q.position_rows(found.position, day),
        Q.program_rows(found.db, day, _narrowed(found.program, shared, "left_semi")),
        Q.description_rows(_narrowed(found.program, better, "left_anti")))
    return questions.join(cards.select("question_id", F.col("cards").alias("response")),
                          "question_id", "left")


def full_run(labelled: DataFrame, sources: Sources, profile: dict[str, str] = V.EVAL_PROFILE,
             route: Router = R.with_text_route, answer: Answerer | None = None,
             contexts: bool = True) -> DataFrame:
    """Labelled questions from routing to a judged answer: a log that ``evaluate.full_metrics``
    takes, one row for each question, with what was found, answered and confirmed.

    ``answer(questions, found)`` adds ``response``; result cards are shown where none is given. Whether
    the context confirms it is ``faithful``, NULL where nothing was found or answered. A source that
    fails leaves its questions without its hits, and ``db_error`` or ``vec_error`` true. Stages run
    for all questions together: a question's time is its stage's divided by their number; contexts
    are put together and judged with the answers and count there. Without ``contexts`` they are not stored.
    ``judge_score`` is of a hosted judge and joins on ``question_id``; here it is -1, not scored.
    """
    started = time.monotonic()
    state = labelled_state(labelled, profile, route)
    routed = time.monotonic()
    found = search_sources(state, sources, errors_as_data=True)
    retrieved = time.monotonic()
    # contexts are put together and judged on the way to the answers, and stored once, beside them
    questions = _evaluated(with_contexts(state, context_sections(found)))
    show = answer or (lambda asked, hits: cards_answer(asked, hits, sources.as_of))
    c, said = F.col, F.col("has_data") & F.col("response").isNotNull()
    judged = grounding(show(questions, found).withColumns({
        "_said": F.regexp_replace("response", LIST_LABEL, ""),
        "_source": F.when(said, F.regexp_replace("context", JSON_MARKS, " "))}),
        "_said", "_source").drop("_said", "_source", *[] if contexts else ["context"])
    judged = written(judged, "evaluated-answers")
    done = time.monotonic()
    n = max(judged.count(), 1)
    predicted = c("predicted")
    timed = judged.withColumns({
        "db_error": F.lit("db" in found.failed) & predicted.isin(*DB_ROUTES),
        "vec_error": F.lit("program" in found.failed) & predicted.isin(*VECTOR_ROUTES),
        "judge_score": F.lit(-1),
        "routing_ms": F.lit((routed - started) * 1000 / n),
        "retrieval_ms": F.lit((retrieved - routed) * 1000 / n),
        "llm_ms": F.lit((done - retrieved) * 1000 / n)})
    return stage_timings(timed, ["routing_ms", "retrieval_ms", "llm_ms"])
