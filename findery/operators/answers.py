"""Confidence of retrieval, context for answers, citations, and the quality of answers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_MIN, BM25_MIN, RERANKER_MIN = 0.5, 0.01, 0.0
PROFILE_PRIORITY = {"reranked_vector_cosine": 0, "hybrid_keyword_vector": 1, "bm25_keyword": 2}
MIN_TRUNCATED = 240
CUT_MARK = "\n... [truncated]"


def _reason(score: Column, least: float, what: str) -> Column:
    return F.when(score.isNull(), F.lit(f"missing_{what}_score")).when(score < least, F.lit(f"weak_{what}_score"))


def profile_confidence(profiles: DataFrame, results: DataFrame) -> DataFrame:
    """(log_id, profile_name, position, confidence_status, answerable, result_count, top_chunk_id, reason_codes) of each searched profile.

    ``profiles``: log_id, profile_name, position, failed.  ``results``: log_id, profile_name, rank,
    chunk_id, strategy, score, source_score, reranker_score, vector_score, keyword_score, source_count.
    The first result alone decides.  Reranked results pass by either signal, fused ones by two sources
    or one strong score; an absent profile failed or found nothing.
    """
    top = results.groupBy("log_id", "profile_name").agg(F.count("*").alias("result_count"), F.min_by(F.struct(*[c for c in results.columns if c not in ("log_id", "profile_name")]), F.struct("rank", "chunk_id")).alias("t"))
    rows = profiles.join(top, ["log_id", "profile_name"], "left")
    t = lambda c: F.col(f"t.{c}")
    source = _reason(t("source_score"), VECTOR_MIN, "source_vector")
    reranker = _reason(F.coalesce(t("reranker_score"), t("score")), RERANKER_MIN, "reranker")
    two, strong = F.coalesce(t("source_count"), F.lit(0)) >= 2, lambda c, least: F.coalesce(t(c) >= least, F.lit(False))
    hybrid_ok = two | strong("vector_score", VECTOR_MIN) | strong("keyword_score", BM25_MIN)
    hybrid = [F.when(~two, F.lit("single_hybrid_source")), F.when(~strong("vector_score", VECTOR_MIN), F.lit("weak_vector_score")), F.when(~strong("keyword_score", BM25_MIN), F.lit("weak_keyword_score"))]
    strategy = t("strategy")
    ok = (
        F.when(strategy == "reranked", source.isNull() | reranker.isNull())
        .when(strategy == "hybrid", hybrid_ok)
        .when(strategy == "bm25", _reason(t("score"), BM25_MIN, "bm25").isNull())
        .otherwise(_reason(t("score"), VECTOR_MIN, "vector").isNull())
    )
    why = (
        F.when(strategy == "reranked", F.array(source, reranker))
        .when(strategy == "hybrid", F.array(*hybrid))
        .when(strategy == "bm25", F.array(_reason(t("score"), BM25_MIN, "bm25")))
        .otherwise(F.array(_reason(t("score"), VECTOR_MIN, "vector")))
    )
    none, failed = F.col("result_count").isNull(), F.col("failed")
    answerable = ~failed & ~none & F.coalesce(ok, F.lit(False))
    return rows.select(
        "log_id", "profile_name", "position",
        F.when(failed, "failed").when(none, "no_context").when(answerable, "answerable").otherwise("low_confidence").alias("confidence_status"),
        answerable.alias("answerable"),
        F.when(failed | none, F.lit(0)).otherwise(F.col("result_count")).alias("result_count"),
        F.when(~failed, t("chunk_id")).alias("top_chunk_id"),
        F.when(failed, F.array(F.lit("profile_failed"))).when(none, F.array(F.lit("no_results"))).when(answerable, F.array().cast("array<string>")).otherwise(F.array_compact(why)).alias("reason_codes"),
    )


def overall_confidence(assessed: DataFrame) -> DataFrame:
    """One row a log: answerable if any profile is, else low if anything was found, else no context; and all reasons once, in order of profiles."""
    number = lambda s: F.count_if(F.col("confidence_status") == s)
    reasons = F.array_sort(F.collect_list(F.struct("position", "profile_name", "reason_codes")))
    return assessed.groupBy("log_id").agg(
        F.when(F.max("answerable"), "answerable").when(F.sum("result_count") > 0, "low_confidence").otherwise("no_context").alias("confidence_status"),
        F.count("*").alias("profile_count"),
        F.sum("result_count").alias("result_count"),
        number("answerable").alias("answerable_profiles"),
        number("low_confidence").alias("low_profiles"),
        number("no_context").alias("no_context_profiles"),
        number("failed").alias("failed_profiles"),
        F.array_distinct(F.flatten(F.transform(reasons, lambda r: r["reason_codes"]))).alias("reason_codes"),
    )


def logged_profiles(logs: DataFrame) -> DataFrame:
    """(log_id, profile_name, position, failed) from logs with a JSON list of profiles and a JSON object of failures."""
    names = F.from_json("profiles", "array<string>")
    failures = F.map_keys(F.from_json(F.get_json_object("runtime_metadata", "$.profile_failures"), "map<string,string>"))
    rows = logs.select("log_id", F.posexplode(names).alias("position", "profile_name"), F.coalesce(failures, F.array().cast("array<string>")).alias("failures"))
    return rows.select("log_id", "profile_name", "position", F.array_contains("failures", F.col("profile_name")).alias("failed"))


CONTEXT_SCHEMA = "log_id long, chunk_id long, result_id long, included boolean, exclusion_reason string, citation_key string, supporting_count long, context_text string, context_chars long, original_chars long, truncated boolean, package_key string"


def context_packages(results: DataFrame, max_chars: int = 12_000, max_items: int = 20) -> DataFrame:
    """Candidates of each log's context: what is included under the character budget, cut, or left out, and why.

    ``results``: log_id, result_id, profile_name, rank, chunk_id, title, source_label, heading, text,
    confidence_status.  Better kinds of profiles come first; a chunk found again supports the first
    place.  The budget is spent in order, each choice resting on the ones before, so this runs in Python
    by log; logs are small (their results are bounded by the searches' depth).
    """
    if not 500 <= max_chars <= 50_000 or not 1 <= max_items <= 100:
        raise ValueError("max_chars is 500 to 50000, max_items 1 to 100")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(p=[PROFILE_PRIORITY.get(n, 10) for n in pdf.profile_name]).sort_values(["p", "profile_name", "rank", "result_id"])
        out, place, used = [], {}, 0
        for r in pdf.itertuples():
            if r.chunk_id in place:
                place[r.chunk_id]["supporting_count"] += 1
                continue
            row = {"log_id": r.log_id, "chunk_id": r.chunk_id, "result_id": r.result_id, "included": False, "exclusion_reason": None, "citation_key": None, "supporting_count": 0, "context_text": "", "context_chars": 0, "original_chars": 0, "truncated": False}
            out.append(row)
            if len(place) >= max_items:
                row["exclusion_reason"] = "max_items_exceeded"
                continue
            place[r.chunk_id] = row
            if r.confidence_status != "answerable":
                row["exclusion_reason"] = r.confidence_status
                continue
            if r.text is None:
                row["exclusion_reason"] = "source_context_missing"
                continue
            key = row["citation_key"] = f"RCP-{len(place):03d}"
            head = [f"[{key}] {r.title}", f"Source: {r.source_label}", f"Chunk: {r.chunk_id}", f"Profile: {r.profile_name} / Rank: {r.rank}"]
            head += [f"Heading: {r.heading}"] if r.heading else []
            text = "\n".join([*head, "", "current:", r.text.strip()]).strip()
            gap = 2 if any(x["included"] for x in out) else 0
            room = max_chars - used - gap
            row["original_chars"] = len(text)
            if room <= 0 or (len(out) > 1 and room < MIN_TRUNCATED):
                row["exclusion_reason"] = "context_budget_exceeded"
                continue
            if len(text) > room:
                row["truncated"] = True
                text = text[: room - len(CUT_MARK)].rstrip() + CUT_MARK if room >= len(CUT_MARK) else ""
            row |= {"included": True, "context_text": text, "context_chars": len(text)}
            used += gap + len(text)
        material = "|".join([str(pdf.log_id.iloc[0]), str(max_chars), str(max_items), ",".join(str(x["result_id"]) for x in out)])
        key = hashlib.sha256(material.encode()).hexdigest()[:16]
        return pd.DataFrame([x | {"package_key": key} for x in out])

    return results.groupBy("log_id").applyInPandas(pack, CONTEXT_SCHEMA)


def citation_issues(c: dict[str, Column]) -> Column:
    """array<struct<code, severity>> of a context candidate, in a fixed order."""
    included = c["included"]
    place = c["has_anchor"] | c["has_location"] | c["has_lineage"]
    rules = [
        ("candidate_excluded", "warning", ~included),
        ("missing_citation_key", "failed", included & (F.coalesce(c["citation_key"], F.lit("")) == "")),
        ("missing_document_identity", "failed", ~c["has_document"]),
        ("missing_chunk_identity", "failed", ~c["has_chunk"]),
        ("missing_generation_text", "failed", included & (F.trim(F.coalesce(c["context_text"], F.lit(""))) == "")),
        ("weak_source_anchor", "warning", included & ~place),
        ("missing_artifact_block_reference", "warning", included & ~c["has_lineage"]),
        ("context_truncated", "warning", c["truncated"]),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, rule in rules]))


def citation_status(issues: Column) -> Column:
    worst = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    return F.when(worst("failed"), "failed").when(worst("warning"), "warning").otherwise("ready")


def citation_readiness(assessed: DataFrame, key: str = "log_id") -> DataFrame:
    """Counts and shares (two digits, half up) of each package from rows with included, citation_status, anchored, issue_count."""
    share = lambda a, b: F.when(b > 0, F.round(a.cast("decimal(20,0)") * 100 / b.cast("decimal(20,0)"), 2).cast("double")).otherwise(F.lit(0.0))
    number = lambda s: F.count_if(F.col("citation_status") == s)
    included, total = F.count_if("included"), F.count("*")
    anchored = F.count_if(F.col("included") & F.col("anchored"))
    return assessed.groupBy(key).agg(
        F.when((number("failed") > 0) | (included == 0), "failed").when(number("warning") > 0, "warning").otherwise("ready").alias("package_status"),
        total.alias("candidate_count"), included.alias("included_count"), number("ready").alias("ready_count"), number("warning").alias("warning_count"), number("failed").alias("failed_count"),
        share(anchored, included).alias("anchor_percent"), share(number("ready"), total).alias("ready_percent"), F.sum("issue_count").alias("issue_count"),
    )


# What an answer says that gives none.
NO_ANSWER_MARKERS = ("답변할 수 없습니다", "확인할 수 없습니다", "알 수 없습니다", "insufficient context", "cannot answer", "not enough information")


def answer_quality(answers: DataFrame) -> DataFrame:
    """answers (answer_text, expected_keys, guardrail_status, provider_error) with citations found, reasons and quality_status."""
    flat = F.trim(F.regexp_replace(F.coalesce("answer_text", F.lit("")), r"(?U)\s+", " "))
    clean = lambda keys: F.array_distinct(F.filter(F.transform(keys, F.trim), lambda k: k != ""))
    rows = answers.withColumns(
        {
            "expected": clean(F.coalesce("expected_keys", F.array().cast("array<string>"))),
            "cited": F.array_distinct(F.regexp_extract_all(flat, F.lit(r"\[(RCP-\d{3})\]"), 1)),
            "answer_present": flat != "",
            "no_answer": F.exists(F.array(*map(F.lit, NO_ANSWER_MARKERS)), lambda m: F.contains(F.lower(flat), m)),
        }
    )
    rows = rows.withColumns(
        {
            "recognized": F.filter("cited", lambda k: F.array_contains("expected", k)),
            "missing": F.filter("expected", lambda k: ~F.array_contains("cited", k)),
            "unrecognized": F.filter("cited", lambda k: ~F.array_contains("expected", k)),
        }
    )
    guarded, some = F.col("guardrail_status") == "no_answer", lambda c: F.size(c) > 0
    needs = ~guarded & some("expected")
    rules = [
        ("empty_answer", ~F.col("answer_present")),
        ("guardrail_no_answer_not_reflected", guarded & F.col("answer_present") & ~F.col("no_answer")),
        ("unexpected_citation_in_no_answer", guarded & some("cited")),
        ("unexpected_no_answer", ~guarded & F.col("no_answer") & some("expected")),
        ("missing_required_citation", needs & ~some("recognized")),
        ("partial_citation_coverage", needs & some("recognized") & some("missing")),
        ("unrecognized_citation_key", ~guarded & some("unrecognized")),
        ("unexpected_citation_without_context", ~guarded & some("cited") & ~some("expected")),
    ]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    fatal = F.array(*map(F.lit, ("empty_answer", "unexpected_no_answer", "guardrail_no_answer_not_reflected", "missing_required_citation")))
    rows = rows.withColumn("reason_codes", F.when(F.col("provider_error"), F.array(F.lit("provider_error"))).otherwise(reasons))
    status = F.when(F.col("provider_error"), "not_evaluated").when(F.arrays_overlap("reason_codes", fatal), "failed").when(some("reason_codes"), "warning").otherwise("passed")
    coverage = F.when(some("expected"), F.bround(F.size("recognized") / F.size("expected") * 100, 2))
    return rows.withColumns({"quality_status": status, "coverage_percent": coverage})


# Words that route a message, tried in this order.
GENERATION_WORDS = ("보고서", "제안서", "요약서", "작성", "생성", "draft", "proposal", "report")
SUMMARY_WORDS = ("요약", "summarize", "summary")
SEARCH_WORDS = ("검색", "찾아", "찾기", "관련 문서", "search", "retrieve")
GROUNDED_WORDS = ("근거", "규정", "정책", "사규", "문서 기준", "based on", "citation")


def intent(text: Column) -> tuple[Column, Column]:
    """(intent, confidence) of a message: the first rule that matches."""
    low = F.lower(text)
    any_of = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))
    rules = [
        (any_of(GENERATION_WORDS), "document_generation", 0.88),
        (any_of(SUMMARY_WORDS) & any_of(SEARCH_WORDS), "document_search_summary", 0.84),
        (any_of(SUMMARY_WORDS), "document_summary", 0.80),
        (any_of(GROUNDED_WORDS) | any_of(SEARCH_WORDS), "grounded_answer", 0.76),
    ]
    name, sure = F.lit("general_answer"), F.lit(0.55)
    for rule, what, confidence in reversed(rules):
        name, sure = F.when(rule, what).otherwise(name), F.when(rule, confidence).otherwise(sure)
    return name, sure


def template_completeness(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """(answer_id, heading, section_status) of each required section of each answer.

    ``answers``: answer_id, template_key, text.  ``sections``: template_key, heading, requires_citation.
    Headings are compared without numbering and case; of equal ones the first counts.  An empty or
    absent section failed, one without a citation that needs one is a warning.
    """
    normal = lambda h: F.trim(F.regexp_replace(F.lower(h), r"^[#\s]*(?:\d+(?:\.\d+)*[.)]?\s+)?", ""))
    lines = answers.select("answer_id", "template_key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    is_heading = F.col("line").rlike(r"^#{1,6}\s+\S")
    w = Window.partitionBy("answer_id").orderBy("line_no")
    marked = lines.withColumns({"section": F.sum(is_heading.cast("int")).over(w), "is_heading": is_heading})
    found = marked.where("section > 0").groupBy("answer_id", "section").agg(
        F.max(F.when(F.col("is_heading"), normal(F.col("line")))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    first = found.groupBy("answer_id", "name").agg(F.min_by("body", "section").alias("body"))
    wanted = answers.select("answer_id", "template_key").join(sections, "template_key").withColumn("name", normal(F.col("heading")))
    body = F.trim(F.coalesce("body", F.lit("")))
    status = F.when(body == "", "failed").when(F.col("requires_citation") & ~body.rlike(r"\[RCP-\d{3}\]"), "warning").otherwise("passed")
    return wanted.join(first, ["answer_id", "name"], "left").select("answer_id", "heading", status.alias("section_status"))
