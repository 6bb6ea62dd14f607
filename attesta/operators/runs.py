"""Whole runs, composed of the operators: the daily digest, topping it up, the weekly read, refiling.

Each step's result is written to the shared folder before the next one reads it: models are asked once,
and a step's plan starts from a table. The ledger is to be stamped last, so that a run that breaks off
is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..storage import materialize
from . import categories, funnel, guard, ledger, library, models, topics, verify


@dataclass
class Inputs:
    """results (topics.RESULT), topics (topic_idx, label, asked, error), seen (ledger), saved (papers:
    pmid, id), citations (schemas.CITATION), sources (id, text, tables, tier, registry)."""

    results: DataFrame
    topics: DataFrame
    seen: DataFrame
    saved: DataFrame
    citations: DataFrame
    sources: DataFrame


@dataclass
class Settings:
    criteria: str
    now: str
    cap: int = topics.DEFAULT_CAP
    floor: int = funnel.DEFAULT_FLOOR
    count: int | None = 5
    extract: models.Model = models.extract_offline
    scorer: Callable | None = None
    triage: models.Model | None = None
    check: models.Model = models.check_offline


@dataclass
class Digest:
    """candidates; scored and picked of them; claims (verified quantities of the picked); rankings (guarded
    and checked); shown (after the second floor); stamps (ids to put into the ledger)."""

    candidates: DataFrame
    scored: DataFrame
    picked: DataFrame
    claims: DataFrame
    rankings: DataFrame
    shown: DataFrame
    stamps: DataFrame


def find_candidates(inputs: Inputs, settings: Settings) -> DataFrame:
    """id, idx, topics, title, journal, year, pubtypes of new papers that aren't retracted."""
    skip = ledger.skip_set(inputs.seen, inputs.saved)
    found = topics.candidates(inputs.results, inputs.topics, skip, inputs.citations, settings.cap)
    return found.select("id", F.col("place").alias("idx"), "topics", "citation.title", "citation.journal", "citation.year", "citation.pubtypes")


def score(candidates: DataFrame, inputs: Inputs, settings: Settings) -> DataFrame:
    """Every candidate's score before reading. Old scores are dropped, so this also scores anew."""
    pool = candidates.drop("score", "reason").join(inputs.sources.select("id", F.col("text").alias("abstract")), "id", "left")
    scorer = settings.scorer or funnel.overlap_scorer(settings.criteria)
    scores = funnel.score_with(pool, scorer, funnel.candidate_block(F.col("abstract")))
    return funnel.attach_scores(candidates, scores)


def read(picked: DataFrame, inputs: Inputs, settings: Settings) -> DataFrame:
    """Verified claims (claim_id, id, ord, quantity, verdict) of the picked papers."""
    sources = inputs.sources.join(picked.select("id"), "id", "left_semi")
    answers = models.ask(sources, F.concat_ws("\n", "text", "tables"), "extract", settings.extract)
    rows = models.extracted(answers).join(sources, "id")
    claims = rows.select(F.xxhash64("id", "ord").alias("claim_id"), "quantity", "text", "tables", F.col("tier").alias("source_tier"), "registry", "id", "ord")
    return materialize(verify.verify(materialize(claims, "claims")).select("claim_id", "id", "ord", "quantity", "verdict"), "verdicts")


def rank(picked: DataFrame, claims: DataFrame, inputs: Inputs, settings: Settings) -> DataFrame:
    """Takes on the picked papers, guarded against unverified numbers and checked against the text."""
    shown = claims.where(~F.col("verdict.flagged")).groupBy("id").agg(F.collect_list(Q.format_quantity(F.col("quantity"))).alias("verified"))
    texts = inputs.sources.join(picked.select("id"), "id", "left_semi")
    take = settings.triage or models.triage_offline(settings.criteria)
    answers = models.ask(texts, F.concat_ws("\n", "id", "text"), "triage", take).where("answer IS NOT NULL")
    rankings = answers.select("id", "answer.score", "answer.tier", "answer.finding", "answer.finding_plain", "answer.relevance").join(shown, "id", "left")
    guarded = materialize(guard.sanitize_rankings(materialize(rankings, "takes")), "guarded")
    asked = guarded.join(texts.select("id", "text"), "id")
    verdicts = models.ask(asked, F.concat_ws("\n", "id", F.regexp_replace("finding", "\n", " "), "text"), "check", settings.check)
    # asked as ids, answered as ids: an invented one finds no ranking
    checks = verdicts.where("answer IS NOT NULL").select(F.col("answer.id").alias("id"), F.lit(0).alias("seq"), "answer.supported", "answer.reason")
    return materialize(guard.attach_checks(guarded, checks), "rankings")


def run_digest(inputs: Inputs, settings: Settings, cached: DataFrame | None = None) -> Digest:
    """Search results to a digest. cached: rankings (of an earlier run) of papers not to be read again."""
    candidates = materialize(find_candidates(inputs, settings), "candidates")
    scored = materialize(score(candidates, inputs, settings), "scored")
    picked = materialize(funnel.apply_floor(scored, max(0, settings.floor - funnel.PRE_READ_MARGIN), settings.count), "picked")
    todo = picked if cached is None else picked.join(cached.select("id"), "id", "left_anti")
    claims = read(todo, inputs, settings)
    rankings = rank(todo, claims, inputs, settings)
    if cached is not None:
        rankings = rankings.unionByName(cached.join(picked.select("id"), "id", "left_semi"), allowMissingColumns=True)
    outcomes = picked.join(inputs.sources.select("id", F.lit(True).alias("has")), "id", "left").select("id", "idx", F.when(F.col("has").isNull(), "no source").alias("error"), F.lit(False).alias("retracted"))
    shown = funnel.post_read_floor(outcomes, rankings, settings.floor)
    stamps = ledger.stampable(candidates, outcomes)
    return Digest(candidates, scored, picked, claims, rankings, shown, stamps)


def commit(digest: Digest, inputs: Inputs, settings: Settings) -> DataFrame:
    """The ledger after the run. To be written last."""
    return ledger.cap_ledger(ledger.merge_seen(inputs.seen, digest.stamps, settings.now))


def top_up(digested: DataFrame, selected: DataFrame, inputs: Inputs, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Claims and rankings of the selected papers (id, …) that the digest (id) doesn't have yet."""
    more = selected.join(digested.select("id"), "id", "left_anti")
    claims = read(more, inputs, settings)
    return claims, rank(more, claims, inputs, settings)


def weekend_read(papers: DataFrame, now, prompt_model: models.Model) -> DataFrame:
    """The weekly read's threads over the last days' papers; what it cites must be in the library."""
    split = library.focus_and_shelf(papers, now)
    one = split.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.concat(F.lit("["), "pmid", F.lit("]")), "title"))), "\n").alias("p")).select(F.lit("w").alias("id"), "p")
    answer = models.ask(one, F.col("p"), "weekend", prompt_model)
    threads = answer.select(F.posexplode("answer.threads").alias("pos", "t")).select("pos", "t.anchor", "t.pmids", "t.narrative")
    return library.weekend_threads(threads, split.where("focus"), split.where("NOT focus"))


def refile(papers: DataFrame, concepts: DataFrame, edges: DataFrame, projects, model: models.Model = models.analyze_offline) -> DataFrame:
    """Every paper (id, pmid, title, finding) filed anew: pmid, concept_id, hub_id, domain, tags. Satellites
    are dropped first, so only hubs are left to file under."""
    answers = models.ask(papers, F.concat_ws("\n", "title", "finding"), "analyze", model)
    filed = models.filed(answers, projects).join(papers.select("id", "pmid"), "id")
    hubs = concepts.where("isHub")
    return categories.file_papers(filed.drop("id"), hubs, edges.limit(0))
