"""Calls to a language model: an injected function, a contract for its answers, and a stand-in without
a model. What comes back is untrusted: every answer goes through the operator that guards it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

Model = Callable[[list[str]], list[str]]

#: What each call must answer, as the DDL of its JSON, and how many prompts go into one call.
QUANTITY = "struct<name:string,value:double,unit:string,ci_low:double,ci_high:double,p_value:double,source_quote:string,location_hint:string>"
CONTRACTS: dict[str, tuple[str, int]] = {
    "extract": (f"struct<study_id:string,design:string,quantities:array<{QUANTITY}>>", 1),
    "score": ("struct<id:string,score:string>", 30),
    "triage": ("struct<id:string,score:string,tier:int,finding:string,finding_plain:string,relevance:string>", 8),
    "check": ("struct<id:string,supported:boolean,reason:string>", 8),
    "analyze": ("struct<concept:string,hub:string,domain:string,tags:array<string>>", 1),
    "merge_domains": ("struct<merges:array<struct<from:string,into:string>>>", 1),
    "summarize": ("struct<summary:string>", 1),
    "categorize": ("struct<categories:array<struct<label:string,memberIds:array<string>>>>", 1),
    "connect": ("struct<links:array<struct<target_id:string,rationale:string>>>", 1),
    "weekend": ("struct<opener:string,threads:array<struct<anchor:string,pmids:array<string>,narrative:string>>,gaps:array<string>>", 1),
    "question": ("struct<ack:string,question:string,done:boolean>", 1),
    "draft": ("struct<name:string,northStars:array<string>,projects:array<string>,topics:array<struct<label:string,query:string>>,rubric:string>", 1),
    "intake": ("struct<name:string,northStars:array<string>,projects:array<string>,topics:array<struct<label:string,query:string>>>", 1),
}
ATTEMPTS = 2
DESIGNS = ("rct", "cohort", "case-control", "cross-sectional", "meta-analysis", "case-series", "other")
TAG_CAP = 6


def ask(df: DataFrame, prompt: Column, call: str, model: Model, key: str = "id") -> DataFrame:
    """key, answer: the model's answers under the call's contract, null where one keeps to no contract.

    Prompts go out in batches; a batch whose answers aren't JSON, or too few, is asked again once."""
    contract, size = CONTRACTS[call]

    def answers(prompts: list[str]) -> list[str | None]:
        for _ in range(ATTEMPTS):
            got = model(prompts)
            try:
                [json.loads(g) for g in got]
            except (ValueError, TypeError):
                continue
            if len(got) == len(prompts):
                return got
        return [None] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                yield pd.DataFrame({"k": part["k"], "raw": answers(part["prompt"].tolist())})

    raw = df.select(F.col(key).cast("string").alias("k"), prompt.alias("prompt")).mapInPandas(run, "k string, raw string")
    return raw.select(F.col("k").alias(key), F.from_json("raw", contract).alias("answer"))


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?](?=\d)[^.!?\n]*)*[.!?]?")
_NUMBER = r"[-−]?(?:\d{1,3}(?:,\d{3})+(?:[.·]\d+)?|\d+[.·]\d+|[.·]\d+|\d+)"
_CI = re.compile(rf"CI[ ,:=]*({_NUMBER}) ?(?:to|–|-|,) ?({_NUMBER})", re.I)
_P = re.compile(rf"\bp(?: ?value)? ?[=<>≤≥]+ ?({_NUMBER})", re.I)


def _value(raw: str) -> float:
    return float(raw.replace(",", "").replace("·", ".").replace("−", "-"))


def extract_offline(prompts: list[str]) -> list[str]:
    """A quantity from each sentence with a number: its first number, an interval after CI, a P value."""
    out = []
    for text in prompts:
        found = []
        for sentence in filter(None, (s.strip() for s in _SENTENCE.findall(text))):
            rest, ci, p = sentence, _CI.search(sentence), _P.search(sentence)
            for m in sorted(filter(None, (ci, p)), key=lambda m: -m.start()):
                rest = rest[: m.start()] + rest[m.end() :]
            first = re.search(rf"(?<![\w.·]){_NUMBER}(?![\w])", rest)
            if not first:
                continue
            unit = re.match(r" ?(%|percent|mm|months|years|days)", rest[first.end() :])
            found.append({
                "name": " ".join(rest[: first.start()].split()[-4:]) or "Value", "value": _value(first[0]), "unit": unit[1] if unit else None, "ci_low": _value(ci[1]) if ci else None,
                "ci_high": _value(ci[2]) if ci else None, "p_value": _value(p[1]) if p else None, "source_quote": sentence, "location_hint": "text",
            })
        design = "rct" if re.search(r"\brandomi[sz]ed\b", text, re.I) else "cohort" if "cohort" in text.lower() else "other"
        out.append(json.dumps({"study_id": "", "design": design, "quantities": found}))
    return out


def triage_offline(criteria: str) -> Model:
    """A take on each paper from its words: its first sentence, and how many of the criteria it meets."""
    wanted = set(re.findall(r"[a-z]{3,}", criteria.lower()))

    def take(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            id, _, text = prompt.partition("\n")
            words = set(re.findall(r"[a-z]{3,}", text.lower()))
            first = next(filter(None, (s.strip() for s in _SENTENCE.findall(text))), "")
            met = sorted(wanted & words)
            out.append(json.dumps({"id": id, "score": str(round(100 * len(met) / max(1, len(wanted)))), "tier": 1 if met else 3, "finding": first, "finding_plain": re.sub(r"\S*\d\S*", "", first).strip(), "relevance": f"Mentions {', '.join(met[:3])}." if met else ""}))
        return out

    return take


def check_offline(prompts: list[str]) -> list[str]:
    """Is the finding (second line) in the evidence (the rest)?"""
    out = []
    for prompt in prompts:
        id, finding, *evidence = prompt.split("\n", 2)
        ok = not finding or " ".join(finding.lower().split()) in " ".join("".join(evidence).lower().split())
        out.append(json.dumps({"id": id, "supported": ok, "reason": "" if ok else "not in the evidence"}))
    return out


def analyze_offline(prompts: list[str]) -> list[str]:
    """A paper filed by the commonest long words of its text."""
    out = []
    for prompt in prompts:
        words = sorted(re.findall(r"[a-z]{5,}", prompt.lower()))
        common = sorted(set(words), key=lambda w: (-words.count(w), w))
        out.append(json.dumps({"concept": " ".join(common[:2]) or "Uncategorized", "hub": common[0] if common else "Other", "domain": "", "tags": common[:8]}))
    return out


def extracted(answers: DataFrame) -> DataFrame:
    """id, ord, quantity: quantities that name a value and a quote, of a known design or ``other``."""
    rows = answers.select("id", F.posexplode("answer.quantities").alias("ord", "quantity"))
    return rows.where(F.col("quantity").isNotNull() & (F.coalesce("quantity.source_quote", F.lit("")) != ""))


def filed(answers: DataFrame, projects: Column) -> DataFrame:
    """id, concept, hub, domain, tags of analyzed papers; projects' names make no shelves, tags capped."""
    from .categories import sanitize_filing

    concept, hub = sanitize_filing(F.coalesce(X.nz(X.trim(F.col("answer.concept"))), F.lit("Uncategorized")), F.coalesce(X.nz(X.trim(F.col("answer.hub"))), F.lit("Other")), projects)
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("answer.tags", F.array().cast("array<string>")), X.key_of), lambda t: t != "")), 1, TAG_CAP)
    return answers.select("id", concept.alias("concept"), hub.alias("hub"), X.trim(F.coalesce("answer.domain", F.lit(""))).alias("domain"), tags.alias("tags"))


def profile_draft(answers: DataFrame, key: str = "id", select_count: int = 5, score_floor: int = 70, rubric: str = "Prefer strong designs and direct relevance.") -> DataFrame:
    """A drafted profile with what is missing filled in; count and floor are never the model's."""
    strings = lambda f: F.filter(F.transform(F.coalesce(f"answer.{f}", F.array().cast("array<string>")), X.trim), lambda s: s != "")
    name, text = X.nz(X.trim(F.col("answer.name"))), X.nz(X.trim(F.col("answer.rubric")))
    settings = F.struct(F.coalesce(text, F.lit(rubric)).alias("criteria"), F.lit(select_count).alias("selectCount"), F.lit(score_floor).alias("scoreFloor"))
    return answers.select(key, F.coalesce(name, F.lit("Doctor")).alias("name"), strings("northStars").alias("northStars"), strings("projects").alias("projects"), F.col("answer.topics").alias("topics"), settings.alias("rubric"))
