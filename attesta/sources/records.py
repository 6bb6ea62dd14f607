"""Records from literature services, parsed: citations, abstracts, full texts, registry outcomes, links."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.quantities import to_number

# Blocks of a text record that are not its abstract.
TRAILER = (
    "(?i)^(©|copyright(?![A-Za-z0-9_])|doi:|pmid:|pmcid:|conflict of interest|declaration of|comment (in|on)(?![A-Za-z0-9_])|erratum (in|for)(?![A-Za-z0-9_])|update (in|of)(?![A-Za-z0-9_])"
    "|republished (in|from)(?![A-Za-z0-9_])|expression of concern(?![A-Za-z0-9_])|publisher:)"
)
AUTHOR_INFO = "(?i)^(author information:|collaborators:|corresponding author:|contributed equally)"
NAME_LIKE = "^[A-ZÀ-Þ][\\p{L}'’-]+(?:[ -][\\p{L}'’-]+)*\\s+[A-Z]{1,4}(?:\\([0-9]+\\))*\\.?$"
LEAST_KEPT, LEAST_RAW = 120, 400

REGISTRY = "array<struct<title:string,analyses:array<struct<paramValue:string,ciLowerLimit:string,ciUpperLimit:string>>>>"
SUMMARY = "struct<title:string,error:string,pubdate:string,source:string,fulljournalname:string,elocationid:string,pubtype:array<string>,authors:array<struct<name:string>>>"


def is_author_list(block: Column) -> Column:
    """At least two names between commas, and three in five of the parts like names."""
    parts = F.filter(F.transform(F.split(block, ",\\s*"), X.trim), lambda s: s != "")
    return X.let(parts, lambda p: (F.size(p) >= 2) & (F.size(F.filter(p, lambda s: s.rlike(NAME_LIKE))) >= F.ceil(F.size(p) * 0.6)))


def clean_abstract(raw: Column) -> Column:
    """A text record without its citation, authors, affiliations and trailers. If hardly anything would
    be left of a long record, the record as it is."""
    text = F.coalesce(raw, F.lit(""))
    blocks = F.filter(F.transform(F.split(text, "\n\\s*\n"), X.trim), lambda b: b != "")

    def flags(b: Column) -> Column:
        def of(block: Column) -> Column:
            flat = X.collapse(block)
            citation = flat.rlike("^[0-9]+\\.\\s") & (flat.rlike("(?i)doi:") | flat.rlike("(?<![A-Za-z0-9_])(19|20)[0-9]{2}(?![A-Za-z0-9_])"))
            info = flat.rlike(AUTHOR_INFO)
            names = is_author_list(flat)
            return F.struct(block.alias("block"), (citation | flat.rlike(TRAILER) | info | names).alias("drop"), info.alias("info"))

        return F.transform(b, of)

    # an author list above author information is dropped by being one
    kept = X.let(X.let(blocks, flags), lambda f: F.array_join(F.transform(F.filter(f, lambda x: ~x["drop"]), lambda x: x["block"]), "\n\n"))
    too_little = lambda k: (k == "") | ((F.length(X.trim(k)) < LEAST_KEPT) & (F.length(X.trim(text)) >= LEAST_RAW))
    return F.when(X.trim(text) == "", text).otherwise(X.let(kept, lambda k: F.when(too_little(k), text).otherwise(k)))


def citations(summaries: DataFrame) -> DataFrame:
    """schemas.CITATION from service summaries (pmid, json); what can't be read is unverified."""
    rows = summaries.select("pmid", F.from_json("json", SUMMARY).alias("r"))
    r = lambda f: F.col(f"r.{f}")
    ok = F.col("r").isNotNull() & r("error").isNull() & (F.coalesce(r("title"), F.lit("")) != "")
    first = F.coalesce(F.get(r("authors"), F.lit(0))["name"], F.lit(""))
    author = F.when(F.size(F.coalesce(r("authors"), F.array())) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    types = F.coalesce(r("pubtype"), F.array().cast("array<string>"))
    given = lambda c: F.when(ok, c)
    from ..operators.retractions import retracted_type

    return rows.select(
        "pmid", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"), given(author).alias("author"),
        given(F.coalesce(F.get(F.split(r("pubdate"), " "), F.lit(0)), F.lit(""))).alias("year"), given(F.coalesce(X.nz(r("source")), X.nz(r("fulljournalname")), F.lit(""))).alias("journal"),
        given(r("title")).alias("title"), given(X.nz(F.regexp_extract(F.coalesce(r("elocationid"), F.lit("")), "10\\.\\S+", 0))).alias("doi"), given(types).alias("pubtypes"),
        given(retracted_type(types)).alias("retracted"), F.coalesce(ok, F.lit(False)).alias("verified"),
    )


def citations_in_order(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """The verified citations of the wanted ids (pos, pmid), in that order."""
    return wanted.join(known.where("verified"), "pmid").orderBy("pos")


def registry_rows(records: DataFrame) -> DataFrame:
    """id, ord, measure, value, ci_low, ci_high from registry outcomes (id, json): a row for each
    analysis with a number; anything else is skipped."""
    om = records.select("id", F.posexplode(F.from_json("json", REGISTRY)).alias("i", "m"))
    a = om.select("id", "i", F.coalesce("m.title", F.lit("")).alias("measure"), F.posexplode("m.analyses").alias("j", "a"))
    rows = a.select("id", "i", "j", "measure", to_number(F.col("a.paramValue")).alias("value"), to_number(F.col("a.ciLowerLimit")).alias("ci_low"), to_number(F.col("a.ciUpperLimit")).alias("ci_high"))
    return rows.where("value IS NOT NULL").select("id", F.struct("i", "j").alias("ord"), "measure", "value", "ci_low", "ci_high")


def with_static_outcomes(ids: DataFrame, live: DataFrame, static: DataFrame) -> DataFrame:
    """Live registry rows; for an id without any, the static ones (id, measure, value, ci_low, ci_high)."""
    without = ids.select("id").distinct().join(live.select("id"), "id", "left_anti")
    columns = ["id", "measure", "value", "ci_low", "ci_high"]
    return live.select(*columns).unionByName(static.join(without, "id", "left_semi").select(*columns))


def resolve_identifier(raw: Column) -> Column:
    """struct<kind, value>: pmid, pmcid or doi of an input, by the first of these that it has."""
    t = X.trim(F.coalesce(raw, F.lit("")))
    url = F.regexp_extract(t, "(?i)pubmed\\.ncbi\\.nlm\\.nih\\.gov/([0-9]+)", 1)
    pmc = F.upper(F.regexp_extract(t, "(?i)PMC[0-9]+", 0))
    doi = F.regexp_replace(F.regexp_extract(t, "10\\.[0-9]{4,9}/\\S+", 0), "[).,;]+$", "")
    hit = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(t.rlike("^[0-9]+$"), hit("pmid", t)).when(url != "", hit("pmid", url)).when(pmc != "", hit("pmcid", pmc)).when(doi != "", hit("doi", doi))


def resolve_pmids(inputs: DataFrame, id_map: DataFrame) -> DataFrame:
    """inputs (raw) with ``pmid``, looked up in id_map (pmid, pmcid, doi) where it isn't given."""
    rows = inputs.withColumn("_r", resolve_identifier(F.col("raw")))
    by = None
    for kind in ("pmcid", "doi"):
        part = id_map.where(F.col(kind).isNotNull()).select(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")).alias("_r"), F.col("pmid").alias("_p"))
        by = part if by is None else by.unionByName(part)
    by = by.groupBy("_r").agg(F.min("_p").alias("_p"))
    return rows.join(by, "_r", "left").withColumn("pmid", F.when(F.col("_r.kind") == "pmid", F.col("_r.value")).otherwise(F.col("_p"))).drop("_r", "_p")


def oa_link(json: Column) -> Column:
    """struct<url, isPdf>: the open-access PDF, else the page; null if there is neither."""
    r = F.from_json(json, "struct<is_oa:boolean,best_oa_location:struct<url:string,url_for_pdf:string>>")
    closed = F.coalesce(~r["is_oa"], F.lit(False))
    pdf, page = X.nz(r["best_oa_location"]["url_for_pdf"]), X.nz(r["best_oa_location"]["url"])
    return F.when(closed, None).when(pdf.isNotNull(), F.struct(pdf.alias("url"), F.lit(True).alias("isPdf"))).when(page.isNotNull(), F.struct(page.alias("url"), F.lit(False).alias("isPdf")))


def backfill_oa(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Papers with open-access links (doi, link) filled in where they have neither yet."""
    has = F.concat(F.coalesce("pdfUrl", F.lit("")), F.coalesce("oaUrl", F.lit("")))
    joined = papers.withColumn("_doi", F.when(has == "", F.col("citation.doi"))).join(links.select(F.col("doi").alias("_doi"), "link"), "_doi", "left")
    url = F.col("link.url")
    return joined.withColumn("pdfUrl", F.when(F.col("link.isPdf"), url).otherwise(F.col("pdfUrl"))).withColumn("oaUrl", F.when(~F.col("link.isPdf"), url).otherwise(F.col("oaUrl"))).select(*papers.columns)


def pmc_url(pmcid: Column) -> Column:
    return F.when(F.coalesce(pmcid, F.lit("")) != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), F.regexp_replace(pmcid, "(?i)^PMC", ""), F.lit("/")))


def preprint_abstract(json: Column) -> Column:
    """struct<title, abstract, doi> of a registration agency's record, its abstract without tags."""
    r = F.from_json(json, "struct<title:array<string>,abstract:string,DOI:string>")
    return F.struct(F.coalesce(F.get(r["title"], F.lit(0)), F.lit("")).alias("title"), X.collapse(F.regexp_replace(F.coalesce(r["abstract"], F.lit("")), "<[^>]+>", " ")).alias("abstract"), r["DOI"].alias("doi"))


def node_text(markup: Column) -> Column:
    """The text of a piece of markup, on one line."""
    return X.collapse(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", " "))


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _all(node, *names: str) -> list:
    return [n for n in node.iter() if _local(n) in names]


def flatten_table(table) -> str:
    """A table's cells with separators and its rows on lines of their own, below its label."""
    rows = _all(table, "tr")
    if not rows:
        return _text(table)
    lines = [" | ".join(t for t in map(_text, _all(row, "th", "td")) if t) for row in rows]
    label = _text(next(iter(_all(table, "label", "caption")), None))
    return "\n".join([*([label] if label else []), *(line for line in lines if line)])


def parse_full_text(xml: str | None) -> tuple[bool, str, str, str]:
    """has_body, prose (without tables), tables, tier."""
    nothing = (False, "", "", "abstract_only")
    try:
        body = next(iter(_all(ET.fromstring(xml or ""), "body")), None)
    except ET.ParseError:
        return nothing
    if body is None:
        return nothing
    tables = "\n\n".join(map(flatten_table, _all(body, "table-wrap")))

    def prose(node) -> Iterator[str]:
        yield node.text or ""
        for child in node:
            if _local(child) != "table-wrap":
                yield from prose(child)
            yield child.tail or ""

    return True, " ".join("".join(prose(body)).split()), tables, "full_text"


def parse_abstract(xml: str | None) -> tuple[str, str] | None:
    """pmid and abstract of an article's record; labelled sections on lines of their own."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None
    pmid = _text(next(iter(_all(root, "PMID")), None))
    if not pmid:
        return None
    lines = []
    for abstract in _all(root, "Abstract"):
        for section in _all(abstract, "AbstractText"):
            text, label = _text(section), section.get("Label") or ""
            if text:
                lines.append(f"{label}: {text}" if label else text)
    return pmid, "\n".join(lines)


def full_texts(records: DataFrame) -> DataFrame:
    """records (…, xml) with ``full``: struct<hasBody, text, tables, tier>. Walking a tree is beyond SQL."""

    def parse(xmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(parse_full_text, xmls), columns=["hasBody", "text", "tables", "tier"])

    return records.withColumn("full", F.pandas_udf(parse, "hasBody boolean, text string, tables string, tier string")(F.col("xml")))


def abstracts(records: DataFrame) -> DataFrame:
    """pmid, abstract from article records (xml); what can't be read is dropped."""

    def parse(xmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_abstract(x) or (None, None) for x in xmls], columns=["pmid", "abstract"])

    return records.select(F.pandas_udf(parse, "pmid string, abstract string")(F.col("xml")).alias("a")).where("a.pmid IS NOT NULL").select("a.*")


def best_source(papers: DataFrame, full: DataFrame, cleaned: DataFrame) -> DataFrame:
    """papers (pmid, pmcid) with ``source``: the full text (pmcid, full) if it has a body, else the
    abstract (pmid, abstract); the pmcid is kept."""
    rows = papers.join(full.select("pmcid", "full"), "pmcid", "left").join(cleaned.select("pmid", "abstract"), "pmid", "left")
    body = F.coalesce("full.hasBody", F.lit(False))
    source = F.struct(
        F.when(body, F.col("full.text")).otherwise(F.coalesce("abstract", F.lit(""))).alias("text"), F.when(body, F.col("full.tables")).otherwise("").alias("tables"),
        F.when(body, "full_text").otherwise("abstract_only").alias("tier"), body.alias("hasBody"),
    )
    return rows.withColumn("source", source).select(*papers.columns, "source")


def search(index: DataFrame, terms: list[str], limit: int = 20, days: int | None = None, now: str | None = None) -> DataFrame:
    """Ids (id, entered) of an index (id, entered, text) with any of the terms, the newest first. The window
    is over the day a record *arrived*, so late ones aren't missed."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(F.lower("text"), F.lit(term.lower()))
    rows = index.where(found)
    if days is not None:
        rows = rows.where(F.col("entered") >= F.date_sub(F.to_date(F.lit(now)), days))
    return rows.orderBy(F.desc("entered"), "id").limit(limit).select("id", "entered")
