"""Logical tables as DDL."""

QUANTITY = "name string, value double, unit string, ci_low double, ci_high double, p_value double, source_quote string, location_hint string"
REGISTRY_ROW = "measure string, value double, ci_low double, ci_high double"
CLAIM = f"claim_id long, quantity struct<{QUANTITY.replace(' string', ':string').replace(' double', ':double')}>, text string, tables string, source_tier string, registry array<struct<{REGISTRY_ROW.replace(' string', ':string').replace(' double', ':double')}>>"
TOPIC = "label string, query string"
TOPIC_RESULT = "topic_idx int, label string, pos long, id string, asked int, error string"
LEDGER = "id string, first_seen string"
CITATION = "pmid string, url string, author string, year string, journal string, title string, doi string, pubtypes array<string>, retracted boolean, verified boolean"
NODE = "id string, kind string, label string, text string, domain string, tags array<string>, summary string, sourcePmids array<string>, isHub boolean, desc string, source string, ptId string, addedAt string, updatedAt string"
EDGE = "id string, source string, target string, status string, origin string, rationale string, ts string, confirmedAt string"
PAPER = (
    "id string, pmid string, pmcid string, title string, citation struct<display:string,author:string,journal:string,year:string,title:string,pubtypes:array<string>,retracted:boolean>, tier string, "
    "finding string, relevance string, check struct<verdict:string,reason:string>, quantities array<struct<name:string,value:double,unit:string,ci_low:double,ci_high:double,p_value:double,source_quote:string,tier:string>>, "
    "pdfUrl string, oaUrl string, domain string, tags array<string>, conceptId string, notes string, savedAt string, retracted boolean, favorite boolean, memoIds array<string>, vaultWrittenAt string"
)
DOMAIN = "key string, label string, color string, source string, pos int"
KV = "user_id string, collection string, key string, value string, updated_at string"
EVENT = "user_id string, ts timestamp, type string, payload string"
MEMO = "id string, text string, createdAt string, updatedAt string, vaultWrittenAt string"
