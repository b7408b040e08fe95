"""Canonical row of a normalised record and the rows that are served."""

from __future__ import annotations

ENTITY = "struct<type:string,value:string,confidence:double>"
PROVENANCE = "struct<connector:string,connector_version:string,collection_method:string,source_url:string,license:string,ingest_ts:timestamp>"
EVIDENCE = "struct<source:string,s3_uri:string,ts:string,note:string>"

RECORD_DDL = (
    "source string, source_id string, ts timestamp, text string, language string, "
    f"entities array<{ENTITY}>, metadata map<string,string>, provenance {PROVENANCE}"
)
TREND_DDL = f"entity string, score double, mention_count bigint, evidence array<{EVIDENCE}>, last_seen string"
BRONZE_DDL = "source string, source_id string, timestamp bigint, text string"
FEATURE_DDL = "entity string, latest_score double, mention_count bigint, updated_at timestamp"

