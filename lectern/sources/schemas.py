"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

SCHEMA_VERSION = 1
MARKER = "struct<offset:int,length:int,type:string,id:string,content:string,extras:map<string,string>>"
BUCKET = f"textid string, juan_seq int, bucket string, text string, hash string, markers array<{MARKER}>, parse_error string"
MANIFEST = (
    "textid string, hash string, title string, base_edition string, editions array<struct<short:string,label:string>>, parts array<struct<seq:int,filename:string,hash:string>>, "
    "marker_assets array<struct<seq:int,role:string,filename:string,hash:string>>, toc array<struct<marker_id:string,label:string,seq:int,bucket:string,start:int,end:int>>, "
    "identifiers map<string,array<string>>, keys array<string>, path string, parse_error string"
)
ANNOTATION = "id string, uri string, cid string, text_id string, edition string, anchor struct<marker_id:string,offset:string,length:string>, payload string, curation_state string, rating string, provenance struct<did:string,cid:string,created_at:string,supersedes:string>"
TRANSLATION = "translation_id string, juan_seq int, ord int, corresp array<string>, text string, parse_error string"
SCAN = "cluster_id string, length int, occurrence_count int, text string, locations array<struct<textid:string,juan_seq:int,bucket:string,bucket_id:bigint,start:int,end:int>>"
FRONTMATTER = "id string, title string, titlePinyin string, titleEnglish string, notBefore string, notAfter string, dzt_date string"
DUPLICATIONS = (
    "textid_a string, juan_seq_a int, bucket_a string, textid_b string, juan_seq_b int, bucket_b string, chars_a int, chars_b int, juan_length_a int, juan_length_b int, coverage_a double, coverage_b double, longest_span int, cluster_count int, "
    "intra_juan string, longest_a_start int, longest_a_end int, longest_b_start int, longest_b_end int, spans_a_json string, spans_b_json string, action string, action_actor string, action_at string"
)
EVENT = "kind string, did string, time_us bigint, commit struct<collection:string,rkey:string,operation:string,cid:string,record:string>"
