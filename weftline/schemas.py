"""Fixed schemas; nothing is inferred."""

from __future__ import annotations

LINK = "struct<url:string,anchor_text:string>"
MESSAGE = "msg_pos long, folder string, internal_date date, raw binary"
MIME = "msg_pos long, newsletter string, date string, plain string, html string, has_text boolean, markdown string"
SECTION = f"msg_pos long, sec_pos int, item_pos int, text string, links array<{LINK}>, from_list boolean"
STORY = "msg_pos long, sec_pos int, item_pos int, title string, body string, links array<string>, newsletter string, date string, source_count int"
RUN = "id string, run_at timestamp_ntz, folder string, date_start date, date_end date, story_count int, status string, error_message string, output_json string"
DIGEST_STORY = "struct<title:string,body:string,link:string,links:array<string>,newsletter:string,date:string,source_count:int>"
DIGEST = f"struct<id:string,generated_at:string,folder:string,date_start:string,date_end:string,story_count:int,stories:array<{DIGEST_STORY}>>"
FLAG = "decision string, confidence string, llm_reasoning string, item struct<title:string,body:string,link:string,newsletter:string,date:string>"
