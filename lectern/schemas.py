"""Schemas of the logical tables, one place each."""

from __future__ import annotations

CUES = "course string, video string, i int, start_ms bigint, end_ms bigint, text string"
SEGMENTS = "start double, end double, text string"
COMPARE = "course string, video string, screenshot_id int, pash int, ssim double"
PAGE_ENDS = "course string, video string, page int, page_end int"
AOI_FILE = "AOI array<struct<boxes:array<double>,score:double,class:int>>, shape array<int>"
DESCRIPTION = "course string, video string, page int, aoi_idx int, original string, chinese_llama_8b string, chinese string, text_1 string"
NEIGHBOUR = "struct<text_id:int,time:string>"
CONTEXT = f"struct<screenshot_id:int,current:int,previous:array<{NEIGHBOUR}>,next:array<{NEIGHBOUR}>,current_midpoint:string>"
BASE_DATASET = f"texts array<string>, context_list array<{CONTEXT}>"
DETECTIONS = "course string, video string, screenshot_id int, cls array<double>, xywh array<array<double>>, conf array<double>"
MCQ = "conversations array<struct<from:string,value:string>>, system string, course string, video string, aoi_count int"
PREDICTIONS = "sample_id bigint, course string, aoi_count int, answer string, output string"
MISSING_SRT = "course string, video_id string, video_name string"
VLM_INDEX = "map<string,struct<course:string,video:string,page:string>>"

# Class names of page regions, by number.
CLASSES = ("image", "math", "plot", "table", "text", "title")
