"""Explicit schemas of the engine's tables; readers never infer."""

from pyspark.sql import types as T


def struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


PAGES = "kb_id string, doc_id string, page int, pos int, text string"
BLOCKS = "kb_id string, doc_id string, page int, block_order int, block_label string, block_content string, bbox_norm array<double>, polygon_norm array<array<double>>"
CHUNKS = "node_id string, kb_id string, doc_id string, source string, text string, clause_number string, section_path string, page_number int, block_range struct<start:int,end:int>"
STANDARD = "numbers array<string>, names array<string>"
#: One line of OCR output.
OCR_LINE = (
    "result struct<layoutParsingResults:array<struct<markdown:struct<text:string>,width:int,height:int,"
    "prunedResult:struct<image_size:array<int>,width:int,height:int,parsing_res_list:array<struct<"
    "block_label:string,block_content:string,block_bbox:array<double>,block_polygon:array<array<double>>,block_order:int>>>>>>"
)
#: A stored parse result.
PARSE_RESULT = "by_page array<struct<page:int,text:string>>, full_text string, layout array<struct<page:int,width:int,height:int,blocks:array<struct<block_label:string,block_content:string,block_order:int,bbox_norm:array<double>>>>>"
