"""Schemas of document-analysis tables and their closed label domains.

Lists of the object form become rows with an explicit ordinal: pages hold
regions by ``layout_index``, regions hold lines by ``line_index``. Schemas are DDL strings, so that importing
them needs no session.
"""

from __future__ import annotations

PAGES = "page_id bigint, path string, width int, height int, doc_ori_label string, doc_ori_score float"
REGIONS = (
    "page_id bigint, layout_index int, cls_id int, label string, score float, x1 float, y1 float, x2 float, y2 float, region_type string, "
    "formula struct<text:string,tokens:array<bigint>,score:float>, `table` struct<text:string,tokens:array<bigint>>"
)
LINES = (
    "page_id bigint, layout_index int, line_index int, poly array<array<int>>, det_score float, line_ori_label string, line_ori_score float, text string, scores array<double>"
)
CLASSIFICATION = "score float, label string"
DETECTION = "cls_id int, label string, score float, coordinate array<float>"
TEXT_DETECTION = "polys array<array<array<int>>>, scores array<float>"
RECOGNITION = "text string, scores array<double>"
TEXT_RESULT = "text string, tokens array<bigint>, score float"
TABLE_RESULT = "text string, tokens array<bigint>"
#: As Spark's image source gives it: rows of blue, green, red bytes.
IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"

# Label domains of published heads, and how labels are routed.
#: The 25-class layout head, by class id.
LAYOUT_LABELS = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title", "footer", "footer_image",
    "footnote", "formula_number", "header", "header_image", "image", "inline_formula", "number", "paragraph_title", "reference", "reference_content",
    "seal", "table", "text", "vertical_text", "vision_footnote",
)
#: The 17-class capitalised head.
DOCLING_LABELS = (
    "Caption", "Footnote", "Formula", "List-item", "Page-footer", "Page-header", "Picture", "Section-header", "Table", "Text",
    "Title", "Document Index", "Code", "Checkbox-Selected", "Checkbox-Unselected", "Form", "Key-Value Region",
)
#: Labels by route. A label of none of these is read as text; "formula" of the
#: small heads is such a one, on purpose.
FORMULA_LABELS = ("display_formula", "inline_formula", "Formula")
INLINE_LABELS = ("inline_formula",)
TABLE_LABELS = ("table", "Table")
IMAGE_LABELS = ("image", "chart", "seal", "header_image", "footer_image", "Picture")
DOC_ORIENTATIONS = ("0", "90", "180", "270")
LINE_ORIENTATIONS = ("0_degree", "180_degree")
