"""Queries of this subpackage, and SQL for those that SQL can express."""

from .avi_media import op3_avi_media
from .chat_format import op1_chat_format
from .decontaminate import op4_decontamination
from .html_text import op5_html_text
from .language_id import op9_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .near_dedup import op10_near_dedup
from .packing import op6_best_fit_packing
from .partition_index import op11_nearest_neighbours
from .quality import op8_quality
from .spelling import OP12_SQL, op12_spelling_groups
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .token_align import op13_token_alignment

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_avi_media": op3_avi_media,
    "op4_decontamination": op4_decontamination,
    "op5_html_text": op5_html_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_token_alignment": op13_token_alignment,
}
SQL = {"op2_substring_dedup": OP2_SQL, "op7_line_dedup": OP7_SQL, "op12_spelling_groups": OP12_SQL}
