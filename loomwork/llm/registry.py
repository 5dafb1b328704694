"""The queries of this package and their SQL."""

from __future__ import annotations

from loomwork.llm.chat import OP3_SQL, op3_chat
from loomwork.llm.decontam import op6_decontam
from loomwork.llm.fingerprints import op7_fingerprints
from loomwork.llm.language import op2_language
from loomwork.llm.line_runs import OP8_SQL, op8_line_runs
from loomwork.llm.near_dups import op10_near_dups
from loomwork.llm.packing import op9_packing
from loomwork.llm.pages import op5_pages
from loomwork.llm.passages import OP1_SQL, op1_passages
from loomwork.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_passages": op1_passages,
    "op2_language": op2_language,
    "op3_chat": op3_chat,
    "op4_toxicity": op4_toxicity,
    "op5_pages": op5_pages,
    "op6_decontam": op6_decontam,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_runs": op8_line_runs,
    "op9_packing": op9_packing,
    "op10_near_dups": op10_near_dups,
}
SQL = {
    "op1_passages": OP1_SQL,
    "op3_chat": OP3_SQL,
    "op8_line_runs": OP8_SQL,
}
