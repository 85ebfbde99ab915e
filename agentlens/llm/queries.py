"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from agentlens.llm.decontaminate import op10
from agentlens.llm.exact_dedup import OP4_SQL, op4
from agentlens.llm.filter_audit import OP13_SQL, op13
from agentlens.llm.html_text import op11
from agentlens.llm.license_scan import OP2_SQL, op2
from agentlens.llm.mixing import op8
from agentlens.llm.near_dedup import op6
from agentlens.llm.phrases import OP12_SQL, op12
from agentlens.llm.quality import op3
from agentlens.llm.substring_dedup import op7
from agentlens.llm.token_files import op9
from agentlens.llm.toxicity import op5
from agentlens.llm.warc import OP1_SQL, op1

QUERIES = {
    "op1_warc": op1,
    "op2_license_scan": op2,
    "op3_quality": op3,
    "op4_exact_dedup": op4,
    "op5_toxicity": op5,
    "op6_near_dedup": op6,
    "op7_substring_dedup": op7,
    "op8_mixing": op8,
    "op9_token_files": op9,
    "op10_decontaminate": op10,
    "op11_html_text": op11,
    "op12_phrases": op12,
    "op13_filter_audit": op13,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op12_phrases": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
