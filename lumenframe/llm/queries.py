"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lumenframe.llm.decontamination import OP4_SQL, op4_decontamination
from lumenframe.llm.licenses import OP9_SQL, op9_licenses
from lumenframe.llm.lm import op3_lm
from lumenframe.llm.neardup import OP2_SQL, op2_neardup
from lumenframe.llm.packing import op1_packing
from lumenframe.llm.pii import op7_pii
from lumenframe.llm.quality import op6_quality
from lumenframe.llm.sharding import OP8_SQL, op8_sharding
from lumenframe.llm.topk import OP5_SQL, op5_topk
from lumenframe.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_neardup": op2_neardup,
    "op3_lm": op3_lm,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
}

ORACLE = {
    "op2_neardup": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_topk": OP5_SQL,
    "op8_sharding": OP8_SQL,
    "op9_licenses": OP9_SQL,
}
