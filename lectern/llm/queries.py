"""The ten operators as queries of the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from lectern.llm.ann import op1_ann
from lectern.llm.impact import OP4_SQL, op4_topk
from lectern.llm.langid import op7_language
from lectern.llm.mixing import OP3_SQL, op3_mix
from lectern.llm.packing import op2_pack
from lectern.llm.pii import op8_pii
from lectern.llm.sharding import op10_reshard
from lectern.llm.simhash import op5_simhash
from lectern.llm.tokencount import op9_counts
from lectern.llm.urlfilter import OP6_SQL, op6_urls

QUERIES = {
    "op1_ann": op1_ann,
    "op2_pack": op2_pack,
    "op3_mix": op3_mix,
    "op4_topk": op4_topk,
    "op5_simhash": op5_simhash,
    "op6_urls": op6_urls,
    "op7_language": op7_language,
    "op8_pii": op8_pii,
    "op9_counts": op9_counts,
    "op10_reshard": op10_reshard,
}

SQL = {"op3_mix": OP3_SQL, "op4_topk": OP4_SQL, "op6_urls": OP6_SQL}
