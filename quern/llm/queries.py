"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm.embeddings import OP4_SQL, op4_embedding_lsh
from quern.llm.html import op2_html_text
from quern.llm.media import op3_media_chunks
from quern.llm.minhash import OP5_SQL, op5_minhash
from quern.llm.mixing import OP1_SQL, op1_mix
from quern.llm.packing import op9_packing
from quern.llm.pii import op8_pii_pseudonyms
from quern.llm.quality import op6_quality
from quern.llm.substrings import OP7_SQL, op7_substring_dedup
from quern.llm.urls import OP10_SQL, op10_url_filter


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix, op2_html_text, op3_media_chunks, op4_embedding_lsh, op5_minhash, op6_quality, op7_substring_dedup, op8_pii_pseudonyms, op9_packing, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op4_embedding_lsh": OP4_SQL, "op5_minhash": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op10_url_filter": OP10_SQL}
