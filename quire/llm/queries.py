"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quire.llm.chunks import op5_chunks
from quire.llm.graph import op3_graph
from quire.llm.language import op9_language_id
from quire.llm.near_dup import op10_near_dup
from quire.llm.packing import op1_packing
from quire.llm.pii import op2_pii
from quire.llm.planes import op7_planes
from quire.llm.quality import op11_quality
from quire.llm.ranked import op13_ranked, op13_sql
from quire.llm.runs import op12_runs, op12_sql
from quire.llm.secrets import op6_secrets
from quire.llm.topk import op4_sql, op4_topk
from quire.llm.url_filter import op8_sql, op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_graph": op3_graph,
    "op4_topk": op4_topk,
    "op5_chunks": op5_chunks,
    "op6_secrets": op6_secrets,
    "op7_planes": op7_planes,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_near_dup": op10_near_dup,
    "op11_quality": op11_quality,
    "op12_runs": op12_runs,
    "op13_ranked": op13_ranked,
    "pipeline": corpus_pipeline.run,
}


def oracle_sql() -> dict[str, str]:
    found = {"op4_topk": op4_sql(), "op8_url_filter": op8_sql(), "op12_runs": op12_sql(), "op13_ranked": op13_sql()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
