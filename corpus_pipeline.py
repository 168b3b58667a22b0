"""The corpus pipeline: rejected documents go, repeated lines go, near copies go, sources are mixed, the rest is packed.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last keep the columns of documents. The stages live with their operators.
"""

from shardwright.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
