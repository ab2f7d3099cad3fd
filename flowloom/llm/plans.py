"""The queries of this package and their SQL, for the driver's contract."""

from flowloom.llm.common import ORACLES, QUERIES
from flowloom.llm import (  # noqa: F401  (they register)
    chat_format,
    decontaminate,
    fill_middle,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_rules,
    sharding,
    spelling,
    token_counts,
    toxicity,
    warc_zip,
)

__all__ = ["ORACLES", "QUERIES"]
