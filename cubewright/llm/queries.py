"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from . import oracle
from .common import ship
from .decontaminate import op5_decontaminate
from .langid import op7_language_id
from .multiindex import op4_neighbours
from .packing import op9_packing
from .partenum import op6_jaccard_join
from .quality import op10_quality
from .sharding import op2_sharding
from .substring import op3_substring_dedup
from .urlfilter import op8_url_filter
from .warc import op1_warc


def _shipped(query: Callable) -> Callable:
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_warc": _shipped(op1_warc),
    "op2_sharding": _shipped(op2_sharding),
    "op3_substring_dedup": _shipped(op3_substring_dedup),
    "op4_neighbours": _shipped(op4_neighbours),
    "op5_decontaminate": _shipped(op5_decontaminate),
    "op6_jaccard_join": _shipped(op6_jaccard_join),
    "op7_language_id": _shipped(op7_language_id),
    "op8_url_filter": _shipped(op8_url_filter),
    "op9_packing": _shipped(op9_packing),
    "op10_quality": _shipped(op10_quality),
}
ORACLE_SQL = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
