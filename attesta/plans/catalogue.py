"""All queries: imports every module that registers some."""

from . import q_checks, q_etl, q_fusion, q_joins, q_kernels, q_more, q_rows, q_stats  # noqa: F401
from .registry import FLAGSHIP, ORACLE_SQL, QUERIES  # noqa: F401
