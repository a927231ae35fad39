"""The driver queries of the core: QUERIES name -> (spark, folder) -> DataFrame; SQL name -> the same for DuckDB."""

from framesift.plans import evaluation, language, media, retrieval  # noqa: F401
from framesift.plans.base import QUERIES, SQL  # noqa: F401
