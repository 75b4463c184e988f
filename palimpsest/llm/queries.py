"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bagminhash import op8_bagminhash
from .chat import OP6_SQL, op6_snapshot_collapse
from .langid import op3_crf_language
from .media import op2_media_archive
from .mixing import OP4_SQL, op4_poisson_mixing
from .packing import op5_best_two_fit
from .quality import op1_pu_quality
from .secrets import op10_markov_secrets
from .spotsigs import op9_spotsigs
from .templates import op7_template_extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pu_quality, op2_media_archive, op3_crf_language, op4_poisson_mixing, op5_best_two_fit, op6_snapshot_collapse, op7_template_extraction, op8_bagminhash, op9_spotsigs, op10_markov_secrets)
}
ORACLES: dict[str, str] = {"op4_poisson_mixing": OP4_SQL, "op6_snapshot_collapse": OP6_SQL}
