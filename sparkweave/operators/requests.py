"""Checks of search requests: what a service turns away before it searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweave.functions import vectors as V

#: Limits of a request.
MOST_K, MOST_UPLOAD = 100, 10 * 1024 * 1024
ENGINES, ALGORITHMS = ("faiss", "milvus"), ("none", "mmr", "clusters", "features")


def errors(k: Column, metric: Column, weight: Column, upload: Column) -> Column:
    """Names of the fields that are out of range, as an array; a field that isn't given is not wrong."""
    wrong = {"top_k": ~k.between(1, MOST_K), "metric": ~metric.isin(*V.METRICS), "weight": ~weight.between(0.0, 1.0), "upload": upload > MOST_UPLOAD}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]))


#: Whether less is nearer, whether vectors are taken to unit length, by metric.
METRIC_INFO = {"cosine": (False, True), "inner_product": (False, False), "l2": (True, True), "l1": (True, False), "angular": (True, True)}


def task_id(*key: Column) -> Column:
    """An id in the form of a UUID, from a hash of what the task is, so that a task sent again has the same one."""
    m = F.md5(F.concat_ws("|", *key).cast("binary"))
    cut = lambda at, n: F.substring(m, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))
