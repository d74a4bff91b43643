"""Independent actions submitted together, so that small ones share the cluster instead of queueing."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

AT_ONCE = 8


def together(spark: SparkSession, *actions: Callable[[], Any]) -> list[Any]:
    if len(actions) < 2:
        return [a() for a in actions]
    with ThreadPoolExecutor(max_workers=min(AT_ONCE, len(actions))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(a)) for a in actions]]
