"""Lists that a cluster's API gives in pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: A list of more pages than this is taken for one that doesn't end.
MAX_PAGES = 512


class ListError(RuntimeError):
    pass


def pages(fetch: Callable[[str | None], str], most: int = MAX_PAGES) -> Iterator[str]:
    """The pages of a list: fetch(token) gives one as JSON text, whose metadata.continue is the token of the next.

    A list that goes on after `most` pages is an error, so that a refresh keeps what was known instead of a part.
    """
    token = None
    for _ in range(most):
        page = fetch(token)
        yield page
        token = (json.loads(page).get("metadata") or {}).get("continue")
        if not token:
            return
    raise ListError(f"the list goes on after {most} pages")


def listed(spark: SparkSession, fetch: Callable[[str | None], str], most: int = MAX_PAGES) -> DataFrame | None:
    """value: the pages of a list, in the form that enrich reads; None if the list could not be read to its end."""
    try:
        return spark.createDataFrame([(page,) for page in pages(fetch, most)], "value string")
    except (ListError, OSError, ValueError):
        return None
