"""Arrow kernels: numpy functions over batches of columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoframe.functions import stats


def score_column(name: str, *columns: Column) -> Column:
    """A function of stats over whole batches of integer columns, as a column of doubles."""
    f = getattr(stats, name)

    @F.pandas_udf("double")
    def kernel(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(f(*[c.to_numpy() for c in batch]))

    return kernel(*[c.cast("long") for c in columns])
