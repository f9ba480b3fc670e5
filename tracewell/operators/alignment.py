"""Many sources side by side by one exchange."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aligned(sources: Mapping[str, DataFrame], keys: Sequence[str], base: str | None = None) -> DataFrame:
    """keys, then a struct for each source with its other columns, NULL where it has no row of these keys; only keys that `base` has, if one is named.

    The sources' rows are tagged and put under each other, then grouped once: one exchange with a combine before it, however many sources there are, in place of one join
    each. Of several rows of a source with the same keys the greatest (by its columns in their order) counts. Null keys are keys. A source has a column besides
    the keys, and no maps.
    """
    kinds = {name: T.StructType([f for f in df.schema.fields if f.name not in keys]) for name, df in sources.items()}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        own = F.struct(*[F.col(f"`{f.name}`") for f in kinds[name].fields])
        return df.select(*keys, *[(own if other == name else F.lit(None).cast(kinds[other])).alias(other) for other in sources])

    whole = reduce(DataFrame.unionByName, [tagged(*x) for x in sources.items()]).groupBy(*keys).agg(*[F.max(name).alias(name) for name in sources])
    return whole if base is None else whole.where(F.col(base).isNotNull())


def assembled(sources: Mapping[str, DataFrame | None], keys: Sequence[str], base: str) -> DataFrame:
    """One nested record for each key that `base` has: a struct for each lane. A lane that is None is NULL in every record, as one without a row is in its own."""
    found = aligned({name: df for name, df in sources.items() if df is not None}, keys, base)
    return found.select(*keys, *[F.col(name) if df is not None else F.lit(None).cast("struct<absent: boolean>").alias(name) for name, df in sources.items()])
