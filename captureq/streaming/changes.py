"""Changes of a value in a stream of refreshes: the last value of each key is state, a failed refresh keeps it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key string, seq long, value string"


class _Last(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("seq", kind="stable", na_position="first")
        values = [None if pd.isna(v) else v for v in part["value"]]
        held = self.last.get()
        before = [object() if held is None else held[0], *values[:-1]]
        hit = [a != b for a, b in zip(values, before, strict=True)]
        if any(hit):
            self.last.update((values[-1],))
        told = [(key[0], None if pd.isna(n) else int(n), v) for n, v, h in zip(part["seq"], values, hit, strict=True) if h]
        yield pd.DataFrame(told, columns=["key", "seq", "value"], dtype=object).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def flips_stream(events: DataFrame, key: str, seq: str, value: str, failed: str | None = None) -> DataFrame:
    """(key, seq, value) of the rows of a stream whose value differs from the one before it under the key; the first of a
    key counts. Rows with a true `failed` are refreshes that told nothing: they change no state and are no row of the
    result. Null is a value as any other, null keys are one key. Keys and values come out as texts. Within a micro-batch
    rows are put in order; over batches they must come in order. The state is one value for each key, written only when
    it changes."""
    good = events if failed is None else events.filter(~F.coalesce(F.col(failed), F.lit(False)))
    rows = good.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(_Last(), SCHEMA, "Append", "None")


def membership_stream(refreshes: DataFrame, group: str, seq: str, members: str, failed: str | None = None) -> DataFrame:
    """The same for sets: members is an array of names; equal sets in any order are equal, a null one is no members."""
    names = F.array_join(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))), ",")
    return flips_stream(refreshes.withColumn("_set", names), group, seq, "_set", failed)
