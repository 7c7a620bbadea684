"""Planning of small groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def allocate_minutes(df: DataFrame, key: str, item: str, weight: str, minutes: int, least: int) -> DataFrame:
    """Whole minutes by weight, at least ``least`` each; the items of least weight go until that fits, the last one gets the rest.

    A key's items are a student's few contents of one session.
    """

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((max(w, 0.05), i) for w, i in zip(group[weight], group[item], strict=True)), key=lambda r: (-r[0], r[1]))
        rows = rows[: max(1, min(len(rows), minutes // least if least else len(rows)))]
        total = sum(w for w, _ in rows)
        given = [max(int(round(minutes * w / total)), least if minutes >= least else 0) for w, _ in rows[:-1]]
        given.append(max(0, minutes - sum(given)))
        return pd.DataFrame({key: group[key].iloc[0], item: [i for _, i in rows], "minutes": given})

    types = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(plan, f"{key} {types[key]}, {item} {types[item]}, minutes int")
