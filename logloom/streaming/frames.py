"""Row batches of the stateful processors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def collect_batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order."""
    return pd.concat(list(rows)).sort_values(order, kind="stable")


def with_object_strings(df: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: Arrow-backed ones may come in chunks, which the writer refuses."""
    text = [c for c in df.columns if isinstance(df[c].dtype, pd.StringDtype)]
    return df.astype(dict.fromkeys(text, object))
