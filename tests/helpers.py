import math

import numpy as np
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return f"{v:.9g}"
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    return sorted(tuple(one(v) for v in t) for t in df[sorted(df.columns)].itertuples(index=False))
