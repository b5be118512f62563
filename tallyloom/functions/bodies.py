"""Bodies as the studied harness shows them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def indented_or_raw(body: pd.Series) -> pd.Series:
    """Any JSON indented by two, its keys in the order in which they came; text that is no JSON as it is.

    Values are written as Python's json module writes them: 2.50 becomes 2.5, characters beyond ASCII are escaped, of a
    repeated key the last one holds. No built-in function keeps the order of keys, so this is a batch-wise UDF. Null
    stays null; JSON that is nested too deeply to be parsed is left as it is.
    """

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), indent=2)
        except (ValueError, RecursionError):
            return text

    return body.map(one, na_action="ignore").astype(object)
