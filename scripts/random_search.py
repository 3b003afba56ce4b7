"""Go on with the full random search: 80 candidates, 5 folds.

usage: python scripts/random_search.py LEDGER_PATH [fits] [sf_dir]
Run it again, in as many sessions as it takes, until it prints the best settings.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from attrition.operators import split as sp  # noqa: E402
from attrition.operators.search import SearchLedger  # noqa: E402
from attrition.plans.queries_model import NUM_FEATURES, split_df  # noqa: E402
from attrition.schemas import CATEGORICAL_COLUMNS  # noqa: E402
from attrition.session import local_session  # noqa: E402


def main() -> None:
    path = sys.argv[1]
    fits = int(sys.argv[2]) if len(sys.argv) > 2 else None
    sf_dir = sys.argv[3] if len(sys.argv) > 3 else "/root/testdata/sf0.1"
    spark = local_session(8)
    train = split_df(spark, sf_dir).where(F.col("split") == "train")
    train = sp.stratified_folds(sp.class_weight(train, target="target"), id_col="customerid", target="target", k=5)
    ledger = SearchLedger(train, path, CATEGORICAL_COLUMNS, NUM_FEATURES, id_col="customerid")
    left = ledger.run(fits)
    print(f"{left} fits are open" if left else ledger.best())


if __name__ == "__main__":
    main()
