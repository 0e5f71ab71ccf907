"""evalspark: model-evaluation analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the plan, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from evalspark.operators.cases import expand_cases, split_reference  # noqa: E402
from evalspark.operators.scoring import list_scorers, register_scorer, score  # noqa: E402
from evalspark.operators.summary import badcases, run_summary  # noqa: E402
from evalspark.session import configure, get_session  # noqa: E402

__all__ = [
    "badcases", "configure", "expand_cases", "get_session", "list_scorers",
    "register_scorer", "run_summary", "score", "split_reference",
]
