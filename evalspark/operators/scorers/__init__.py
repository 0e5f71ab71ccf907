"""The built-in scorers; importing this package registers them."""

from evalspark.operators.scorers import answers, ifeval, judged, jsonlike, rouge, tools  # noqa: F401
