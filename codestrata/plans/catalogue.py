"""All registered queries."""

from codestrata.plans import (  # noqa: F401
    corpus, detect, services, config, schema, summary, progress, streams, overview, roundtrips,
)
from codestrata.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "overview"
