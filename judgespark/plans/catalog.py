"""All registered queries. Importing this module fills the registry."""

from judgespark.plans import agreement, ingestion, live, reports, runs, scoring  # noqa: F401
from judgespark.plans.registry import QUERIES, SQL  # noqa: F401
