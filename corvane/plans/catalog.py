"""All queries: importing the modules registers them."""

from corvane.plans import analysis, chunks, conversations, elements, evaluation, training, workflows  # noqa: F401
from corvane.plans.registry import QUERIES, SQL  # noqa: F401
