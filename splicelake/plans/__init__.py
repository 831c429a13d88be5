"""Query groups; importing this package registers them all."""

from splicelake.plans import benchmark_plans, join_plans, metric_plans, reporter_plans, scalar_plans, sequence_plans, source_plans, tissue_plans, usage_plans  # noqa: F401
from splicelake.plans.registry import ORACLES, QUERIES  # noqa: F401
