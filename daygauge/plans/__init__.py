from daygauge.plans import audits, domain, files, models, statistics, tables  # noqa: F401
from daygauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
