"""Finding, scoring, masking and auditing sensitive values in text, on Spark."""

from veilwork.plans.scan import mask, scan, scan_and_mask
from veilwork.policy import AlertRoute, EntityRule, Policy

__all__ = ["AlertRoute", "EntityRule", "Policy", "mask", "scan", "scan_and_mask"]
