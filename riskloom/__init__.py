"""riskloom: content-risk scanning and calendar analytics as Spark DataFrame jobs."""

from riskloom.config import ScanConfig
from riskloom.plans.scan import scan_events, scan_texts

__all__ = ["ScanConfig", "scan_events", "scan_texts"]
