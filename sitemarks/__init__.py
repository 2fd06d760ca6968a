"""Web-technology fingerprinting on Spark: page archive in, evidence and results out."""

from sitemarks.operators.evidence import evidence_rows, html_evidence, network_evidence, with_evidence
from sitemarks.operators.results import detect, with_summary
from sitemarks.sources.catalog import load_catalog

__all__ = [
    "detect",
    "evidence_rows",
    "html_evidence",
    "load_catalog",
    "network_evidence",
    "with_evidence",
    "with_summary",
]
