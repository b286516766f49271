"""Web pages as tables: a PySpark engine from raw HTML to structured rows."""

from pagemill.operators.crawl import CrawlRun, crawl, load_run, page_index
from pagemill.operators.extract import extract
from pagemill.operators.flatten import flatten_results, normalize_columns
from pagemill.plans.job import JobResult, JobSpec, run_job
from pagemill.session import configure
from pagemill.sinks.export import export

__all__ = [
    "CrawlRun", "JobResult", "JobSpec", "configure", "crawl", "export", "extract",
    "flatten_results", "load_run", "normalize_columns", "page_index", "run_job",
]
