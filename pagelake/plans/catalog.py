"""All queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more, rendered
from . import queries as _queries
from .oracles import ORACLES

NAMES = (
    "get_markdown get_text get_html get_json get_with_options page_metadata needs_render page_usage max_chars_limits input_classify url_parts content_types link_origins map_links map_summary map_filtered "
    "search_sections search_topk search_report extract_headings extract_links extract_tables extract_definitions extract_selector extract_metadata extract_json extract_summary batch_dedupe batch_fail_fast batch_summary batch_manifest "
    "crawl_summary crawl_replay cache_status cache_latest cache_keys artifacts_summary artifacts_list artifacts_inspect prune_keep_last prune_older_than prune_max_bytes session_compose session_conflicts session_filter session_inspect replay_scope cookie_header "
    "redact_titles authorize_predicates envelope plan_validation redact_urls normal_urls"
).split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(_queries, name) for name in NAMES} | rendered.QUERIES | more.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | rendered.ORACLES
