"""The tool façade: names with their parameter, answered by the registered queries; Catalyst pushes the filter down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: tool -> (query, parameter column); no column: the whole listing.
TOOLS: dict[str, tuple[str, str | None]] = {
    "list_programs": ("lst01_programs", None), "get_program": ("lst02_program_detail", "id"), "get_data_items": ("lst03_data_items", "program"), "list_copybooks": ("lst04_copybooks", None),
    "get_copybook_usage": ("lst05_copybook_usage", "copybook"), "get_copybook_structure": ("lst06_copybook_structure", "copybook"), "get_program_conditions": ("lst07_conditions", "program"),
    "get_program_parameters": ("lst08_parameters", "program"), "get_program_cics": ("lst13_cics_commands", "program"), "get_paragraph_flow": ("lst14_paragraph_flow", "program"),
    "list_bridge_programs": ("lst17_bridge_programs", None), "list_copybook_risks": ("lst18_copybook_risks", None), "list_risk_programs": ("lst20_risk_programs", None),
    "list_business_domains": ("lst22_business_domains", None), "get_business_domain": ("lst23_business_domain", "domain"), "list_jcl_jobs": ("lst24_jcl_jobs", None), "get_jcl_job": ("lst25_jcl_job_detail", "job"),
    "get_program_jcl": ("lst26_program_jcl", "program"), "get_dataset_usage": ("lst27_dataset_usage", "dsname"), "list_db_tables": ("lst28_db_tables", None), "get_table_usage": ("lst29_table_usage", "tab"),
    "get_program_table_access": ("lst30_program_tables", "program"), "list_codebases": ("lst35_codebases", None), "get_call_chain": ("pth01_call_chain", "program"), "get_impact_analysis": ("pth02_impact", "program"),
    "get_dead_paragraphs": ("pth04_dead_paragraphs", "program"), "get_dead_code_summary": ("agg05_dead_code_summary", None), "get_migration_sequence": ("pth07_migration_sequence", None),
    "get_cross_codebase_calls": ("joi20_cross_codebase_calls", None), "get_shared_data_channels": ("agg06_shared_channels", None), "get_cross_program_data_flow": ("agg07_cross_program_flow", "program"),
    "get_file_accessors": ("agg08_file_accessors", "file"), "get_effort_estimates": ("agg04_effort", None), "get_validation_report": ("agg17_validation", None), "get_dashboard_stats": ("agg01_dashboard", None),
    "get_program_conditional_logic": ("lst09_conditional_logic", "doc_id"), "get_program_sql": ("lst12_sql_statements", "program"), "get_data_flow": ("lst15_data_flow", "doc_id"), "list_volume_estimates": ("lst21_volume_estimates", None),
    "trace_field_impact": ("pth03_field_impact", "field"), "get_gap_analysis": ("txt44_tagged_gaps", None), "list_business_gaps": ("txt44_tagged_gaps", "severity"), "get_gap_coverage_summary": ("agg12_gap_coverage", None),
    "get_target_stack_dashboard": ("agg13_target_dashboard", None), "list_modernization_candidates": ("lst19_candidates", None), "get_program_source": ("src23_program_source", "name"),
    "get_data_hierarchy": ("txt31_data_hierarchy", "item_id"), "get_type_mappings": ("txt32_pic_types", "item_id"), "search_programs": ("fts02_programs", None), "get_error_handlers": ("lst10_error_paragraphs", "name"),
    "get_external_interfaces": ("lst11_interfaces", "program"), "get_data_item_hierarchy": ("lst16_data_hierarchy", "program"), "list_entities": ("lst47_entities", None), "get_cics_flows": ("joi04_cics_flows", "src"), "get_queue_flows": ("joi06_mq_flows", "queue"),
    "list_external_tables": ("lst37_external_tables", None), "get_table_mappings": ("lst39_mappings", "tab"), "list_target_services": ("lst43_target_services", "repo"), "list_target_repos": ("lst42_target_repos", None),
}


def call(spark: SparkSession, sf_dir: str, tool: str, value: object = None) -> DataFrame:
    """The tool's rows; ``value`` restricts a tool that has a parameter. An unknown tool is a KeyError."""
    from .registry import queries

    query, column = TOOLS[tool]
    rows = queries()[query](spark, sf_dir)
    return rows.where(F.col(column) == F.lit(value)) if column and value is not None else rows


def named_queries() -> list[str]:
    """The named queries that ``run_named`` answers."""
    from .registry import queries

    return sorted(q for q in queries() if q.startswith("nq"))


def run_named(spark: SparkSession, sf_dir: str, name: str, limit: int | None = None) -> DataFrame:
    """A named query's rows, as many as an ad-hoc query may have."""
    from ..operators.adhoc import clamp
    from .registry import queries

    if name not in named_queries():
        raise KeyError(name)
    return queries()[name](spark, sf_dir).limit(clamp(limit))
