"""The tables of an estate, as DDL. seq keeps the order in which rows were read; later rows win where an id repeats."""

EXTRA = "struct<table: string, lineage_tag: string, dynamic_format: boolean, format_string_expression: string, invalid_metadata: array<string>>"
METRICS = (
    "seq long, id string, name string, tool string, model string, source_path string, source_root string, expression string, dialect string, "
    f"description string, display_folder string, format_string string, data_type string, is_hidden boolean, extra {EXTRA}"
)
ASSETS = (
    "seq long, id string, name string, tool string, source_path string, model string, source_root string, format string, dataset_reference string, pbir_version string, "
    "definition_files array<string>, report_level_measures array<string>, pages array<string>, referenced_tables array<string>"
)
VISUALS = "asset_id string, seq long, id string, page string, visual_type string, metric_names array<string>"
REFERENCES = (
    "asset_id string, seq long, visual_id string, page string, `table` string, name string, kind string, source string, role string, query_ref string, aggregation string"
)
USAGE = "asset_id string, opens long, unique_users long, exports long, last_accessed string"
NOTES = "seq long, stage string, kind string, message string, material boolean, path string"
FINDINGS = "kind string, severity string, confidence double, metric_ids array<string>, summary string, evidence string, asset_ids array<string>"

#: Goes up when a table changes in a way that readers must know.
IR_VERSION = 2


def names(ddl: str) -> list[str]:
    """The columns of a DDL string whose types hold no comma at the top level."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0].strip("`"))
            word = ""
        else:
            word += c
    return out
