"""Table schemas. Every table carries ``repo``; '' stands for a single repository."""

FILES = "repo string, path string, size long, token_est long"
CONTENT = "repo string, path string, content binary"
CODE_NODES = "repo string, path string, type string, name string, start_line int, end_line int, seq int, parse_status string"
NODES = (
    "repo string, node_id string, type string, name string, size long, token_est long, start_line int, end_line int, "
    "level int, summary string, risks array<string>"
)
EDGES = "repo string, src string, dst string, relationship string"
CHANGES = "repo string, path string, status string"
CONTAINS, IMPORTS = "CONTAINS", "IMPORTS"
EXTERNAL, PROJECT = "external::", "project::"
