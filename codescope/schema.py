"""Fixed row types, as DDL strings."""

FUNCTION = (
    "struct<name:string,signature:string,types:string,body:string,lines_of_code:bigint,"
    "cyclomatic_complexity:bigint,parameters:bigint,returns:boolean,summary:string>"
)
ANALYSIS = f"struct<imports:array<string>,functions:array<{FUNCTION}>,types:array<string>,exports:array<string>>"
CACHE = f"path string, last_modified bigint, fingerprint string, analysis {ANALYSIS}"
FILES = "path string, last_modified bigint, content string"
TREE = "path string, rel_path string, name string, last_modified bigint, length bigint"
INFERENCE_LOG = "call_id string, model string, duration_s double, input_tokens bigint, output_tokens bigint"
