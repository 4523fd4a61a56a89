"""DuckDB SQL for each registered query, written independently of the Spark side.

Its regular expressions are of the same family as the semantics being matched, so the
header patterns stand here in their plain form; bodies are cut by line numbers and
windows instead of look-ahead or array scans.
"""

from __future__ import annotations

from .fixtures import with_clause

NL = "chr(10)"
# White space outside ASCII counts too; characters outside ASCII are mapped to "z" for word bounds.
SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def as_ascii(text: str) -> str:
    return rf"regexp_replace({text}, '[\x{{80}}-\x{{10FFFF}}]', 'z', 'g')"


def lines_sql(text: str) -> str:
    return (
        f"CAST(CASE WHEN {text} = '' THEN 0 ELSE len(string_split({text}, {NL})) "
        f"- CASE WHEN ends_with({text}, {NL}) THEN 1 ELSE 0 END END AS BIGINT)"
    )


def count_sql(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT)"


PY_BRANCH = r"\b(if|elif|for|while|except|and|or)\b"
JS_BRANCH = r"\b(if|else|for|while|do|switch|case|catch|&&|\|\|)\b"
PY_DEF = r"(?m)^(\s*)def\s+(\w+)\s*\((.*?)\)(?:\s*->\s*([^:]+))?\s*:"
PY_IMPORT = r"(?m)^(?:from\s+(\S+)\s+)?import\s+(.+)$"
JS_DECL = r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\((.*?)\)(?:\s*:\s*([^{]+))?\s*\{"
JS_ARROW = (
    r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\((.*?)\)(?:\s*:\s*([^=]+))?\s*=>"
)
JS_IMPORT = (
    r"""(?m)^(?:import\s+(?:(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)(?:\s*,\s*(?:\{[^}]*\}|\*\s+as\s+\w+|\w+))*\s+from\s+)?"""
    r"""[''"](.+?)[''"]|(?:const|let|var)\s+(?:\{[^}]*\}|\w+)\s*=\s*require\s*\(\s*[''"](.+?)[''"]\s*\))(?:;|\s*$)"""
)
IGNORED = (
    r"(^|/)(node_modules|target|dist|build|\.git|\.[^/]*ignore|[^/]*\.(log|tmp|temp|swp|bak))(/|$)"
)
PARAMETERS = "CAST(len(list_filter(string_split(params, ','), lambda p: trim(p) <> '')) AS BIGINT)"

IS_JS = "(path LIKE '%.js' OR path LIKE '%.ts')"
LANGUAGE = (
    "CASE WHEN path LIKE '%.rs' THEN 'rust' WHEN path LIKE '%.js' OR path LIKE '%.ts' THEN 'javascript' "
    "WHEN path LIKE '%.py' THEN 'python' END"
)


def matches(pattern: str, groups: int, source: str) -> str:
    """One row per match: path, content, ord and groups g0..gN."""
    cols = ", ".join(f"regexp_extract_all(content, '{pattern}', {g}) AS l{g}" for g in range(groups + 1))
    picks = ", ".join(f"coalesce(l{g}[i], '') AS g{g}" for g in range(groups + 1))
    return (
        f"(SELECT path, content, CAST(i AS BIGINT) AS ord, {picks} FROM ("
        f"SELECT path, content, {cols}, unnest(generate_series(1, len(regexp_extract_all(content, '{pattern}')))) AS i "
        f"FROM {source}))"
    )


# Text behind a header; header texts are unique within a file here.
REST = "substr(content, strpos(content, g0) + length(g0))"

PARTS = {
    # --- Python -----------------------------------------------------------------
    "py_lines": f"""
SELECT path, ord, g1 AS indent, g2 AS name, g3 AS params, g4 AS ret, unnest(string_split({REST}, {NL})) AS line,
  unnest(generate_series(1, len(string_split({REST}, {NL})))) AS n
FROM {matches(PY_DEF, 4, "code_files WHERE path LIKE '%.py'")}""",
    "py_marked": """
SELECT *, sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER w AS seen FROM py_lines
WINDOW w AS (PARTITION BY path, ord ORDER BY n ROWS UNBOUNDED PRECEDING)""",
    "py_stopped": """
SELECT *, sum(CASE WHEN seen > 0 AND (trim(line) = '' OR NOT starts_with(line, indent)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY path, ord ORDER BY n ROWS UNBOUNDED PRECEDING) AS stops FROM py_marked""",
    "py_bodies": f"""
SELECT path, ord, name, params, ret,
  coalesce(string_agg(line, {NL} ORDER BY n) FILTER (WHERE seen > 0 AND stops = 0), '') AS body
FROM py_stopped GROUP BY ALL""",
    "py_functions": f"""
SELECT path, 'python' AS language, ord, name,
  concat('def ', name, '(', params, ')', CASE WHEN ret = '' THEN '' ELSE concat(' -> ', ret) END, ':') AS signature,
  ret AS types, body, {lines_sql('body')} AS lines_of_code, 1 + {count_sql(as_ascii('body'), PY_BRANCH)} AS cyclomatic_complexity,
  {PARAMETERS} AS parameters, ret <> '' AS returns
FROM py_bodies""",
    "py_imports": f"""
SELECT path, 'python' AS language, ord, CASE WHEN g1 = '' THEN g2 ELSE concat(g2, ' from ', g1) END AS import
FROM {matches(PY_IMPORT, 2, "code_files WHERE path LIKE '%.py'")}""",
    "py_types": rf"""
SELECT path, 'python' AS language, ord, g1 AS type FROM {matches(r'(?m)^\s*class\s+(\w+)', 1, "code_files WHERE path LIKE '%.py'")}""",
    # --- JavaScript -------------------------------------------------------------
    "js_heads": f"""
SELECT 1 AS pass, * FROM {matches(JS_DECL, 3, f"code_files WHERE {IS_JS}")}
UNION ALL SELECT 2 AS pass, * FROM {matches(JS_ARROW, 3, f"code_files WHERE {IS_JS}")}""",
    "js_lines": f"""
SELECT path, pass, ord, g1 AS name, g2 AS params, g3 AS ret, unnest(string_split({REST}, {NL})) AS line,
  unnest(generate_series(1, len(string_split({REST}, {NL})))) AS n FROM js_heads""",
    "js_depth": """
SELECT *, sum(length(replace(line, '}', '')) - length(replace(line, '{', ''))) OVER
  (PARTITION BY path, pass, ord ORDER BY n ROWS UNBOUNDED PRECEDING) AS depth,
  max(n) OVER (PARTITION BY path, pass, ord) AS last FROM js_lines""",
    "js_ends": """
SELECT path, pass, ord, coalesce(min(n) FILTER (WHERE depth = 0), max(n)) AS stop FROM js_depth
WHERE NOT (n = last AND line = '') GROUP BY ALL""",
    "js_bodies": f"""
SELECT path, pass, d.ord, name, params, ret, concat(string_agg(line, {NL} ORDER BY n), {NL}) AS body
FROM js_depth d JOIN js_ends e USING (path, pass, ord) WHERE n <= stop GROUP BY ALL""",
    "js_functions": f"""
SELECT path, 'javascript' AS language, row_number() OVER (PARTITION BY path ORDER BY pass, ord) AS ord, name,
  concat('const ', name, ' = (', params, ')', CASE WHEN ret = '' THEN '' ELSE concat(': ', ret) END, '=> ') AS signature,
  '' AS types, body, {lines_sql('body')} AS lines_of_code, 1 + {count_sql(as_ascii('body'), JS_BRANCH)} AS cyclomatic_complexity,
  {PARAMETERS} AS parameters, ret <> '' AS returns
FROM js_bodies""",
    "js_imports": f"""
SELECT path, 'javascript' AS language, ord, CASE WHEN g1 = '' THEN g2 ELSE g1 END AS import
FROM {matches(JS_IMPORT, 2, f"code_files WHERE {IS_JS}")}""",
    "js_types": rf"""
SELECT path, 'javascript' AS language, ord, g1 AS type
FROM {matches(r'(?m)^\s*(?:export\s+)?(?:type|interface)\s+(\w+)', 1, f"code_files WHERE {IS_JS}")}""",
    "js_exports": rf"""
SELECT path, 'javascript' AS language, ord, g1 AS export
FROM {matches(r'(?m)^export\s+(?:const|let|var|function|class|type|interface)\s+(\w+)', 1, f"code_files WHERE {IS_JS}")}""",
    # --- Rust -------------------------------------------------------------------
    "rust_imports": r"""
SELECT path, 'rust' AS language, ord, replace(replace(g0, '::', ' :: '), ';', ' ;') AS import
FROM """ + matches(r"(?m)^use [\w:]+;", 0, "code_files WHERE path LIKE '%.rs'"),
    "rust_types": rf"""
SELECT path, 'rust' AS language, ord,
  concat(CASE WHEN g1 = '' THEN '' ELSE concat('# [doc = "', g1, '"] ') END, trim(regexp_replace(regexp_replace(g2, '([:,;{{}}])', ' \1 ', 'g'), ' +', ' ', 'g'))) AS type
FROM {matches(r'(?m)^(?:///(.*)\n)?((?:pub )?(?:struct|enum) .*)$', 2, "code_files WHERE path LIKE '%.rs'")}""",
    "rust_exports": rf"""
SELECT path, 'rust' AS language, ord, concat(g1, ' ', g2) AS export
FROM {matches(r'(?m)^pub (fn|struct|enum|type) (\w+)', 2, "code_files WHERE path LIKE '%.rs'")}""",
    "rust_heads": rf"""
SELECT path, ord, g0, g1 AS head, g2 AS name, g3 AS params, g4 AS ret, g5 AS block
FROM {matches(r'(?m)^(?:pub )?(fn (\w+)\((.*)\)( -> [^{]*)?) (\{(?:\}|\n(?: .*\n)*\}))', 5, "code_files WHERE path LIKE '%.rs'")}""",
    "rust_functions": rf"""
SELECT path, 'rust' AS language, ord, name, trim(signature) AS signature,
  array_to_string(list_transform(regexp_extract_all(signature, ':\s*([^,\)]+)', 1), lambda t: trim(t)), ', ') AS types,
  CASE WHEN lines_of_code <= 20 THEN trim(regexp_replace(regexp_replace(block, '([;{{}},+]|=>)', ' \1 ', 'g'), '\s+', ' ', 'g')) END AS body,
  lines_of_code, cyclomatic_complexity, parameters, ret <> '' AS returns
FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(head, '(->|[:,<>(])', ' \1 ', 'g'), ' +', ' ', 'g'), '\( ', '(', 'g'), ' \)', ')', 'g') AS signature,
  CAST(len(string_split(g0, {NL})) AS BIGINT) AS lines_of_code,
  1 + {count_sql('block', r'\bif\b|=>')} AS cyclomatic_complexity, {PARAMETERS} AS parameters FROM rust_heads)""",
    # --- all languages ----------------------------------------------------------
    "all_functions": "SELECT * FROM py_functions UNION ALL SELECT * FROM js_functions UNION ALL SELECT * FROM rust_functions",
    "all_imports": "SELECT * FROM py_imports UNION ALL SELECT * FROM js_imports UNION ALL SELECT * FROM rust_imports",
    "all_types": "SELECT * FROM py_types UNION ALL SELECT * FROM js_types UNION ALL SELECT * FROM rust_types",
    "all_exports": "SELECT * FROM js_exports UNION ALL SELECT * FROM rust_exports",
    "asked": "SELECT * FROM all_functions WHERE language = 'rust' OR lines_of_code > 6",
    "dirs": rf"""
SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM tree_files
WHERE regexp_matches(path, '/(Cargo\.toml|package\.json|setup\.py|requirements\.txt)$')
  AND NOT regexp_matches(regexp_extract(path, '^(.*)/[^/]*$', 1), '{IGNORED}')""",
    "manifests": r"""
SELECT path AS manifest, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory,
  CASE WHEN path LIKE '%.json' THEN regexp_extract(content, '"name": "([^"]*)"', 1) ELSE regexp_extract(content, 'name = "([^"]*)"', 1) END AS name,
  CASE WHEN path LIKE '%.json' THEN regexp_extract(content, '"version": "([^"]*)"', 1) ELSE regexp_extract(content, 'version = "([^"]*)"', 1) END AS version
FROM tree_files WHERE path LIKE '%/package.json' OR path LIKE '%/Cargo.toml'""",
    "packages": "SELECT manifest, name, version FROM manifests WHERE name <> '' AND version <> ''",
    "last_packages": """
SELECT name, arg_max(version, concat(CASE WHEN manifest LIKE '%.toml' THEN '1' ELSE '0' END, manifest)) AS version FROM packages GROUP BY name""",
    "prompts": f"""
SELECT path, language, ord, concat(
  CASE WHEN lines_of_code > 200 AND language = 'rust' THEN 'Summarize this large Rust function:'
    WHEN language = 'rust' THEN 'Summarize the following Rust function:'
    WHEN language = 'python' THEN 'Summarize the following Python function:'
    ELSE 'Summarize the following JavaScript/TypeScript function:' END,
  {NL}, {NL}, 'Name: ', name, {NL}, 'Signature: ', signature,
  CASE WHEN language = 'javascript' THEN '' ELSE concat({NL}, 'Types: ', types) END,
  CASE WHEN lines_of_code > 200 AND language = 'rust'
    THEN concat({NL}, {NL}, 'Function body in parts:', {NL}, {NL},
      'Please provide a summary of the function''s purpose and behavior based on these parts.')
    ELSE concat({NL}, 'Body: ', coalesce(body, '(function body omitted)')) END) AS prompt,
  lines_of_code FROM all_functions""",
    "file_lists": f"""
SELECT path, {LANGUAGE} AS language, last_modified,
  (SELECT string_agg(import, '|' ORDER BY ord) FROM all_imports a WHERE a.path = c.path) AS imports,
  (SELECT string_agg(concat(name, ':', CAST(lines_of_code AS VARCHAR)), '|' ORDER BY ord) FROM all_functions a WHERE a.path = c.path) AS functions,
  (SELECT string_agg(type, '|' ORDER BY ord) FROM all_types a WHERE a.path = c.path) AS types,
  (SELECT string_agg(export, '|' ORDER BY ord) FROM all_exports a WHERE a.path = c.path) AS exports
FROM code_files c""",
    "function_counts": "SELECT path, count(*) AS n FROM all_functions GROUP BY path",
}

# What each part reads, fixtures included.
_NEEDS = {
    "py_lines": ["code_files"], "py_marked": ["py_lines"], "py_stopped": ["py_marked"], "py_bodies": ["py_stopped"],
    "py_functions": ["py_bodies"], "py_imports": ["code_files"], "py_types": ["code_files"],
    "js_heads": ["code_files"], "js_lines": ["js_heads"], "js_depth": ["js_lines"], "js_ends": ["js_depth"],
    "js_bodies": ["js_ends"], "js_functions": ["js_bodies"], "js_imports": ["code_files"], "js_types": ["code_files"],
    "js_exports": ["code_files"], "rust_imports": ["code_files"], "rust_types": ["code_files"],
    "rust_exports": ["code_files"], "rust_heads": ["code_files"], "rust_functions": ["rust_heads"],
    "all_functions": ["py_functions", "js_functions", "rust_functions"],
    "all_imports": ["py_imports", "js_imports", "rust_imports"], "all_types": ["py_types", "js_types", "rust_types"],
    "all_exports": ["js_exports", "rust_exports"], "asked": ["all_functions"], "dirs": ["tree_files"],
    "manifests": ["tree_files"], "packages": ["manifests"], "last_packages": ["packages"], "prompts": ["all_functions"],
    "file_lists": ["all_imports", "all_functions", "all_types", "all_exports"], "function_counts": ["all_functions"],
}


def sql(select: str, *reads: str) -> str:
    """``select`` behind a WITH clause that defines everything it reads."""
    order: list[str] = []
    fixtures: list[str] = []

    def need(name: str) -> None:
        if name in PARTS:
            for below in _NEEDS[name]:
                need(below)
            if name not in order:
                order.append(name)
        elif name not in fixtures:
            fixtures.append(name)

    for name in reads:
        need(name)
    head = with_clause(*fixtures).rstrip() if fixtures else "WITH"
    parts = ",\n".join(f"{n} AS ({PARTS[n]})" for n in order)
    return head + (",\n" if fixtures and parts else " ") + parts + "\n" + select


FUNCTION_COLUMNS = "path, ord, name, signature, types, lines_of_code, cyclomatic_complexity, parameters, returns"


def _functions(name: str) -> str:
    return sql(f"SELECT {FUNCTION_COLUMNS} FROM {name}", name)


REPORT = f"""
, blocks AS (
  SELECT 0 AS section_ord, '' AS path, concat('# Code Summary', {NL}) AS text
  UNION ALL SELECT 1, '', '## Documentation Files'
  UNION ALL SELECT 2, path, concat('- ', path) FROM tree_files WHERE regexp_matches(path, '\\.(md|txt|rst)$')
  UNION ALL SELECT 3, '', concat({NL}, '## Package Information')
  UNION ALL SELECT 4, name, concat('- ', name, ': ', version) FROM last_packages
  UNION ALL SELECT 5, '', concat({NL}, '## Code Analysis')
  UNION ALL SELECT 6, path, concat('## ', path, {NL}, {NL},
    coalesce((SELECT concat('**Imports:**', {NL}, string_agg(concat('- ', import, {NL}), '' ORDER BY ord), {NL}) FROM all_imports a WHERE a.path = c.path HAVING count(*) > 0), ''),
    coalesce((SELECT concat('**Functions:**', {NL}, string_agg(concat('- ', name, {NL}, '  Signature: ', signature, {NL},
      '  Lines of code: ', CAST(lines_of_code AS VARCHAR), {NL}, '  Cyclomatic complexity: ', CAST(cyclomatic_complexity AS VARCHAR), {NL},
      '  Parameters: ', CAST(parameters AS VARCHAR), {NL}, '  Returns: ', CAST(returns AS VARCHAR), {NL}, {NL}), '' ORDER BY ord))
      FROM all_functions a WHERE a.path = c.path HAVING count(*) > 0), ''),
    coalesce((SELECT concat('**Types:**', {NL}, string_agg(concat('```rust', {NL}, type, {NL}, '```', {NL}, {NL}), '' ORDER BY ord)) FROM all_types a WHERE a.path = c.path HAVING count(*) > 0), ''),
    coalesce((SELECT concat('**Exports:**', {NL}, string_agg(concat('- ', export, {NL}), '' ORDER BY ord), {NL}) FROM all_exports a WHERE a.path = c.path HAVING count(*) > 0), ''),
    {NL}) FROM code_files c)
SELECT section_ord, path, CAST(unnest(generate_series(0, len(string_split(text, {NL})) - 1)) AS BIGINT) AS ord,
  unnest(string_split(text, {NL})) AS line FROM blocks"""

GITIGNORE = r"""
SELECT path FROM tree_files WHERE NOT (regexp_matches(path, '^[^/]*[347]/') AND (
  regexp_matches(path, '/pkg4/') OR regexp_matches(path, '\.log$')
  OR (regexp_matches(path, '/m[^/]*7\.[^/]*$') AND NOT regexp_matches(path, '17\.js$'))))"""

INSIDE = "EXISTS (SELECT 1 FROM dirs d WHERE starts_with(t.path, concat(d.dir, '/')))"


def oracle_sql() -> dict[str, str]:
    return {
        "line_count": f"SELECT doc_id, {lines_sql('text')} AS lines FROM documents",
        "token_count": (
            f"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '{SPACES}'), lambda t: t <> '')) AS BIGINT) AS tokens "
            "FROM documents"
        ),
        "cyclomatic_py": f"SELECT doc_id, 1 + {count_sql(as_ascii('text'), PY_BRANCH)} AS complexity FROM documents",
        "cyclomatic_js": f"SELECT doc_id, 1 + {count_sql(as_ascii('text'), JS_BRANCH)} AS complexity FROM documents",
        "page_braces": (
            "SELECT page_id, CAST(length(html) - length(replace(html, '{', '')) AS BIGINT) AS opened, "
            "CAST(length(html) - length(replace(html, '}', '')) AS BIGINT) AS closed FROM pages"
        ),
        "language_of": sql(f"SELECT path, {LANGUAGE} AS language FROM tree_files", "tree_files"),
        "code_files": sql(r"SELECT path FROM tree_files WHERE regexp_matches(path, '[^/]\.(rs|js|ts|py)$')", "tree_files"),
        "corpus_file_count": sql(
            r"SELECT count(*) AS files FROM tree_files WHERE regexp_matches(path, '[^/]\.(rs|js|ts|py)$')", "tree_files"
        ),
        "unsupported_files": sql(f"SELECT path FROM tree_files WHERE ({LANGUAGE}) IS NULL", "tree_files"),
        "documentation_files": sql(r"SELECT path FROM tree_files WHERE regexp_matches(path, '\.(md|txt|rst)$')", "tree_files"),
        "drop_ignored": sql(f"SELECT path FROM tree_files WHERE NOT regexp_matches(path, '{IGNORED}')", "tree_files"),
        "code_directories": sql("SELECT dir FROM dirs", "dirs"),
        "in_code_directory": sql(f"SELECT path FROM tree_files t WHERE {INSIDE}", "dirs"),
        "apply_gitignore": sql(GITIGNORE, "tree_files"),
        "collect_code_files": sql(
            rf"SELECT path FROM ({GITIGNORE}) t WHERE {INSIDE} AND NOT regexp_matches(path, '{IGNORED}') "
            r"AND regexp_matches(path, '[^/]\.(rs|js|ts|py)$')",
            "dirs",
        ),
        "distinct_files": sql(
            "SELECT path, max(last_modified) AS last_modified, md5(arg_max(content, last_modified)) AS content_md5 "
            "FROM file_snapshots GROUP BY path",
            "file_snapshots",
        ),
        "py_imports": sql("SELECT path, ord, import FROM py_imports", "py_imports"),
        "py_functions": _functions("py_functions"),
        "py_types": sql("SELECT path, ord, type FROM py_types", "py_types"),
        "py_exports": sql("SELECT path, CAST(0 AS BIGINT) AS exports FROM code_files WHERE path LIKE '%.py'", "code_files"),
        "py_body": sql("SELECT path, ord, name, body FROM py_functions", "py_functions"),
        "js_imports": sql("SELECT path, ord, import FROM js_imports", "js_imports"),
        "js_functions": _functions("js_functions"),
        "js_types": sql("SELECT path, ord, type FROM js_types", "js_types"),
        "js_exports": sql("SELECT path, ord, export FROM js_exports", "js_exports"),
        "js_body": sql("SELECT path, ord, name, body FROM js_functions", "js_functions"),
        "rust_imports": sql("SELECT path, ord, import FROM rust_imports", "rust_imports"),
        "rust_types": sql("SELECT path, ord, type FROM rust_types", "rust_types"),
        "rust_exports": sql("SELECT path, ord, export FROM rust_exports", "rust_exports"),
        "rust_functions": _functions("rust_functions"),
        "rust_body": sql("SELECT path, ord, name, body FROM rust_functions", "rust_functions"),
        "rust_signature_types": sql("SELECT path, ord, types FROM rust_functions", "rust_functions"),
        "all_imports": sql("SELECT path, language, ord, import FROM all_imports", "all_imports"),
        "all_functions": sql(f"SELECT language, {FUNCTION_COLUMNS} FROM all_functions", "all_functions"),
        "all_types": sql("SELECT path, language, ord, type FROM all_types", "all_types"),
        "all_exports": sql("SELECT path, language, ord, export FROM all_exports", "all_exports"),
        "parameter_count": sql("SELECT path, ord, parameters FROM all_functions", "all_functions"),
        "needs_summary": sql("SELECT path, ord, name FROM asked", "asked"),
        "build_prompt": sql("SELECT path, ord, prompt FROM prompts", "prompts"),
        "build_large_prompt": sql("SELECT path, ord, prompt FROM prompts WHERE lines_of_code > 200 AND language = 'rust'", "prompts"),
        "provider_prompt": sql(
            "SELECT path, ord, concat('Summarize this function in one line: ', prompt) AS prompt FROM prompts", "prompts"
        ),
        "prompt_parts": sql(
            f""", lines AS (SELECT path, ord, unnest(string_split(rtrim(body, {NL}), {NL})) AS line,
  unnest(generate_series(1, len(string_split(rtrim(body, {NL}), {NL})))) AS n FROM all_functions WHERE body <> '')
SELECT path, ord, CAST((n - 1) // 5 + 1 AS BIGINT) AS part, string_agg(line, {NL} ORDER BY n) AS text FROM lines GROUP BY ALL""",
            "all_functions",
        ),
        "extract_response": sql(
            r"""SELECT conv_id, turn, coalesce(CASE WHEN provider = 'generate' THEN json_extract_string(body, '$.response')
  ELSE json_extract_string(body, '$.choices[0].message.content') END, '') AS answer FROM model_responses""",
            "model_responses",
        ),
        "npm_packages": sql("SELECT manifest, name, version FROM packages WHERE manifest LIKE '%.json'", "packages"),
        "cargo_packages": sql("SELECT manifest, name, version FROM packages WHERE manifest LIKE '%.toml'", "packages"),
        "last_wins_packages": sql("SELECT name, version FROM last_packages", "last_packages"),
        "project_name": sql(
            """SELECT directory, coalesce(max(nullif(name, '')) FILTER (WHERE manifest LIKE '%.toml'), max(nullif(name, '')), regexp_extract(directory, '[^/]*$')) AS project_name
FROM manifests GROUP BY directory""",
            "manifests",
        ),
        "cache_hits": sql(
            "SELECT path, f.last_modified, payload FROM code_files f JOIN analysis_cache c USING (path, last_modified)",
            "analysis_cache",
        ),
        "cache_misses": sql(
            "SELECT path, last_modified FROM code_files f WHERE NOT EXISTS (SELECT 1 FROM analysis_cache c "
            "WHERE c.path = f.path AND c.last_modified = f.last_modified)",
            "analysis_cache",
        ),
        "stale_cache": sql(
            "SELECT path, last_modified, payload FROM analysis_cache WHERE path NOT IN (SELECT path FROM code_files)",
            "analysis_cache",
        ),
        "incremental_analyze": sql(
            """SELECT f.path, f.last_modified, c.path IS NOT NULL AS cached,
  CASE WHEN c.path IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS functions, coalesce(payload, import) AS first_import
FROM code_files f LEFT JOIN analysis_cache c ON c.path = f.path AND c.last_modified = f.last_modified
LEFT JOIN function_counts u ON u.path = f.path LEFT JOIN all_imports i ON i.path = f.path AND i.ord = 1""",
            "analysis_cache", "function_counts", "all_imports",
        ),
        "stream_analyze": sql(
            """SELECT path, max(last_modified) AS last_modified, coalesce(max(n), 0) AS functions
FROM file_snapshots LEFT JOIN function_counts USING (path) GROUP BY path""",
            "file_snapshots", "function_counts",
        ),
        "assemble_analysis": sql(
            "SELECT path, language, last_modified, coalesce(imports, '') AS imports, coalesce(functions, '') AS functions, "
            "coalesce(types, '') AS types, coalesce(exports, '') AS exports FROM file_lists",
            "file_lists",
        ),
        "analysis_errors": sql(
            f"""SELECT path, 'AnalysisError' AS kind, concat('No suitable analyzer found for file: ', path) AS message FROM bad_files WHERE ({LANGUAGE}) IS NULL
UNION ALL SELECT path, 'IoError', io_error FROM bad_files WHERE ({LANGUAGE}) IS NOT NULL AND io_error IS NOT NULL
UNION ALL SELECT path, 'IoError', 'stream did not contain valid UTF-8' FROM bad_files WHERE broken
UNION ALL SELECT path, 'AnalysisError', 'unbalanced brackets' FROM bad_files WHERE text <> content""",
            "bad_files",
        ),
        "files_from_table": sql("SELECT path, last_modified, md5(content) AS content_md5 FROM code_files", "code_files"),
        "require_nonempty": sql(r"SELECT count(*) > 0 AS nonempty FROM tree_files WHERE regexp_matches(path, '[^/]\.(rs|js|ts|py)$')", "tree_files"),
        "read_source_tree": sql(
            "SELECT path AS rel_path, CAST(octet_length(encode(content)) AS BIGINT) AS length, md5(content) AS content_md5 FROM tree_files", "tree_files"
        ),
        "analysis_cache_log": sql(
            """SELECT path, last_modified + CASE WHEN doc_id % 7 = 0 THEN 120 WHEN doc_id % 3 = 0 THEN 60 ELSE 0 END AS last_modified, coalesce(n, 0) AS functions
FROM code_files LEFT JOIN function_counts USING (path)
WHERE doc_id % 7 = 0 OR doc_id % 3 = 0 OR (doc_id % 17 <> 0 AND doc_id % 10 <> 0)""",
            "code_files", "function_counts",
        ),
        "write_report": sql(
            REPORT.replace("SELECT section_ord, path, CAST", "SELECT row_number() OVER (ORDER BY section_ord, path, ord) AS number, line FROM (SELECT section_ord, path, CAST") + ")",
            "last_packages", "all_imports", "all_functions", "all_types", "all_exports",
        ),
        "own_language": sql(
            """SELECT path, language, ord, import FROM all_imports
UNION ALL SELECT path, 'toml', 1, regexp_extract(content, 'name = "([^"]*)"', 1) FROM tree_files WHERE path LIKE '%.toml' AND content <> ''
UNION ALL SELECT path, 'toml', 2, 'decoy' FROM tree_files WHERE path LIKE '%.toml' AND content <> ''""",
            "all_imports", "tree_files",
        ),
        "call_metrics": sql(
            "SELECT call_id, CAST(input_tokens + output_tokens AS BIGINT) AS total_tokens, "
            "round((input_tokens + output_tokens) / duration_s, 4) AS tokens_per_second FROM inference_log",
            "inference_log",
        ),
        "inference_metrics": sql(
            """SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  round(sum(duration_s), 3) AS duration_s, round(sum(input_tokens + output_tokens) / sum(duration_s), 3) AS tokens_per_second
FROM inference_log GROUP BY model""",
            "inference_log",
        ),
        "summarize": sql(
            "SELECT path, ord, CASE WHEN language = 'rust' OR lines_of_code > 6 THEN signature END AS summary FROM all_functions",
            "all_functions",
        ),
        "render_report": sql(REPORT, "last_packages", "all_imports", "all_functions", "all_types", "all_exports"),
        "language_rollup": sql(
            """SELECT language, count(DISTINCT path) AS files, count(*) AS functions, CAST(sum(lines_of_code) AS BIGINT) AS sum_loc,
  max(lines_of_code) AS max_loc, round(avg(lines_of_code), 6) AS avg_loc, CAST(sum(cyclomatic_complexity) AS BIGINT) AS sum_complexity,
  max(cyclomatic_complexity) AS max_complexity, round(avg(cyclomatic_complexity), 6) AS avg_complexity
FROM all_functions GROUP BY ROLLUP (language)""",
            "all_functions",
        ),
        "import_usage": sql(
            "SELECT import, count(DISTINCT path) AS files, count(*) AS uses FROM all_imports GROUP BY import", "all_imports"
        ),
        "import_top": sql(
            "SELECT import, count(DISTINCT path) AS files, count(*) AS uses FROM all_imports GROUP BY import "
            "ORDER BY files DESC, import LIMIT 10",
            "all_imports",
        ),
        "export_index": sql(
            """SELECT export, path, n AS files, n > 1 AS duplicated FROM (SELECT DISTINCT export, path FROM all_exports) e
JOIN (SELECT export, count(DISTINCT path) AS n FROM all_exports GROUP BY export) c USING (export)""",
            "all_exports",
        ),
        "documentation_coverage": sql(
            r"""SELECT regexp_extract(path, '^([^/]*)/', 1) AS directory,
  CAST(sum(CASE WHEN regexp_matches(path, '\.(md|txt|rst)$') THEN 1 ELSE 0 END) AS BIGINT) AS docs,
  CAST(sum(CASE WHEN regexp_matches(path, '[^/]\.(rs|js|ts|py)$') THEN 1 ELSE 0 END) AS BIGINT) AS code_files
FROM tree_files WHERE regexp_matches(path, '\.(md|txt|rst)$') OR regexp_matches(path, '[^/]\.(rs|js|ts|py)$') GROUP BY 1""",
            "tree_files",
        ),
    }
