"""Source-like tables derived from the given tables by SQL.

One text per table that Spark and DuckDB both run, so that a query and its oracle
read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Table a fixture is derived from, where that is not ``documents``.
SOURCE = {"inference_log": "events", "model_responses": "conversations"}
# Tables whose rows carry whole texts to work on, with their key.
KEYS = {"documents": "doc_id", "pages": "page_id"}

# Each file ends with the whole text of its document as a block of comment lines.
FIXTURES = {
    "code_files": """
SELECT doc_id, source AS project,
  concat(source, '/',
    CASE WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 13 = 0 THEN '__tests__/' ELSE '' END,
    'pkg', CAST(doc_id % 5 AS STRING), '/m', CAST(doc_id AS STRING),
    CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' ELSE '.rs' END) AS path,
  CAST(1704067200 + doc_id * 60 AS BIGINT) AS last_modified,
  concat(replace(CASE doc_id % 4
    WHEN 0 THEN concat('import os~from pkg', CAST(doc_id % 5 AS STRING), ' import a, b as c~def f', CAST(doc_id AS STRING),
      '(x, y=1) -> int:~    if x and y:~        return 1~', repeat('    y = y + 1~', CAST(doc_id % 9 AS INT)),
      '    return 2~~class C', CAST(doc_id AS STRING), ':~    def g(self):~        for i in self:~            pass~~    def h(self, k):~        return k~')
    WHEN 1 THEN concat('import { a } from "lib', CAST(doc_id % 7 AS STRING), '";~const r = require("fs");~export const h', CAST(doc_id AS STRING),
      ' = (a, b) => {~  if (a&&b) { return 1 }~', repeat('  b = b + a;~', CAST(doc_id % 9 AS INT)), '  return a && b~}~export async function p', CAST(doc_id AS STRING), '() {~  return 1~}~')
    WHEN 2 THEN concat('import * as z from "./z";~export interface T', CAST(doc_id AS STRING), ' { a: number }~function k(a): number {~  return a~}~export const q = (n: number): string => "x";~')
    ELSE concat('use std::io;~use crate::m', CAST(doc_id % 6 AS STRING), ';~/// doc~pub struct S', CAST(doc_id AS STRING), ' { a: u8 }~enum E { A, B }~pub fn run(a: u8, b: Vec<u8>) -> u8 {~    if a > 1 { return a; }~',
      repeat('    let a = a + 1;~', CAST(CASE WHEN doc_id % 97 = 3 THEN 210 ELSE doc_id % 29 END AS INT)),
      '    match a { 0 => 1, _ => a }~}~fn quiet() {}~')
  END, '~', chr(10)),
  CASE doc_id % 4 WHEN 0 THEN '# ' ELSE '// ' END,
  replace(text, chr(10), concat(chr(10), CASE doc_id % 4 WHEN 0 THEN '# ' ELSE '// ' END)), chr(10)) AS content
FROM documents""",
    "tree_files": """
SELECT path, last_modified, content FROM code_files
UNION ALL SELECT concat(project, '/README.md'), CAST(1704067200 AS BIGINT), concat('# ', project) FROM (SELECT DISTINCT project FROM code_files) a
UNION ALL SELECT concat(project, '/package.json'), CAST(1704067200 AS BIGINT), concat('{"name": "', CASE WHEN project LIKE '%12' THEN 'both' ELSE concat('npm-', project) END, '", "version": "1.0.', CAST(length(project) AS STRING), '"}') FROM (SELECT DISTINCT project FROM code_files) b WHERE project LIKE '%1' OR project LIKE '%2'
UNION ALL SELECT concat(project, '/Cargo.toml'), CAST(1704067200 AS BIGINT), replace(concat('[package]~name = "', CASE WHEN project LIKE '%12' THEN 'both' ELSE concat('crate-', project) END, '"~version = "0.1.0"~~[dependencies]~name = "decoy"~'), '~', chr(10)) FROM (SELECT DISTINCT project FROM code_files) c WHERE project LIKE '%2' OR project LIKE '%3'
UNION ALL SELECT concat(project, '/.gitignore'), CAST(1704067200 AS BIGINT), replace('# comment~pkg4/~!pkg4/keep.py~m*7.*~!*17.js~*.log~', '~', chr(10)) FROM (SELECT DISTINCT project FROM code_files) d WHERE project LIKE '%3' OR project LIKE '%4' OR project LIKE '%7'
UNION ALL SELECT concat(project, '/pkg0/setup.py'), CAST(1704067200 AS BIGINT), '' FROM (SELECT DISTINCT project FROM code_files) e WHERE project LIKE '%5' OR project LIKE '%2'
UNION ALL SELECT concat(project, '/target/Cargo.toml'), CAST(1704067200 AS BIGINT), '' FROM (SELECT DISTINCT project FROM code_files) f WHERE project LIKE '%6'""",
    "analysis_cache": """
SELECT path, CASE WHEN doc_id % 10 = 0 THEN last_modified - 1 ELSE last_modified END AS last_modified, concat('cached:', path) AS payload
FROM code_files WHERE doc_id % 17 <> 0
UNION ALL SELECT concat('gone/', path), last_modified, 'cached:gone' FROM code_files WHERE doc_id % 50 = 0""",
    "inference_log": """
SELECT event_id AS call_id, event_type AS model, value + 0.25 AS duration_s, user_id AS input_tokens, event_id % 100 AS output_tokens FROM events""",
    "model_responses": """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'generate' ELSE 'chat' END AS provider,
  CASE WHEN turn % 5 = 4 THEN '{}'
       WHEN conv_id % 2 = 0 THEN concat('{"response": "', role, ' ', CAST(turn AS STRING), '"}')
       ELSE concat('{"choices": [{"message": {"content": "', role, ' ', CAST(turn AS STRING), '"}}]}') END AS body
FROM conversations""",
    "bad_files": """
SELECT path, content, CASE doc_id % 40 WHEN 3 THEN 'Permission denied' ELSE NULL END AS io_error, doc_id % 40 = 4 AS broken,
  concat(content, CASE WHEN doc_id % 40 = 7 THEN 'fn open() { [' ELSE '' END) AS text FROM code_files
UNION ALL SELECT path, content, NULL, false, content FROM tree_files WHERE path LIKE '%.md' OR path LIKE '%.json'""",
    "file_snapshots": """
SELECT path, last_modified, content FROM code_files
UNION ALL SELECT path, last_modified + 3600, concat(content, 'x', chr(10)) FROM code_files WHERE doc_id % 3 = 0
UNION ALL SELECT path, last_modified, content FROM code_files WHERE doc_id % 7 = 0""",
}

USES = {"bad_files": ("code_files", "tree_files"), "tree_files": ("code_files",), "analysis_cache": ("code_files",), "file_snapshots": ("code_files",)}


def with_clause(*names: str) -> str:
    """``WITH`` clause that defines the named fixtures (and those they build on)."""
    needed = []
    for name in names:
        needed += [n for n in (*USES.get(name, ()), name) if n not in needed]
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in needed) + "\n"


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The given files are one row group each, hence one task; the keys spread them, whatever their size.
    return table.repartition(spark.sparkContext.defaultParallelism, KEYS[name]) if name in KEYS else table


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = SOURCE.get(name, "documents")
    base_table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(with_clause(name) + f"SELECT * FROM {name}")
