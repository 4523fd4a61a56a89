"""Package name and version from package.json and Cargo.toml rows of a files table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory_of, name_of
from ..functions.text import let

NPM, CARGO = "package.json", "Cargo.toml"


def _manifests(files: DataFrame, name: str, root: str, all_levels: bool) -> DataFrame:
    """Rows of one manifest kind; of the root directory only unless told otherwise."""
    if all_levels:
        return files.filter(name_of(F.col("path")) == name)
    return files.filter(F.col("path") == (f"{root}/{name}" if root else name))


def _json_string(document: Column, key: str) -> Column:
    found = F.try_variant_get(document, f"$.{key}", "variant")
    # A number or an object is not taken for text.
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(document, f"$.{key}", "string"))


def _toml_string(text: Column, key: str) -> Column:
    """A string under [package], the dotted key package.<key>, or <key> of an inline table ``package = { ... }``; null otherwise."""
    plain = F.regexp_replace(text, r'(?s)""".*?"""|\'\'\'.*?\'\'\'', '""')
    section = F.regexp_extract(plain, r"(?md)^[ \t]*\[[ \t]*package[ \t]*\][^\n]*\n((?:(?!^[ \t]*\[)[^\n]*(?:\n|\z))*+)", 1)
    value = r"""[ \t]*=[ \t]*(?:"((?:[^"\\\n]|\\.)*+)"|'([^'\n]*+)')"""
    name = rf"""["']?{key}["']?"""

    def read(where: Column, left: str) -> Column:
        basic, literal = (F.regexp_extract(where, rf"(?md)^[ \t]*{left}{value}", g) for g in (1, 2))
        found = where.rlike(rf"(?md)^[ \t]*{left}{value}")
        unescaped = F.regexp_replace(basic, r'\\(["\\])', "$1")
        return F.when(found, F.when(literal != "", literal).otherwise(unescaped))

    top = F.regexp_extract(plain, r"(?md)\A((?:(?!^[ \t]*\[)[^\n]*(?:\n|\z))*+)", 1)
    # An inline table stands on one line; its entries become lines of their own, commas inside strings aside.
    inline = F.regexp_extract(top, r"""(?md)^[ \t]*["']?package["']?[ \t]*=[ \t]*\{((?:[^"'}\n]|"(?:[^"\\\n]|\\.)*+"|'[^'\n]*+')*+)\}""", 1)
    entries = F.regexp_replace(inline, r"""((?:[^"',\n]|"(?:[^"\\\n]|\\.)*+"|'[^'\n]*+')*+),""", "$1\n")
    return F.coalesce(read(section, name), read(top, rf"package[ \t]*\.[ \t]*{name}"), read(entries, name))


def _named(rows: DataFrame, values: Column, keep: list[str]) -> DataFrame:
    return rows.select(*keep, values.alias("_v")).select(*keep, "_v.name", "_v.version")


def npm_packages(files: DataFrame, root: str = "", all_levels: bool = False) -> DataFrame:
    """manifest, name, version where both are strings; bad JSON is passed over."""
    rows = _manifests(files, NPM, root, all_levels).withColumnRenamed("path", "manifest")
    both = let(
        F.try_parse_json("content"),
        lambda v: F.struct(_json_string(v, "name").alias("name"), _json_string(v, "version").alias("version")),
    )
    return _named(rows, both, ["manifest"]).filter("name IS NOT NULL AND version IS NOT NULL")


def cargo_packages(files: DataFrame, root: str = "", all_levels: bool = False) -> DataFrame:
    """manifest, name, version of [package] where both are strings."""
    rows = _manifests(files, CARGO, root, all_levels).withColumnRenamed("path", "manifest")
    both = F.struct(
        _toml_string(F.col("content"), "name").alias("name"), _toml_string(F.col("content"), "version").alias("version")
    )
    return _named(rows, both, ["manifest"]).filter("name IS NOT NULL AND version IS NOT NULL")


def packages(files: DataFrame, root: str = "", all_levels: bool = False) -> DataFrame:
    """name, version over both kinds: Cargo wins over npm for the same name."""
    both = npm_packages(files, root, all_levels).withColumn("rank", F.lit(0)).unionByName(
        cargo_packages(files, root, all_levels).withColumn("rank", F.lit(1))
    )
    return last_wins_packages(both)


def last_wins_packages(ranked: DataFrame) -> DataFrame:
    """One version per name: of the highest rank, then of the last manifest."""
    return ranked.groupBy("name").agg(F.max_by("version", F.struct("rank", "manifest")).alias("version"))


def project_name(files: DataFrame, folder: str | None = None, root: str = "") -> DataFrame:
    """One row: Cargo name, else npm name, else the folder's name, else ``unknown``."""
    names = _root_names(files, root, all_levels=False)
    found = names.agg(F.max("cargo").alias("cargo"), F.max("npm").alias("npm"))
    return found.select(F.coalesce("cargo", "npm", F.lit(folder), F.lit("unknown")).alias("project_name"))


def project_names(files: DataFrame) -> DataFrame:
    """directory, project_name for every directory that has a manifest."""
    names = _root_names(files, "", all_levels=True).groupBy("directory").agg(
        F.max("cargo").alias("cargo"), F.max("npm").alias("npm")
    )
    folder = F.when(F.col("directory") != "", name_of(F.col("directory")))
    return names.select("directory", F.coalesce("cargo", "npm", folder, F.lit("unknown")).alias("project_name"))


def _root_names(files: DataFrame, root: str, all_levels: bool) -> DataFrame:
    cargo = _manifests(files, CARGO, root, all_levels).select(
        directory_of(F.col("path")).alias("directory"),
        _toml_string(F.col("content"), "name").alias("cargo"),
        F.lit(None).cast("string").alias("npm"),
    )
    npm = _manifests(files, NPM, root, all_levels).select(
        directory_of(F.col("path")).alias("directory"),
        F.lit(None).cast("string").alias("cargo"),
        let(F.try_parse_json("content"), lambda v: _json_string(v, "name")).alias("npm"),
    )
    return cargo.unionByName(npm)
