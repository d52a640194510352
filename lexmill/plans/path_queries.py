"""Queries over names, paths and ignore rules that are derived from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions.languages import EXTENSIONS, FILE_NAMES, _by_name, detect_language
from lexmill.plans.tables import table
from lexmill.plans.text_queries import _parts
from lexmill.sources import ignore

NAMES = ["lib/main.dart", "src/App.tsx", "src/index.mts", "a/b/script.PY", "Dockerfile", "docker/Dockerfile.prod", "lib/l10n/app_es.arb", "game/x.luau", "logo.png", "app.exe", ".gitignore", "README", "data.bin", "a.tar.gz", "Makefile", "conf/.hidden.yaml"]
RULED = ["build/a.js", "src/build/x.js", "a.min.js", ".env", ".env.example", "conf/.env.local", "keys/server.pem", "lib/user.g.dart", "src/user.dart", "node_modules/p/i.js", "out", "README.md", "id_rsa.pub", "x.lock", "docs/out.md", "flutter/ephemeral/a.txt", "x/Flutter/ephemeral/b", "my.egg-info/top", ".git"]
SCOPED = ["a.log", "keep.log", "top.txt", "a.md", "b.md", "tmp/x.py"]


def _chosen(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql_chosen(values: list[str], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{number} % {len(values)} + 1]"


def split_identifier_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of brands and keys, in parts."""
    number = F.col("p_partkey").cast("string")
    tokens = F.array(F.concat(F.lit("get"), F.replace("p_brand", F.lit("#"), F.lit("No")), F.lit("By_"), number, F.lit("ID")), F.concat(F.lit("parse"), number, F.lit("XMLToÁrbol__"), F.lower(F.substring("p_type", 1, 4))), F.concat(F.upper(F.substring("p_type", 1, 5)), F.lit("Server"), number, F.lit("x")))
    rows = table(spark, sf_dir, "part").select(F.explode(tokens).alias("token")).distinct()
    return rows.select("token", F.posexplode(tx.split_identifier(F.col("token"))).alias("place", "part"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of a file name for each document."""
    path = F.concat_ws("/", "source", "lang", _chosen(NAMES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", detect_language(F.col("path")).alias("language"))


def path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw paths of six kinds: normalized, and seen from the root ``src1``."""
    kind, number = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    raw = (
        F.when(kind == 0, F.concat("source", F.lit("//"), "lang", F.lit("/./"), number, F.lit(".txt"))).when(kind == 1, F.concat(F.lit("/"), "source", F.lit("/"), number, F.lit("/")))
        .when(kind == 2, F.concat(F.lit("C:\\"), "source", F.lit("\\"), number, F.lit(".py"))).when(kind == 3, F.concat(F.lit("./"), "source", F.lit("/"), number)).when(kind == 4, F.col("source")).otherwise(F.lit("/"))
    )
    paths, root = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_path(raw).alias("path")), F.lit("src1")
    return paths.select("doc_id", "path", tx.is_within(F.col("path"), root).alias("within"), tx.relative_path(F.col("path"), root).alias("relative"), tx.join_path(root, F.col("path")).alias("joined"))


def ignore_rules_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard excludes over a path for each document."""
    path = F.concat_ws("/", "source", _chosen(RULED, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", ignore.ignored(F.col("path"), ignore.HARD_EXCLUDES).alias("ignored"))


def gitignore_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source a folder with rules of its own, even ones other than odd ones, below rules of the root."""
    docs = table(spark, sf_dir, "documents")
    name = _chosen(SCOPED, F.col("doc_id"))
    path = F.when(F.col("doc_id") % 5 == 0, F.concat_ws("/", "source", name)).otherwise(F.concat_ws("/", "source", "lang", name))
    even = F.substring("source", 4, 9).cast("int") % 2 == 0
    own = F.when(even, F.array(*map(F.lit, ["*.log", "en/", "!keep.log", "/top.txt"]))).otherwise(F.array(*map(F.lit, ["*.md", "!a.md"])))
    rules = docs.select("source").distinct().select(F.col("source").alias("base"), F.posexplode(own).alias("seq", "pattern"))
    root = docs.select(F.lit("").alias("base"), F.lit(0).alias("seq"), F.lit("tmp/").alias("pattern")).distinct()
    return ignore.layered(docs.select(path.alias("path")).distinct(), root.union(rules)).select("path", "ignored")


QUERIES = {f.__name__: f for f in (split_identifier_cases, language_detect, path_algebra, ignore_rules_last_match, gitignore_scope)}


def _language_sql() -> str:
    cases = " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in _by_name(FILE_NAMES).items())
    endings = " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in _by_name(EXTENSIONS).items())
    return rf"""
WITH p AS (SELECT doc_id, path, lower(string_split(path, '/')[-1]) AS name FROM (SELECT doc_id, source || '/' || lang || '/' || {_sql_chosen(NAMES, 'doc_id')} AS path FROM documents)),
x AS (SELECT doc_id, path, name, regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) AS ext FROM p)
SELECT doc_id, path, CASE {cases} WHEN starts_with(name, 'dockerfile.') THEN 'dockerfile' {endings} END AS language FROM x"""


def _hard_sql() -> str:
    """The excludes part by part: a pattern without a slash matches a folder or the file by name, one with a slash at its
    end a folder only; the last one that matches decides."""
    verdicts = []
    for pattern in reversed(ignore.HARD_EXCLUDES):
        body = pattern.removeprefix("!").rstrip("/")
        parts = "c[1:len(c) - 1]" if pattern.endswith("/") else "c"
        inner = body.removeprefix("**/")
        found = f"contains('/' || path, '/{inner}/')" if "/" in inner else f"len(list_filter({parts}, lambda x: x GLOB '{body}')) > 0"
        verdicts.append(f"WHEN {found} THEN {str(not pattern.startswith('!')).lower()}")
    return f"""
SELECT doc_id, path, CASE {" ".join(verdicts)} ELSE false END AS ignored
FROM (SELECT doc_id, path, string_split(path, '/') AS c FROM (SELECT doc_id, source || '/' || {_sql_chosen(RULED, 'doc_id')} AS path FROM documents))"""


ORACLES = {
    "split_identifier_cases": rf"""
WITH n AS (SELECT p_brand, p_type, p_partkey::VARCHAR AS k FROM part),
v AS (SELECT DISTINCT unnest(['get' || replace(p_brand, '#', 'No') || 'By_' || k || 'ID', 'parse' || k || 'XMLToÁrbol__' || lower(substr(p_type, 1, 4)), upper(substr(p_type, 1, 5)) || 'Server' || k || 'x']) AS token FROM n),
t AS (SELECT token, {_parts('token')} AS parts FROM v)
SELECT token, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS place, unnest(parts) AS part FROM t""",
    "language_detect": _language_sql(),
    "path_algebra": r"""
WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '//' || lang || '/./' || doc_id || '.txt' WHEN 1 THEN '/' || source || '/' || doc_id || '/' WHEN 2 THEN 'C:\' || source || '\' || doc_id || '.py'
  WHEN 3 THEN './' || source || '/' || doc_id WHEN 4 THEN source ELSE '/' END AS raw FROM documents),
p AS (SELECT doc_id, starts_with(raw, '/') AS absolute, list_filter(string_split(replace(raw, '\', '/'), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM r),
w AS (SELECT doc_id, CASE WHEN absolute THEN '/' ELSE '' END || array_to_string(parts, '/') AS path, NOT absolute AND parts[1] = 'src1' AS within, parts FROM p)
SELECT doc_id, path, within, CASE WHEN within AND len(parts) > 1 THEN array_to_string(parts[2:], '/') END AS relative, 'src1/' || path AS joined FROM w""",
    "ignore_rules_last_match": _hard_sql(),
    "gitignore_scope": f"""
WITH p AS (SELECT DISTINCT source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS folder, {_sql_chosen(SCOPED, 'doc_id')} AS name FROM documents),
x AS (SELECT *, source || '/' || CASE WHEN folder = '' THEN '' ELSE folder || '/' END || name AS path, CAST(substr(source, 4) AS INTEGER) % 2 = 0 AS even FROM p)
SELECT path, CASE WHEN starts_with(name, 'tmp/') THEN true WHEN even THEN folder = 'en' OR name = 'a.log' OR (name = 'top.txt' AND folder = '') ELSE name = 'b.md' END AS ignored FROM x""",
}
