"""Ignore rules with the semantics of gitignore patterns, as Columns and joins."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is never indexed.  These come before any rules of a folder's own, so those
#: cannot bring a secret back.
HARD_EXCLUDES = """
.git .hg/ .svn/ .idea/ .vs/ .vscode/
node_modules/ bower_components/ .pnpm-store/ .yarn/ .dart_tool/ .pub-cache/ .pub/ .fvm/ .venv/ venv/ __pycache__/ .mypy_cache/ .pytest_cache/ .ruff_cache/ .tox/ *.egg-info/ .gradle/ Pods/
build/ dist/ out/ target/ .next/ .nuxt/ .svelte-kit/ .turbo/ .cache/ .parcel-cache/ coverage/ DerivedData/ **/flutter/ephemeral/ **/Flutter/ephemeral/
*.min.js *.min.css *.map *.g.dart *.freezed.dart *.mocks.dart *.pb.dart *.lock package-lock.json pnpm-lock.yaml
.env .env.* !.env.example !.env.sample *.pem *.key *.p12 *.pfx *.jks *.keystore id_rsa* id_ecdsa* id_ed25519* *.kdbx key.properties
""".split()

MAX_RULE_BYTES = 256 * 1024


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a relative path, include flag) of one pattern line; None if it says nothing.

    The expression matches the path itself, or a path below a matching directory."""
    line = pattern.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\")
    directory = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in line.rstrip("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1 if body[i + 1] == "!" else 0) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = "^" if anchored else "^(?:.*/)?"
    return start + out + ("/.*$" if directory else "(?:/.*)?$"), not negated


def compiled(patterns: list[str]) -> list[tuple[str, bool]]:
    return [p for p in map(pattern_regex, patterns) if p]


def ruled_out(path: str, is_dir: bool, rules: list[tuple[str, str, bool]], hard: tuple[str, ...] | list[str] = ()) -> bool:
    """Whether an entry, of a folder that is not ruled out itself, is: by the last match of ``hard`` patterns, or by that
    of rules (base, regex, include), the deepest last, each on the path below its base."""
    subject = path + "/" if is_dir else path
    verdict = False
    for regex, include in _hard(tuple(hard)):
        if regex.match(subject):
            verdict = include
    if verdict:
        return True
    for base, regex, include in rules:
        if _regex(regex).match(subject[len(base) + 1 :] if base else subject):
            verdict = include
    return verdict


@lru_cache(maxsize=16)
def _hard(patterns: tuple[str, ...]) -> list[tuple[re.Pattern, bool]]:
    return [(re.compile(regex), include) for regex, include in compiled(list(patterns))]


@lru_cache(maxsize=10_000)
def _regex(regex: str) -> re.Pattern:
    return re.compile(regex)


def last_match(path: Column, patterns: list[str]) -> Column:
    """True or false by the last pattern that matches; null if none does."""
    verdict = F.lit(None).cast("boolean")
    for regex, include in compiled(patterns):
        verdict = F.when(path.rlike(regex), F.lit(include)).otherwise(verdict)
    return verdict


def ignored(path: Column, patterns: list[str]) -> Column:
    return F.coalesce(last_match(path, patterns), F.lit(False))


def _compiled_rules(batches):
    for batch in batches:
        rows = [(base, seq, *p) for base, seq, pattern in zip(*(batch.column(n).to_pylist() for n in ("base", "seq", "pattern"))) if (p := pattern_regex(pattern))]
        base, seq, regex, include = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(base, pa.string()), pa.array(seq, pa.int32()), pa.array(regex, pa.string()), pa.array(include, pa.bool_())], names=["base", "seq", "regex", "include"])


def layered(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths with ``ignored`` by rules (base, seq, pattern) that each hold below their own folder.

    Deeper folders and later lines win; what an ignored folder holds stays ignored, whatever is
    said of it further down.  Each path is only joined with rules of its ancestors."""
    known = rules.select("base", "seq", "pattern").mapInArrow(_compiled_rules, "base string, seq int, regex string, include boolean")
    steps = F.split("path", "/")
    nodes = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth"))
    is_dir = F.col("depth") < F.size(F.split("path", "/"))
    node = F.array_join(F.slice(F.split("path", "/"), 1, F.col("depth")), "/")
    nodes = nodes.select("path", "depth", node.alias("node"), is_dir.alias("is_dir"))
    bases = nodes.select("path", "depth", "node", "is_dir", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("up"))
    bases = bases.withColumn("base", F.array_join(F.slice(F.split("node", "/"), 1, F.col("up")), "/"))
    sub = F.when(F.col("base") == "", F.col("node")).otherwise(F.substring(F.col("node"), F.length("base") + 2, F.length("node")))
    subject = F.when(F.col("is_dir"), F.concat(sub, F.lit("/"))).otherwise(sub)
    matched = bases.join(known, "base").filter(F.regexp(subject, F.col("regex")))
    verdict = matched.groupBy("path", "depth").agg(F.max_by("include", F.struct("up", "seq")).alias("include"))
    hit = verdict.groupBy("path").agg(F.bool_or("include").alias("ignored"))
    return paths.join(hit, "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def with_skip_reason(listing: DataFrame, max_file_bytes: int) -> DataFrame:
    """Why an entry is not indexed, in the order in which the checks are made; null if it is."""
    reason = (
        F.when(F.col("kind") == "link", "link").when(F.col("placeholder"), "placeholder").when(F.col("ignored"), "ignored").when(F.col("kind") != "file", "other")
        .when(F.col("language").isNull(), "unsupported").when(F.col("size") > max_file_bytes, "too_large")
    )
    return listing.withColumn("skip_reason", reason)
