"""The language of a file by its name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import base_name

#: Language, then its file extensions.
EXTENSIONS = """
dart: .dart
python: .py .pyi
javascript: .js .mjs .cjs .jsx
typescript: .ts .mts .cts
tsx: .tsx
lua: .lua
luau: .luau
markdown: .md .markdown .mdx
yaml: .yaml .yml
json: .json .arb
go: .go
rust: .rs
java: .java
kotlin: .kt .kts
swift: .swift
c: .c .h
cpp: .cc .cpp .hpp
csharp: .cs
ruby: .rb
php: .php
shell: .sh .bash .zsh
powershell: .ps1 .psm1
batch: .bat .cmd
sql: .sql
html: .html .htm
css: .css .less
scss: .scss .sass
vue: .vue
svelte: .svelte
toml: .toml
ini: .ini .cfg .conf
properties: .properties
gradle: .gradle
xml: .xml .plist
graphql: .graphql .gql
protobuf: .proto
terraform: .tf .hcl
text: .txt .rst
"""

#: Language, then whole file names (lower case).
FILE_NAMES = """
dockerfile: dockerfile containerfile
make: makefile
groovy: jenkinsfile
text: procfile
ruby: gemfile rakefile vagrantfile
"""

#: Languages whose chunks follow their syntax; the others are cut into windows of lines.
SYNTAX_LANGUAGES = ("dart", "python", "javascript", "typescript", "tsx", "lua", "luau", "markdown", "yaml", "json")


def _by_name(table: str) -> dict[str, str]:
    return {name: line.split(":")[0] for line in table.strip().splitlines() for name in line.split(":")[1].split()}


def extension(path: Column) -> Column:
    """The last extension of a name, lower case; a name's leading dots open none."""
    return F.regexp_extract(F.lower(base_name(path)), r"^\.*[^.].*?(\.[^.]*)$", 1)


def detect_language(path: Column) -> Column:
    """The language, or null where a file is not indexed."""
    names, extensions = (F.create_map(*(F.lit(x) for x in chain(*_by_name(t).items()))) for t in (FILE_NAMES, EXTENSIONS))
    name = F.lower(base_name(path))
    return F.coalesce(F.try_element_at(names, name), F.when(F.startswith(name, F.lit("dockerfile.")), F.lit("dockerfile")), F.try_element_at(extensions, extension(path)))
