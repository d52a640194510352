"""Invariants of the chunker, its symbols by language, and the outline against a plain interval model."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import chunking as ch
from lexmill.operators.chunking import ChunkConfig, chunk_documents, lines_of, pieces_of
from lexmill.operators.outline import MAX_DEPTH, outline, symbols

SMALL = ChunkConfig(60, 10, 3)
SOURCES = {
    "python": ("class A:\n    @retry\n    def fetch(self):\n        return 1\n\n    def store(self, x):\n        self.x = x\n", "A > store"),
    "javascript": ("const a = 1;\nasync function sendMail(to) {\n  await x(to);\n}\nmodule.exports = { sendMail };\n", "sendMail"),
    "tsx": ("export const UserCard = (props) => {\n  return <div/>;\n};\n", "UserCard"),
    "lua": ("local M = {}\nfunction Inventory:addItem(item)\n  M.x = item\nend\n", "Inventory:addItem"),
    "luau": ("export type Hit = { d: number }\nfunction Combat.computeDamage(a: number): number\n  return a\nend\n", "Combat.computeDamage"),
    "dart": ("class Auth {\n  /// doc\n  Future<bool> login(String user) async {\n    return true;\n  }\n  bool validateEmail(String e) {\n    return e.isNotEmpty;\n  }\n}\n", "Auth > validateEmail"),
    "markdown": ("# Arquitectura\nuno\n\n## Autenticación\ndos tres cuatro cinco seis\n", "Arquitectura > Autenticación"),
    "yaml": ("server:\n  host: x\n  database:\n    url: abcdefghijklmnop\n    pool: 5\n", "server > database"),
    "json": ('{\n  "game": {\n    "inventory": {\n      "slots": 12345678901234567890\n    }\n  }\n}\n', "game > inventory"),
}


def chunked(spark, documents, config=ChunkConfig()):
    """The chunks (start, end, symbol, text) of each (text, language), all in one job."""
    rows = spark.createDataFrame([(i, t, own) for i, (t, own) in enumerate(documents)], "i int, text string, language string")
    out = [[] for _ in documents]
    for r in sorted(chunk_documents(rows, "i", config).collect(), key=lambda r: (r["i"], r["ordinal"])):
        out[r["i"]].append((r["start_line"], r["end_line"], r["symbol"], r["text"]))
    return out


@pytest.mark.parametrize("config", [ChunkConfig(), SMALL, ChunkConfig(250, 60)])
def test_chunks_cite_their_lines(spark, config):
    texts = [(text, language) for language, (text, _) in SOURCES.items()]
    for (text, language), chunks in zip(texts, chunked(spark, texts, config)):
        lines, covered, end = lines_of(text), set(), 0
        for first, last, _, body in chunks:
            assert end < first <= last and body == "\n".join(lines[first - 1 : last])
            end = last
            covered |= set(range(first, last + 1))
        assert all(i in covered for i, line in enumerate(lines, 1) if line.strip())
        if config is SMALL:
            assert any(s.startswith(SOURCES[language][1]) for _, _, s, _ in chunks), chunks


def test_fallback_windows(spark):
    text = "\n".join(f"line {i} " + "x" * 30 for i in range(40))
    (chunks,) = chunked(spark, [(text, "text")], ChunkConfig(400, 120, 2))
    assert all(len(body) + 1 <= 400 and not symbol for _, _, symbol, body in chunks)
    assert all(a[1] - b[0] + 1 == 2 for a, b in zip(chunks, chunks[1:])) and chunks[-1][1] == 40


def test_edges(spark):
    languages = ["python", "text", None]
    blank = [(t, own) for own in languages for t in (None, "", " \n\t\n")]
    assert chunked(spark, blank) == [[]] * len(blank)
    assert [len(c) for c in chunked(spark, [("x" * 5000, own) for own in languages])] == [1, 1, 1]
    for own in languages:
        spans = [[c[:2] for c in chunks] for chunks in chunked(spark, [("a\n\nb = 1\nc\n".replace("\n", end), own) for end in ("\n", "\r\n", "\r")], SMALL)]
        assert spans[0] == spans[1] == spans[2]
    assert chunked(spark, [("[" * 3000 + "\n" + "]" * 3000, "json")])[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \t#:{}\"'`@~-=", max_size=20), max_size=40), st.sampled_from([*SOURCES, "text"]), st.integers(20, 120))
def test_pieces_cover_every_filled_line_and_are_disjoint(lines, language, most):
    lines = lines_of("\n".join(lines))
    pieces = pieces_of("\n".join(lines), language, ChunkConfig(most, 20, 2))
    covered = {i for p in pieces for i in range(p["first"], p["last"] + 1)}
    assert {i for i, line in enumerate(lines) if line.strip()} <= covered
    if language != "text":
        assert all(a["last"] < b["first"] for a, b in zip(pieces, pieces[1:]))
    for p in pieces:
        assert lines[p["first"]].strip() and lines[p["last"]].strip()
        assert p["end_at"] - p["start_at"] == sum(len(x) + 1 for x in lines[p["first"] : p["last"] + 1])


def test_sections_are_packed_and_split_where_they_are_too_large(spark):
    body = "".join(f"    def m{i}(self):\n        return {i}\n\n" for i in range(6))
    long = "def long():\n" + "".join(f"    x{i} = {i}\n" for i in range(40))
    text = "import os\n\n\nclass A:\n" + body + "\n@cached\n" + long + "\ndef last():\n    pass\n"
    (chunks,) = chunked(spark, [(text, "python")], ChunkConfig(120, 20, 2))
    names = [c[2] for c in chunks]
    # The class is cut between methods, several to a piece; its first piece is described by the class itself.
    assert "A" in names[:2] and "A > m3" in names and sum(s.startswith("A > m") for s in names) < 6
    # The long function is cut into windows that all bear its name, the first with its decorator.
    assert names.count("long") > 2 and any(c[2] == "long" and c[3].startswith("@cached\ndef long") for c in chunks)
    assert names[-1] == "last" and all(len(c[3]) <= 120 + 20 for c in chunks)


def test_a_small_head_goes_with_the_large_body(spark):
    text = "a: 1\nb:\n" + "".join(f"  k{i}: {i * 'x'}\n" for i in range(12))
    assert chunked(spark, [(text, "yaml")], ChunkConfig(60, 20, 1))[0][0][3].startswith("a: 1\nb:\n")


def test_a_small_source_is_named_after_its_first_definition(spark):
    assert [c[2] for c in chunked(spark, [("import x\n\n\nclass User:\n    pass\n\n\ndef f():\n    pass\n", "python")])[0]] == ["User"]


def test_depth_is_bounded():
    text = "".join(" " * i + f"k{i}:\n" for i in range(400))
    depth, section = 0, outline(lines_of(text), "yaml")
    while section.inner:
        depth, section = depth + 1, section.inner[-1]
    assert depth <= MAX_DEPTH + 1 and pieces_of(text, "yaml", ChunkConfig())


# ---------------------------------------------------------------- where sections end

#: Sources with the symbol of every line behind a bar.
MARKED = {
    "python": '''
|import os
A|@app.route(
A|    "x")
A|@cached
A|class A:
A|    x = 1
A > m|    # about m
A > m|    def m(self, a,
A > m|          b):
A > m|        s = """
A > m|def fake():
A > m|"""
A > m|        return {
A > m|1: 2}
A > m|        # still m
|
A|    y = 2
|
|# main
|if __name__ == '__main__':
|    A()
|
f|async def f():
f > g|    def g(): return 1
f|    return g
|
|CONFIG = f("""
|class Not:
|""")
''',
    "javascript": """
|const a = 1;
A|// about A
A|export default class A extends B {
A|  #x = 1;
A > handle|  handle = (e) => {
A > handle|    if (e) { go(); }
A > handle|  };
A > run|  async run(a, { b }) {
A > run|    for (const x of a) {
A > run|      call(x);
A > run|    }
A > run > inner|    const inner = () => b;
A > run|  }
A > v|  get v() { return `}${1}{`; }
A|}
|describe("x", () => {
|  it("function no() {", () => {});
|});
two|function two(
two|  a,
two|)
two|{
two|  return "}"; /* } */
two|}
f|const f = async (x) =>
f|  x + 1;
g|const g = x => x
|let done = true
|module.exports = { f };
""",
    "typescript": """
P|export interface P {
P|  b(): void;
P|}
U|type U =
U|  | "a"
U|  | "b";
C|@Component({
C|  selector: "x",
C|})
C|export class C {
C > constructor|  constructor(private a: X) {}
C > m|  m<T>(x: T): T {
C > m|    return x;
C > m|  }
C > q|  abstract q(): void;
C|}
|const z = 1;
E|enum E { A, B }
""",
    "dart": """
|import 'x.dart';
Auth|/// doc
Auth|class Auth extends Base {
Auth|  final int x = foo(3);
Auth > Auth|  Auth(this.x);
Auth > login|  @override
Auth > login|  Future<User> login(String e) async {
Auth > login|    if (!validate(e)) {
Auth > login|      print("}");
Auth > login|    }
Auth > login|    return _u!;
Auth > login|  }
Auth > ok|  bool get ok => true;
Auth > two|  int two() => 2;
Auth|}
main|void main() {
main|  runApp(App());
main|}
|final y = 3;
""",
    "lua": """
|local M = {}
M.add|--[[ function no()
M.add|]]
M.add|function M.add(a)
M.add|  if a then
M.add|    return function() return "end" end
M.add|  end
M.add|  for i = 1, 2 do print(i) end
M.add|  repeat a = 1 until a
M.add|end
|M.x = 1
g|local g = function(x)
g|  return x
g|end
|return M
""",
    "luau": """
T|type T = {
T|  a: number
T|}
h|function h(a)
h|  local b = if a then 1 else 2
h|  return b
h|end
|return h
""",
    "yaml": """
|# config
server|server:
server > host|  host: x
server > text|  text: |
server > text|    not: a key
server|
server > list|  list:
server > list > name|  - name: a
server > list > val|    val: 1
server > list > name|  - name: b
other|other: 1
q k|"q k": 2
""",
    "json": """
|{
a|  "a": {
a > b|    "b": 1,
a > c|    "c": [
a > c|      {"x": 1}
a > c|    ],
a > d|    "d": "{"
a|  },
e|  "e": 2
|}
""",
    "markdown": """
|intro
Top|# Top
Top|~~~
Top|# nor this
Top|```
Top|~~~~
Top|text
Top|
Top > Sub|Sub
Top > Sub|---
Top > Sub|```python
Top > Sub|# no
Top > Sub|```
Top > Two|## Two ##
Top > Two|    # code
Last|# Last
Last|x
""",
}


@pytest.mark.parametrize("language", MARKED)
def test_every_line_has_the_names_of_what_is_open_around_it(language):
    rows = [line.split("|", 1) for line in MARKED[language].strip("\n").split("\n")]
    lines = [line for _, line in rows]
    found = [" > ".join(n) for n in symbols(lines, language)]
    # A blank line between two sections may count to the one around them.
    expected = [name if line.strip() else got for (name, line), got in zip(rows, found)]
    if language == "yaml":
        expected[0] = found[0]  # the head comment goes with the first key
    assert found == expected


@st.composite
def trees(draw, depth=0):
    """(kind, children): a definition or a plain line, nested."""
    if depth >= 4 or draw(st.booleans()):
        return ("line", draw(st.sampled_from(["x = 1", "call(a)", "s = 'def no():'", "# def no", ""])))
    return ("def", draw(st.lists(trees(depth + 1), max_size=4)))


@settings(max_examples=200, deadline=None)
@given(st.lists(trees(), max_size=6))
def test_python_sections_against_plain_intervals(forest):
    lines, expected, n = [], [], 0

    def write(items, names, indent):
        nonlocal n
        for kind, held in items:
            if kind == "line":
                lines.append(" " * indent + held if held else "")
                expected.append(names if held and not held.startswith("#") else None)
            else:
                own = (*names, f"f{n}")
                lines.append(" " * indent + f"def f{n}():")
                n += 1
                expected.append(own)
                lines.append(" " * (indent + 4) + "pass")
                expected.append(own)
                write(held, own, indent + 4)

    write(forest, (), 0)
    found = symbols(lines, "python")
    assert all(e is None or e == f for e, f in zip(expected, found))


@settings(max_examples=200, deadline=None)
@given(st.lists(trees(), max_size=6), st.booleans())
def test_braces_against_plain_intervals(forest, wide):
    lines, expected, n = [], [], 0

    def write(items, names, indent):
        nonlocal n
        for kind, held in items:
            if kind == "line":
                lines.append(" " * indent + {"# def no": "// function no() {", "s = 'def no():'": "s = '}';", "x = 1": "if (x) { y(); }", "": ""}.get(held, f"{held};"))
                expected.append(names if held and not held.startswith("#") else None)
            else:
                own = (*names, f"f{n}")
                opening = [f"function f{n}(", "  a,", ")", "{"] if wide else [f"function f{n}(a) {{"]
                n += 1
                lines.extend(" " * indent + x for x in opening)
                expected.extend([own] * len(opening))
                write(held, own, indent + 2)
                lines.append(" " * indent + "}")
                expected.append(own)

    write(forest, (), 0)
    found = symbols(lines, "javascript")
    assert all(e is None or e == f for e, f in zip(expected, found)), list(zip(lines, expected, found))


# ---------------------------------------------------------------- folds over pieces


def _plain_without_overlaps(pieces):
    out, end = [], -1
    for first, last in sorted(pieces):
        if max(first, end + 1) <= last:
            out.append((max(first, end + 1), last))
        end = max(end, last)
    return out


def _plain_merged(pieces, config):
    """Repeatedly the first piece that may take in the one after it, then small ones into the piece before them."""
    todo, out = [dict(p) for p in pieces], []
    while todo:
        piece = todo.pop(0)
        while piece["end_at"] - piece["start_at"] < config.min_chars and todo and todo[0]["end_at"] - piece["start_at"] <= config.max_chars:
            after = todo.pop(0)
            piece = piece | {"last": after["last"], "end_at": after["end_at"], "names": max(piece["names"], after["names"], key=len)}
        if out and piece["end_at"] - piece["start_at"] < config.min_chars and piece["end_at"] - out[-1]["start_at"] <= config.max_chars:
            before = out.pop()
            piece = before | {"last": piece["last"], "end_at": piece["end_at"], "names": max(before["names"], piece["names"], key=len)}
        out.append(piece)
    return out


def test_folds_over_pieces(spark):
    import random

    rng = random.Random(5)
    config, rows = ChunkConfig(30, 10), []
    for i in range(60):
        spans, at, pieces = [], 0, []
        for k in range(rng.randrange(9)):
            first = rng.randrange(20)
            spans.append((first, first + rng.randrange(6)))
            size = rng.choice([1, 4, 9, 10, 12, 30, 40])
            pieces.append({"first": k, "last": k, "start_at": at, "end_at": at + size, "names": ["a", "b", "c"][: rng.randrange(4)]})
            at += size + rng.randrange(2)
        rows.append((i, spans, pieces, [rng.choice(["", " ", "x"]) for _ in range(26)]))
    table = spark.createDataFrame(rows, f"i int, spans array<struct<first:int,last:int>>, pieces array<{ch.PIECE}>, lines array<string>")
    found = table.select("i", ch.without_overlaps(F.col("spans")).alias("a"), ch.merged_small(F.col("pieces"), config).alias("b"), ch.trimmed(F.col("spans"), F.col("lines")).alias("c")).collect()
    for r in found:
        _, spans, pieces, lines = rows[r["i"]]
        assert [tuple(p) for p in r["a"]] == _plain_without_overlaps(spans)
        assert [p.asDict() for p in r["b"]] == _plain_merged(pieces, config)
        filled = [[k for k in range(a, b + 1) if lines[k].strip()] for a, b in spans]
        assert [tuple(p) for p in r["c"]] == [(f[0], f[-1]) for f in filled if f]
    none = spark.createDataFrame([(None, None)], f"spans array<struct<first:int,last:int>>, pieces array<{ch.PIECE}>")
    assert tuple(none.select(ch.without_overlaps(F.col("spans")), ch.merged_small(F.col("pieces"), config)).first()) == (None, None)
