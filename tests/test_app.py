"""Folder to search hits: scanning, incremental runs, scope, command line."""

from __future__ import annotations

import os
import time

import pytest

from lexmill.operators.search import bm25, bm25_from_index, id_in, origin_is
from lexmill.plans.app import Cancelled, Lexmill, main
from lexmill.sources import folder, ignore
from lexmill.sources.store import IndexStore

FILES = {
    ".gitignore": "generated/\nnotes_private.md\n",
    "lib/auth.dart": "class AuthRepository {\n  bool validateEmail(String email) {\n    return email.contains('@');\n  }\n}\n",
    "server/users.ts": "export interface User { id: string }\n\nexport async function getUserById(id: string) {\n  return db.find(id);\n}\n",
    "scripts/sync.py": "class InventorySync:\n    @retry\n    def fetch_items(self):\n        return []\n",
    "game/inventory.lua": "function Inventory:addItem(item)\n  table.insert(self.items, item)\nend\n",
    "docs/architecture.md": "# Arquitectura\nintro\n\n## Autenticación\nEl login valida.\n",
    "config/app.yaml": "server:\n  database:\n    url: x\n",
    ".env": "SECRET=1\n",
    "keys/server.pem": "secret\n",
    "generated/api.ts": "export const a = 1\n",
    "notes_private.md": "# private\n",
    "node_modules/left/index.js": "module.exports = 1\n",
    "assets/logo.png": "png",
}
WANTED = {"lib/auth.dart", "server/users.ts", "scripts/sync.py", "game/inventory.lua", "docs/architecture.md", "config/app.yaml"}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "repo"
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    os.symlink(base / "lib", base / "linked")
    return base


def _wanted(spark, root, **options):
    listing = folder.scan(spark, str(root), "r1", **options)
    return {r.rel_path for r in listing.collect() if r.skip_reason is None}


def test_scan_takes_what_it_should(spark, root):
    assert _wanted(spark, root) == WANTED
    reasons = {r.rel_path: r.skip_reason for r in folder.scan(spark, str(root), "r1").collect()}
    assert reasons["linked"] == "link" and reasons[".env"] == "ignored" and reasons["assets/logo.png"] == "unsupported" and "node_modules/left/index.js" not in reasons


def test_rules_of_a_folder(spark, root):
    (root / ".gitignore").write_text("!.env\n!*.pem\n")
    assert not {".env", "keys/server.pem"} & _wanted(spark, root)
    (root / "game/.gitignore").write_text("*.lua\n")
    assert "game/inventory.lua" not in _wanted(spark, root)
    (root / "game/.gitignore").write_text("*.lua*\n!inventory.lua\n")
    assert "game/inventory.lua" in _wanted(spark, root)
    assert _wanted(spark, root, extra_excludes=["docs/", "*.yaml"]).isdisjoint({"docs/architecture.md", "config/app.yaml"})
    assert "server/users.ts" not in _wanted(spark, root, max_file_bytes=60)


@pytest.mark.parametrize("budget", [1, 3, 5000])
def test_folders_that_are_ruled_out_are_never_entered(spark, root, budget):
    (root / "generated/deep/deeper").mkdir(parents=True)
    (root / "generated/deep/.gitignore").write_text("!api.ts\n")
    (root / "game/.gitignore").write_text("mods/\n!../generated/\n*.tmp\n")
    for name in ("game/mods/a/x.lua", "game/kept/mods/y.lua", "game/kept/z.lua", "game/kept/t.tmp", "docs/mods/m.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    rows = folder.walked(spark, folder.Walk(str(root), "r1"), budget).collect()
    entered = sorted(r["rel_path"] for r in rows if r["kind"] == "dir")
    assert entered == sorted(["", "assets", "config", "docs", "docs/mods", "game", "game/kept", "keys", "lib", "scripts", "server"])
    ignored = {r["rel_path"]: r["ignored"] for r in rows if r["kind"] != "dir"}
    assert ignored["game/kept/t.tmp"] and ignored[".env"] and not ignored["game/kept/z.lua"] and not ignored["docs/mods/m.md"]
    # The same verdicts as by the join of paths with rules.
    paths = spark.createDataFrame([(p,) for p in ignored], "path string")
    rules = [("", i, x) for i, x in enumerate((root / ".gitignore").read_text().splitlines())] + [("game", i, x) for i, x in enumerate((root / "game/.gitignore").read_text().splitlines())]
    joined = ignore.layered(paths, spark.createDataFrame(rules, "base string, seq int, pattern string"))
    hard = joined.withColumn("ignored", joined["ignored"] | ignore.ignored(joined["path"], ignore.HARD_EXCLUDES))
    assert {r["path"]: r["ignored"] for r in hard.collect()} == ignored
    spark.dataSource.register(folder.FolderSource)
    plain = spark.read.format("folder").option("path", str(root)).option("root_id", "r1").load()
    assert {r["rel_path"] for r in plain.collect()} == set(ignored)


def test_incremental_runs_and_search(spark, root, tmp_path, capsys):
    app = Lexmill(spark, str(tmp_path / "data"))
    assert app.search("anything").count() == 0
    own = app.add_root(str(root))
    with pytest.raises(Exception, match="overlaps"):
        app.add_root(str(root / "lib"))
    first = app.index()
    assert first["indexed"] == len(WANTED) and first["full_rebuild"]
    again = app.index()
    assert again["indexed"] == 0 and again["unchanged"] == len(WANTED) and not again["full_rebuild"]
    hit = app.search("getUserById").first()
    assert hit.rel_path == "server/users.ts" and hit.text_rank == 1
    assert app.search("validate email").first().rel_path == "lib/auth.dart"
    assert app.search("  ").count() == 0 and app.search("user", origin="doc").count() == 0 and app.search("user", root_ids=["unknown"]).count() == 0

    (root / "server/users.ts").write_text("export function renamed() {}\n")
    (root / "config/app.yaml").unlink()
    os.utime(root / "lib/auth.dart", ns=(1, 1))
    (root / "bad.py").write_bytes(b"a\0b")
    third = app.index()
    assert (third["indexed"], third["removed"], third["unreadable"], third["unchanged"]) == (1, 1, 1, len(WANTED) - 2)
    fourth = app.index()
    assert (fourth["indexed"], fourth["unreadable"], fourth["unchanged"]) == (0, 0, len(WANTED))
    assert app.status()["files"] == len(WANTED) - 1
    assert main(["--data-dir", str(tmp_path / "data"), "search", "addItem", "--json"], spark) == 0
    assert "inventory.lua" in capsys.readouterr().out
    app.remove_root(own["id"])
    assert app.search("addItem").count() == 0
    assert main(["--data-dir", str(tmp_path / "data"), "roots", "remove", "nothing"], spark) == 2


def test_a_change_costs_a_small_segment_and_a_cancelled_run_deletes_nothing(spark, root, tmp_path):
    app = Lexmill(spark, str(tmp_path / "data"))
    app.add_root(str(root))
    steps = []
    app.index(progress=lambda step, n: steps.append((step, n)))
    assert [s for s, _ in steps] == ["listed", "read", "chunked", "committed"] and steps[0][1] == len(WANTED)
    before = app.store.current()
    (root / "server/users.ts").write_text("export function somethingElse() {}\n")
    (root / "config/app.yaml").unlink()
    assert app.index(cancelled=lambda: True)["indexed"] == 0 and app.store.current() == before
    told = []
    cut = app.index(progress=lambda step, n: told.append(step), cancelled=lambda: "chunked" in told)
    assert (cut["indexed"], cut["removed"]) == (1, 0) and app.status()["files"] == len(WANTED)
    after = app.store.current()
    assert after.segments[0] == before.segments[0] and after.segments[1]["rows"] == 1 and after.number == before.number + 1
    assert app.search("somethingElse").first().rel_path == "server/users.ts" and app.search("getUserById").filter("text_rank IS NOT NULL").count() == 0
    assert app.index()["removed"] == 1 and app.store.get_meta("indexed_at") and app.store.get_meta("nothing") is None
    assert not [n for n in os.listdir(tmp_path / "data/index") if n.startswith("_work")]


def test_a_cancelled_read_stops_within_its_tasks_and_full_rounds_stay(spark, tmp_path, monkeypatch):
    base, app = tmp_path / "repo", Lexmill(spark, str(tmp_path / "data"))
    _many(base, 20)
    app.add_root(str(base))
    monkeypatch.setattr("lexmill.plans.app.ROUND_FILES", 5)
    told = []
    cut = app.index(progress=lambda step, n: told.append(step), cancelled=lambda: told.count("committed") == 2)
    n = app.store.read("manifest").count()
    assert 0 < cut["indexed"] == n < 20 and told.count("committed") == 2
    rest = app.index()
    assert (rest["indexed"], rest["unchanged"]) == (20 - n, n) and app.status()["files"] == 20
    assert app.search("only_13").first().rel_path == "pkg6/m13.py"

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(120)
            yield batch

    began, asked = time.monotonic(), time.monotonic() + 3
    with pytest.raises(Cancelled), app._stopping(lambda: time.monotonic() > asked):
        spark.range(4).repartition(2).mapInPandas(slow, "id long").count()
    assert time.monotonic() - began < 60
    assert spark.range(3).count() == 3  # later jobs bear no tag


def _many(base, n, marker="v1"):
    for i in range(n):
        path = base / f"pkg{i % 7}/m{i}.py"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"def only_{i}():\n    return 'common {marker}'\n")


def test_a_run_writes_in_proportion_to_what_changed(spark, tmp_path):
    grown = []
    for n in (40, 400):
        base, app = tmp_path / f"repo{n}", Lexmill(spark, str(tmp_path / f"data{n}"))
        _many(base, n)
        app.add_root(str(base))
        app.index()
        first = app.store.current().segments[0]["bytes"]
        (base / "pkg1/m1.py").write_text("def changed():\n    pass\n")
        app.index()
        grown.append((first, app.store.current().segments[1]["bytes"]))
    assert grown[1][0] > 3 * grown[0][0] and abs(grown[1][1] - grown[0][1]) < 200  # the index is larger, the change is not


def test_segments_are_merged_and_totals_stay_exact(spark, tmp_path):
    base, app = tmp_path / "repo", Lexmill(spark, str(tmp_path / "data"))
    _many(base, 12)
    app.add_root(str(base))
    app.index()
    for step in range(5):
        (base / f"pkg{step}/m{step}.py").write_text(f"def changed_{step}():\n    return 'again common'\n")
        (base / f"pkg{step}/m{step + 7}.py").unlink(missing_ok=True)
        app.index()
        state = app.store.current()
        posted = app.store.read("postings").groupBy("id").agg({"dl": "max"}).toPandas()["max(dl)"]
        assert (state.n, state.terms) == (len(posted), posted.sum())
        assert len(state.segments) <= 3
        assert app.store.read("manifest").count() == 12 - step - 1 == app.status()["files"]
        assert app.search(f"changed_{step}").first().text_rank == 1
    assert app.store.read("chunks").select("id").distinct().count() == app.store.read("chunks").count() == 7


def test_a_search_that_is_open_survives_commits(spark, root, tmp_path):
    app = Lexmill(spark, str(tmp_path / "data"))
    app.add_root(str(root))
    app.index()
    held = app.search("getUserById")
    (root / "server/users.ts").write_text("export function somethingElse() {}\n")
    app.index()
    app.index(full=True)
    assert held.first().rel_path == "server/users.ts" and "getUserById" in held.first().text
    held = app.search("somethingElse")
    app.store.truncate()
    assert app.search("somethingElse").count() == 0 and app.status()["files"] == 0 and held.first().rel_path == "server/users.ts"
    assert app.index()["indexed"] == len(WANTED)
    assert app.store.expire() == 0  # what it reads was superseded just now
    assert app.store.expire(seconds=-1) > 0 and app.search("somethingElse").first().rel_path == "server/users.ts"


def test_of_two_writers_neither_is_lost(spark, tmp_path):
    roots = [tmp_path / "one", tmp_path / "two"]
    for i, base in enumerate(roots):
        _many(base, 3, f"root{i}")
    apps = [Lexmill(spark, str(tmp_path / "data")) for _ in roots]
    ids = [apps[0].add_root(str(base))["id"] for base in roots]
    apps[0].index()
    apps[1] = Lexmill(spark, str(tmp_path / "data"))
    (roots[0] / "pkg0/m0.py").write_text("def from_first():\n    pass\n")
    (roots[1] / "pkg0/m0.py").write_text("def from_second():\n    pass\n")
    (roots[0] / "new.py").write_text("def both_have_it():\n    pass\n")

    def other_writer(step, n):  # commits while the first one is between reading and committing
        if step == "read":
            apps[1].index(ids)

    apps[0].index([ids[0]], progress=other_writer)
    found = {q: [h.rel_path for h in apps[0].search(q).filter("text_rank = 1").collect()] for q in ("from_first", "from_second", "both_have_it")}
    assert found == {"from_first": ["pkg0/m0.py"], "from_second": ["pkg0/m0.py"], "both_have_it": ["new.py"]}
    assert apps[0].status()["files"] == 7 and apps[0].store.read("chunks").count() == 7
    state = apps[0].store.current()
    assert state.n == 7

    def rebuilder(step, n):
        if step == "read" and not rebuilt:
            rebuilt.append(apps[1].index(full=True))

    rebuilt: list = []
    (roots[0] / "new.py").write_text("def last_change():\n    pass\n")
    assert apps[0].index(full=True, progress=rebuilder)["indexed"] == 7 and rebuilt  # run again after the conflict
    assert apps[0].search("last_change").first().rel_path == "new.py" and apps[0].store.read("manifest").count() == 7


def test_stored_index_ranks_as_the_texts_do(spark, root, tmp_path):
    app = Lexmill(spark, str(tmp_path / "data"))
    app.add_root(str(root))
    app.index()
    chunks = app.store.read("chunks")
    for query in ("validate email", "AUTENTICACION login", "the of"):
        plain = [tuple(r) for r in bm25(chunks, query, 9, "id", "search_text").collect()]
        assert plain == [tuple(r) for r in bm25_from_index(app.store.read("postings"), app.store.corpus_stats(), query, 9, "id").collect()]
    assert app.search("AUTENTICACION").first().rel_path == "docs/architecture.md"


def test_a_crash_while_committing_leaves_the_old_index(spark, root, tmp_path, monkeypatch):
    app = Lexmill(spark, str(tmp_path / "data"))
    app.add_root(str(root))
    app.index()
    monkeypatch.setattr(IndexStore, "_create", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        app.index(full=True)
    monkeypatch.undo()
    assert app.search("getUserById").first().rel_path == "server/users.ts"


def test_opened_files_stay_in_their_root(root, tmp_path):
    outside = tmp_path / "outside"
    outside.mkdir()
    (outside / "auth.dart").write_text("secret")
    os.rename(root / "lib", root / "lib_before")
    os.symlink(outside, root / "lib")
    with pytest.raises(OSError, match="not in"):
        folder.read_bounded(str(root / "lib/auth.dart"), 1000, str(root))
    assert folder.read_bounded(str(root / "server/users.ts"), 1000, str(root))
    for path in ("/dev/null", "/proc/self/mem", "\\\\.\\pipe"):
        with pytest.raises(ValueError):
            folder.checked_path(path)


def test_guards():
    with pytest.raises(ValueError):
        id_in("file_id", ["ab'; DROP"])
    with pytest.raises(ValueError):
        origin_is("web")
    with pytest.raises(ValueError):
        folder.checked_path("relative/path")


@pytest.mark.parametrize(("data", "text"), [(b"plain", "plain"), (b"\xef\xbb\xbfbom", "bom"), (b"caf\xe9", "café"), (b"a\0b", None), (b"\x81", None)])
def test_decode(data, text):
    assert folder.decode_text(data) == text
