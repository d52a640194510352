"""An index that a stream of changes keeps up to date: replaced, deleted and replayed documents."""

from __future__ import annotations

import shutil

from lexmill.plans.app import STREAM, Lexmill
from lexmill.streaming.landing import CHANGES, maintain_index


def _land(spark, folder, name, rows):
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}-{name}")
    for i, part in enumerate(sorted(p for p in __import__("pathlib").Path(f"{folder}-{name}").glob("*.parquet"))):
        shutil.copy(part, f"{folder}/{name}-{i}.parquet")


def _files(app):
    return {r["rel_path"]: r["text"] for r in app.store.read("chunks").collect()}


def test_changes_replace_delete_and_are_taken_once(spark, tmp_path):
    landing, app = tmp_path / "landing", Lexmill(spark, str(tmp_path / "data"))
    landing.mkdir()
    run = lambda where="cp": maintain_index(app, str(landing), "feed", str(tmp_path / where)).awaitTermination()
    _land(spark, landing, "a", [("one.md", "markdown", "# One\nalpha", False, 1), ("two.md", "markdown", "# Two\nbeta", False, 1), ("one.md", "markdown", "# One\nolder", False, 0), ("odd", None, None, None, None)])
    run()
    assert _files(app) == {"one.md": "# One\nalpha", "two.md": "# Two\nbeta"}
    first = app.store.current()
    assert first.meta[STREAM + "feed"] == "0" and app.search("alpha").first().rel_path == "one.md"
    # Replaced, deleted, added.
    _land(spark, landing, "b", [("one.md", "markdown", "# One\ngamma", False, 2), ("two.md", "markdown", None, True, 2), ("three.py", "python", "def delta():\n    pass\n", False, 1)])
    run()
    assert _files(app) == {"one.md": "# One\ngamma", "three.py": "def delta():\n    pass"}
    assert app.search("alpha").filter("text_rank is not null").count() == 0 and app.search("delta").first().symbol == "delta"
    state = app.store.current()
    assert (state.n, app.store.read("manifest").count(), app.status()["files"]) == (2, 2, 2)
    # Nothing new: nothing is committed.
    run()
    assert app.store.current().number == state.number
    # The checkpoint forgot the last batch (the run died between the index's commit and the stream's): it is not taken twice.
    for commit in (tmp_path / "cp/commits").glob("*1*"):
        commit.unlink()
    run()
    assert app.store.current().number == state.number and _files(app).keys() == {"one.md", "three.py"}


def test_a_stream_and_a_folder_share_an_index(spark, tmp_path):
    landing, base, app = tmp_path / "landing", tmp_path / "repo", Lexmill(spark, str(tmp_path / "data"))
    landing.mkdir(), base.mkdir()
    (base / "a.py").write_text("def from_folder():\n    pass\n")
    app.add_root(str(base))
    app.index()
    _land(spark, landing, "a", [("a.py", "python", "def from_stream():\n    pass\n", False, 1)])
    maintain_index(app, str(landing), "feed", str(tmp_path / "cp")).awaitTermination()
    (base / "b.py").write_text("def second():\n    pass\n")
    app.index()  # leaves the stream's documents alone
    found = {q: app.search(q).filter("text_rank = 1").first().root_id for q in ("from_folder", "from_stream", "second")}
    assert found["from_stream"] == "feed" and found["from_folder"] == found["second"] == app.settings.roots[0]["id"]
    assert app.search("from_stream", root_ids=["feed"]).count() == 1
