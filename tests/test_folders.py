"""Guarded listings, the feed of changes, and ingest through the dispatcher."""

from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tessellum.operators.places import places
from tessellum.operators.store import ChunkStore
from tessellum.sources import folders
from tessellum.streaming.watch import ingest, room_left, watch, watch_many
from tessellum.tools import Tools

LONG = "some words of a paragraph that is long enough to be kept as a chunk of its own, as it has a hundred characters"


def _write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_listing_is_guarded(spark, tmp_path):
    root = tmp_path / "src"
    _write(root, a_dot_md="a", sub__b_dot_md="b", sub__deep__c_dot_md="c", node_modules__x_dot_md="x", out__d_dot_md="d", sub__tmp__e_dot_md="e", sub__tmp__keep_dot_md="k", other_dot_txt="t", out__forced_dot_md="f")
    (root / ".gitignore").write_text("out/\n")
    (root / "sub" / ".gitignore").write_text("tmp/*\n!keep.md\n")
    os.symlink(root / "a.md", root / "link.md")
    os.symlink(root / "nowhere", root / "broken.md")
    os.symlink(root / "sub", root / "folder.md")
    os.symlink("/", root / "sub" / "loop")
    os.mkfifo(root / "pipe.md")
    (root / "big.md").write_bytes(b"z" * 5000)
    rules = folders.Rules.of([".md"], include=["out/forced.md"])
    got = {r.relative: r.reason for r in folders.listing(spark, f"file://{root}", rules).collect()}
    assert got == {"a.md": "", "sub/b.md": "", "sub/deep/c.md": "", "sub/tmp/keep.md": "", "out/forced.md": "", "big.md": "", "link.md": "link", "broken.md": "missing", "folder.md": "not_file", "pipe.md": "not_file"}
    assert {x[0] for x in folders.walk(str(root), folders.Rules.of([".md"], ignore={"": ["sub"]}, skip_globs=["**/d*", "big*"])) if not x[3]} == {"a.md", "out/forced.md"}
    names = spark.createDataFrame([(n,) for n in [*got, "gone.md"]], "relative string")
    read = {r.relative: r for r in folders.read_files(names, str(root), 100).collect()}
    assert read["big.md"].content == b"z" * 100 and read["a.md"].content == b"a" and read["a.md"].source_hash
    assert {n: r.reason for n, r in read.items() if r.reason} == {"link.md": "link", "broken.md": "link", "folder.md": "link", "pipe.md": "not_file", "gone.md": "missing"}
    assert all(r.content is None and r.source_hash is None for r in read.values() if r.reason)
    with pytest.raises(ValueError):
        folders.local("s3a://bucket/x")


def test_places():
    text = "\n\nalpha\nbeta\n\n\n\ngamma\nalpha\nbeta\n"
    assert places(text, ["alpha\nbeta", "gamma", "alpha\n\nbeta", "alpha"]) == [(2, 12, 3, 4), (16, 21, 8, 8), (22, 32, 9, 10), (-1, -1, 0, 0)]
    assert places("a\n\n\nb", ["nope", "a\nb", ""]) == [(-1, -1, 0, 0), (0, 5, 1, 4), (-1, -1, 0, 0)] and places("", []) == []


def test_watch_sees_edits_deletions_and_put_back_batches(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    _write(root, a_dot_md=f"# One\n\n{LONG}", b_dot_md=f"# Two\n\n{LONG}")
    store, seen, open_ = ChunkStore(spark, str(tmp_path / "s"), lambda _: F.array(F.lit(1.0))), [], [False]

    def run():
        watch(spark, str(root), store, "w", [".md", ".py"], str(tmp_path / "c"), gate=lambda: open_[0], on_batch=lambda n, c: seen.append(c), available_now=True).awaitTermination(60)
        return {r.source_file: r.text for r in store.read().collect()}

    assert run() == {} and run() == {} and seen == []  # refused, twice
    open_[0] = True
    assert set(run()) == {"a.md", "b.md"} and seen == [{"new": 2}]
    assert len(run()) == 2 and len(seen) == 1  # nothing changes, so nothing is done
    (root / "a.md").write_text(f"# One\n\nedited {LONG}")
    assert "edited" in run()["a.md"] and seen[1:] == [{"changed": 1}]
    (root / "b.md").unlink()
    assert set(run()) == {"a.md"} and seen[2:] == [{"deleted": 1}]
    # a refused batch comes again, with what has changed meanwhile, and reads these files alone
    open_[0] = False
    _write(root, c_dot_py="def f():\n    return 1\n" * 9)
    run()
    _write(root, d_dot_md=LONG)
    open_[0] = True
    read = []
    real = folders.read_files
    monkeypatch.setattr(folders, "read_files", lambda paths, *a: read.append({r.relative for r in paths.collect()}) or real(paths, *a))
    assert set(run()) == {"a.md", "c.py", "d.md"} and seen[3:] == [{"new": 2}] and set().union(*read) == {"c.py", "d.md"}
    # an ignore file counts from the next listing on
    (root / ".gitignore").write_text("c.py\n")
    assert set(run()) == {"a.md", "d.md"} and seen[4:] == [{"deleted": 1}]
    assert room_left(spark, str(tmp_path), 1)() and not room_left(spark, str(tmp_path), 1 << 60)()


def test_a_commit_on_a_known_branch(spark, tmp_path):
    root = tmp_path / "p"
    _write(root, a_dot_md=LONG)
    git = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)
    git("init", "-b", "main")
    git("add", "-A")
    git("commit", "-m", "one")
    store, said = ChunkStore(spark, str(tmp_path / "s"), lambda _: F.array(F.lit(1.0))), []

    def run():
        for q in watch_many(spark, {"p": str(root)}, store, [".md"], str(tmp_path / "c"), on_commit=True, log=said.append, available_now=True).values():
            q.awaitTermination(60)

    run()
    _write(root, b_dot_md=LONG, a_dot_md="new " + LONG)
    run()
    assert said == ["[p] batch 0: 1 new"]
    git("add", "-A")
    git("commit", "-m", "two")
    run()
    assert said[1:] == ["[p] batch 1: 1 new, 1 changed"] and store.count() == 2
    git("pack-refs", "--all")
    run()
    assert len(said) == 2 and set(folders.git_refs(str(root))) == {"refs/heads/main"}
    subprocess.run(["git", "-C", str(root), "worktree", "add", str(tmp_path / "w"), "-b", "side"], check=True, capture_output=True)
    assert set(folders.git_refs(str(tmp_path / "w"))) == {"refs/heads/main", "refs/heads/side"}


def test_ingest_by_language_and_reading_back(spark, tmp_path):
    root = tmp_path / "src"
    code = "import os\n\n\nclass Parser:\n    " + "x = 1\n    " * 200 + "\n\ndef run(a):\n    " + "a += 1\n    " * 200
    _write(root, lib__parser_dot_py=code, docs__guide_dot_md=f"# Guide\n\n{LONG}\n\n## Install\n\n{LONG}\n", lib__notes_dot_md=LONG, other__notes_dot_md=LONG)
    t = Tools(spark, str(tmp_path / "t"), lambda text: [float(len(text)), 1.0, float(text.count("a"))])
    assert t.mine(str(root), "w", [".py", ".md"]) == {"new": 4} and t.mine(str(root), "w", [".py", ".md"]) == {}
    rows = t.chunks.read().orderBy("source_file", "chunk_index").collect()
    by = {(r.source_file, r.symbol_name): r for r in rows}
    parser = by["lib/parser.py", "Parser"]
    assert parser.language == "python" and parser.symbol_type == "class" and parser.chunker_strategy == "code" and parser.line_start >= 1 and parser.line_end > parser.line_start
    guide = next(r for r in rows if r.source_file == "docs/guide.md")
    assert guide.language == "markdown" and guide.heading.startswith("Guide") and (guide.line_start, guide.line_end) == (1, 7)
    assert {r.symbol_name for r in t.code_search("class parser", language="python").collect()} >= {"Parser"}
    # chunks and queries lie in the space of one embedder
    assert all(len(r.vector) == 3 for r in t.chunks.read(vectors=True).collect())
    got = t.read("guide.md", 5, 7).collect()
    assert [(r.status, r.line, r.text) for r in got] == [("ok", 5, "## Install"), ("ok", 6, ""), ("ok", 7, LONG)]
    assert [r.status for r in t.read("lib/parser.py", 900, 901).collect()] == ["stale"]
    assert [(r.status, r.source_file) for r in t.read("none.py", 1, 2).collect()] == [("not_found", "none.py")]
    assert [(r.status, r.source_file) for r in t.read("notes.md", 1, 2).collect()] == [("ambiguous", "lib/notes.md"), ("ambiguous", "other/notes.md")]
    (root / "lib" / "parser.py").unlink()
    assert ingest(spark, str(root), t.chunks, "w", [".py", ".md"]) == {"deleted": 1} and "python" not in {r.language for r in t.chunks.read().collect()}
