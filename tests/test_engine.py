"""The engine over a tree on disk, its settings, snapshots and checkpoints."""

import json
import subprocess

import pytest

from cairn.config import Config
from cairn.engine import Engine
from cairn.sources import live, snapshots
from cairn.streaming.maintenance import NOTICES_A_PASS, PASSES, Maintenance


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/parser.ts": 'import { a } from "./util";\nexport function parseHeader() {}\n', "src/util.ts": "export const a = 1;\n", "notes.md": "about parseHeader\n", "bad.ts": "class {", "node_modules/x.js": "parseHeader"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return root


def test_engine_builds_searches_and_follows_changes(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path / "state"), use_git=False)
    assert [r.path for r in engine.search("parseHeader").collect()] == ["notes.md", "src/parser.ts"] and engine.lifecycle == "dormant"
    engine.start()
    got = engine.search("parseHeader").collect()
    assert [r.path for r in got] == ["src/parser.ts", "notes.md"] and got[0].matchedSymbols == ["parseHeader"]
    status = engine.status().first()
    assert (status.lifecycle, status.freshness, status.generation, status.files) == ("ready", "unsupported", 1, 4)
    assert all(r.ok for r in engine.doctor().collect())
    assert engine.graph().edges.where("relation = 'IMPORTS_FILE'").first().status == "heuristic"
    (tree / "src/util.ts").write_text("export function parseFooter() {}\n")
    (tree / "notes.md").unlink()
    engine.apply(spark.createDataFrame([("src/util.ts", "add", 1), ("src/util.ts", "change", 2), ("notes.md", "change", 1), ("notes.md", "unlink", 3)], "path string, event string, seq long"))
    assert [r.path for r in engine.search("parseFooter").collect()][0] == "src/util.ts"
    assert [r.path for r in engine.search("parseHeader").collect()][0] == "src/parser.ts" and engine.index.files.count() == 3
    row = engine.status().first()
    assert (row.freshness, row.dirty) == ("dirty", ["notes.md", "src/util.ts"])
    assert engine.rebuild() == 2
    assert json.loads(engine.payload("parseFooter"))["results"][0]["path"] == "src/util.ts"
    with pytest.raises(ValueError):
        engine.search("x" * 600)
    engine.close()


def test_engine_reuses_a_clean_generation(spark, tree, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (tree / "bad.ts").unlink()
    (tree / ".gitignore").write_text("*.md\n")
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    first = Engine(spark, str(tree), str(tmp_path / "state")).start()
    assert (first.freshness, first.index.files.count()) == ("fresh", 3)
    again = Engine(spark, str(tree), str(tmp_path / "state")).start()
    assert again.telemetry["hydratedFastReuseCount"] == 1 and again.generation == first.generation
    assert again.search("parseHeader").first().path == "src/parser.ts"
    (tree / "src/util.ts").write_text("export const b = 2;\n")
    third = Engine(spark, str(tree), str(tmp_path / "state")).start()
    assert third.telemetry["hydratedFastReuseCount"] == 0 and third.freshness == "dirty" and third.status().first().dirty == ["src/util.ts"]
    assert Engine(spark, str(tree), str(tmp_path / "s2"), Config(enabled=False)).start().lifecycle == "disabled"


def test_the_version_moves_with_the_content(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path / "state"), use_git=False).start()
    index = engine.index
    engine.rebuild()
    assert engine.content_version == 1 and engine.index is index
    (tree / "notes.md").write_text("other\n")
    engine.rebuild()
    assert engine.content_version == 2 and engine.index is not index
    assert engine.excerpt("notes.md") == "other\n" and engine.excerpt("../x") is None and engine.excerpt("none.md") is None


def test_notices_wait_for_quiet_and_drain_in_passes():
    now, done = [0.0], []
    m = Maintenance(done.append, lambda p: not p.startswith("skip"), 300, lambda: now[0])
    assert [m.notify("change", p) for p in ("a.ts", "./b.ts", "skip/x", "/abs", "C:/x", "../up", "x/../y")] == [True, True] + [False] * 5 and not m.notify("moved", "a.ts")
    assert m.pending == ["a.ts", "b.ts"] and m.epoch == 2 and not m.tick()
    now[0] = 0.2
    m.notify("unlink", "a.ts")
    now[0] = 0.4
    assert not m.tick(), "each notice starts the quiet period anew"
    now[0] = 0.6
    with m.lease() as epoch:
        assert epoch == m.epoch and not m.tick()
    assert m.tick() and done == [[("a.ts", "change", 1), ("b.ts", "change", 2), ("a.ts", "unlink", 3)]] and m.pending == []
    for k in range(NOTICES_A_PASS * PASSES + 5):
        m.notify("add", f"f{k:04}")
    assert m.drain() == PASSES and len(m.pending) == 5 and m.due is not None and all(len(x) <= NOTICES_A_PASS for x in done)
    m.work = lambda some: now.__setitem__(0, now[0] + 2) or 1 / 0
    for k in range(NOTICES_A_PASS):
        m.notify("add", f"g{k}")
    assert m.drain() == 1 and len(m.pending) == 5 and m.failures == ["ZeroDivisionError: division by zero"]


def test_engine_follows_notices(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path / "state"), Config(excludePatterns=["*.log"]), use_git=False).start()
    (tree / "src/util.ts").write_text("export function parseFooter() {}\n")
    engine.notify("change", "x.log")
    assert engine.freshness != "stale"
    engine.notify("change", "src/util.ts")
    row = engine.status().first()
    assert (row.freshness, row.pending) == ("stale", ["src/util.ts"])
    engine.flush()
    assert engine.freshness == "dirty" and engine.maintenance.pending == [] and engine.search("parseFooter").first().path == "src/util.ts"


def test_live_reads_and_fingerprints(tree, tmp_path):
    root = str(tree)
    (tree / "bin").write_bytes(b"a\0b")
    (tree / "wide.txt").write_text("é" * 5000)
    (tmp_path / "secret").write_text("s")
    (tree / "link").symlink_to(tmp_path / "secret")
    (tree / "out").symlink_to(tmp_path)
    assert live.excerpt(root, "wide.txt", 5) == "éé"
    for bad in ("bin", "link", "out/secret", "../secret", "/etc/passwd", "a//b", "src", ""):
        with pytest.raises((live.Refused, OSError)):
            live.excerpt(root, bad)
    one = live.fingerprint(root, "notes.md")
    assert one.reusable and one.value.startswith("file:") and live.fingerprint(root, "nope") == live.Fingerprint("missing", True)
    ran = []
    work = lambda p: ran.append(p) or ("read-error" if p == "bad.ts" else "indexed")
    kept = live.Outcomes(root)
    assert [kept.get(p, work) for p in ("notes.md", "notes.md", "bad.ts", "bad.ts")] == ["indexed"] * 2 + ["read-error"] * 2
    assert ran == ["notes.md", "bad.ts", "bad.ts"]
    (tree / "notes.md").write_text("changed\n")
    kept.get("notes.md", work)
    assert len(ran) == 4 and live.fingerprint(root, "notes.md") != one
    kept.retain(["x"])
    assert kept.kept == {}


def test_diff_is_bounded_and_empty_on_failure(tree, tmp_path):
    assert live.git_diff(str(tmp_path / "nowhere")) == ""
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    assert live.git_diff(str(tree)) == ""
    (tree / "notes.md").write_text("é" * 50_000)
    diff = live.git_diff(str(tree))
    assert diff.startswith("diff --git") and len(diff.encode()) <= live.DIFF_BYTES < len(diff.encode()) + 4


def test_config():
    assert Config.parse(None) == Config.parse("{}") == Config()
    assert Config.parse('{"debounceMs": 5, "excludePatterns": ["a/**"]}').excludePatterns == ["a/**"]
    assert Config().build_key() != Config(excludePatterns=["a"]).build_key() == Config(excludePatterns=["a", "a"]).build_key()
    for bad in ('{"x": 1}', "[]", '{"enabled": 1}', '{"debounceMs": 0}', '{"quotaBytes": true}', '{"searchMaxBytes": 511}', '{"excludePatterns": [" "]}', '{"generationRetention": 1.5}'):
        with pytest.raises(ValueError):
            Config.parse(bad)


def rows(spark, *paths, h="a" * 64):
    from tests.test_operators import file, table

    return table(spark, [file(p, contentHash=h) for p in paths])


def test_snapshots(spark, tmp_path):
    where = str(tmp_path / "snap")
    snapshots.write(rows(spark, "b.ts", "a.ts"), where)
    assert sorted(r.path for r in snapshots.read(spark, where).collect()) == ["a.ts", "b.ts"]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.json").write_text('{"path": "a", "schemaVersion": 2}\n')
    with pytest.raises(ValueError, match="version"):
        snapshots.read(spark, str(tmp_path / "old"))


def test_checkpoints(spark):
    dirty = lambda *r: spark.createDataFrame(list(r), "path string, hash string")
    one = snapshots.checkpoint(rows(spark, "./a//b.ts", "c.ts"), 1)
    two = snapshots.checkpoint(rows(spark, "c.ts", "a/b.ts"), 2, dirty=dirty(("c.ts", "deleted")), head="h", freshness="dirty", pending=["z", "y", "z"])
    assert one.identity == two.identity and two.pending == ["y", "z"] and two.revision
    assert snapshots.checkpoint(rows(spark, "c.ts"), 1).identity != one.identity
    for bad in (dict(files=rows(spark, "a.ts", "./a.ts")), dict(files=rows(spark, "../a")), dict(files=rows(spark, "a", h="x")), dict(files=rows(spark, "a"), freshness="new"), dict(files=rows(spark, "a"), dirty=dirty(("a", "deleted"), ("a", "b" * 64)))):
        with pytest.raises(snapshots.CheckpointError):
            snapshots.checkpoint(generation=1, **bad)
    provider = snapshots.Provider()
    with pytest.raises(snapshots.CheckpointError):
        provider.current()
    provider.publish(files=rows(spark, "a"), generation=1)
    assert provider.publish(files=rows(spark, "../a"), generation=2).freshness == "stale" and provider.current().generation == 1
