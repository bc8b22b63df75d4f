import json
import subprocess

import pytest

from lodestrata.operators import findings, tools
from lodestrata.plans import run, settings


def test_tool_rows(spark, tmp_path):
    rows = [tools.run_tool("test", c, str(tmp_path), 2) for c in ("echo warning: unused", "no-such-tool-here x", "sleep 9", "false")]
    assert [r[2:4] for r in rows] == [(0, False), (127, True), (124, False), (1, False)]
    d = spark.createDataFrame(rows, tools.RESULT)
    assert [(r.source, r.severity) for r in findings.scan_issues(d).collect()] == [("echo warning: unused", "warning")]
    assert tools.run_checks(spark, str(tmp_path), ["Nothing"]).count() == 0


def test_git_and_environment(spark, tmp_path):
    assert tools.git_snapshot(str(tmp_path)) == {}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("x")
    git("add", "a")
    git("commit", "-qm", "first")
    (tmp_path / "a").write_text("y")
    (tmp_path / "b").write_text("z")
    got = tools.git_snapshot(str(tmp_path))
    assert got["dirty"] and got["untracked"] == 1 and got["subject"] == "first" and got["behind"] == 0
    row = tools.environment(spark, str(tmp_path)).first().asDict()
    assert row["cpus"] > 0 and "GiB free" in tools.environment_text(row)["disk"] and "cores" in tools.environment_text(row)["cpu"]


def test_analyzers_and_doctor(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"scripts": {"test": "jest"}}')
    own = tools.matching(["Node.js", "Android/Kotlin", "Lua"], str(tmp_path))
    assert set(own) == {"Node.js", "Lua"} and own["Node.js"]["test"] == ["npm test"] and own["Node.js"]["quality"] == [] and own["Node.js"]["security"]
    assert tools.package_scripts(str(tmp_path / "none.json")) == {} and set(tools.analyzers()) >= set(tools.COMMANDS)
    checks = tools.doctor(spark, str(tmp_path), ["Lua"])
    rows = {r.tool: r for r in checks.collect()}
    assert rows["java"].is_required and not rows["java"].is_missing and rows[str(tmp_path)].path and "busted" in rows
    assert tools.missing_tools(checks) == sum(r.is_missing for r in rows.values())


def test_settings(tmp_path, monkeypatch):
    path = str(tmp_path / "conf/settings.json")
    assert settings.load(path) == {}
    settings.save(path, kind="json", tree_depth=3)
    settings.save(path, tree_depth=4, unknown=1)
    stored = settings.load(path)
    assert stored == {"kind": "json", "tree_depth": 4, "unknown": 1}
    monkeypatch.setenv("LODESTRATA_TREE_ENTRIES", "7")
    got = settings.resolve(stored, full=True, quality=False, output_dir="~/x")
    assert (got.kind, got.tree_depth, got.tree_entries, got.quality, got.security, got.max_file_size) == ("json", 4, 7, False, True, 10 << 30) and got.output_dir.endswith("/x")
    with pytest.raises(ValueError, match="kind must be one of.*output_name"):
        settings.resolve(kind="xml", output_name="a/b")
    (tmp_path / "conf/settings.json").write_text("{broken")
    assert settings.load(path) == {} and settings.problems(settings.Settings(tree_depth=0)) == ["tree_depth must be above 0"]


def test_whole_report(spark, tmp_path):
    root = tmp_path / "My Project"
    root.mkdir()
    (root / "init.lua").write_text("-- TODO one\nprint(1)\n")
    for kind in ("json", "md"):
        own = settings.resolve(output_dir=str(tmp_path / "out"), kind=kind, use_cache=True, quality=True)
        path = run.make(spark, str(root), own)
        assert path.endswith(f"my-project-report.{kind}") and (tmp_path / f"out/my-project-report.{kind}.sha256").exists()
    data = json.loads((tmp_path / "out/my-project-report.json").read_text())
    assert data["detection"]["primary_language"] == "Lua" and len(data["todos"]) == 1 and {r["source"] for r in data["results"]} == {"busted", "luacheck ."}
    text = (tmp_path / "out/my-project-report.md").read_text()
    assert "Project: My Project" in text and "SKIP" in text and "| disk |" in text
