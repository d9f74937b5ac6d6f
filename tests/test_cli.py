import json

from tessel.cli import main


def call(capsys, spark, root, *args):
    code = main(["--root", root, "--dims", "16", *args], spark)
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_commands(spark, tmp_path, capsys):
    vault, root = tmp_path / "v", f"file://{tmp_path}/s"
    vault.mkdir()
    (vault / "a.md").write_text("---\ntitle: A\n---\nneedle one\n")
    (vault / "b.md").write_text("needle two\n\nmore\n")
    code, out = call(capsys, spark, root, "scan", f"file://{vault}")
    assert code == 0 and {r["change"] for r in out["data"]} == {"new"}
    assert len(call(capsys, spark, root, "search", "needle", "--mode", "text")[1]["data"]) == 2
    assert call(capsys, spark, root, "search", "needle")[1]["meta"] == {"degradations": []}
    files = call(capsys, spark, root, "files")[1]
    assert files["meta"] == {"total": 2, "has_next": False}
    rid = files["data"][0]["resource_id"]
    assert call(capsys, spark, root, "export", rid)[1]["data"]["resource"]["resource_id"] == rid
    assert {r["n"] for r in call(capsys, spark, root, "check")[1]["data"]} == {0}
    assert call(capsys, spark, root, "delete", rid)[0] == 0 and call(capsys, spark, root, "files")[1]["meta"]["total"] == 1
    assert call(capsys, spark, root, "search", "x", "--scope", "nowhere")[1]["error"]["code"] == "unknown_scope"
    assert call(capsys, spark, root, "export", "unknown")[0] == 1


def test_options_fail_closed_and_doctor(spark, tmp_path, capsys):
    import json

    from tessel.cli import main

    def run(*args):
        code = main(["--root", f"file://{tmp_path}/store", "--dims", "8", *args], spark)
        return code, json.loads(capsys.readouterr().out)

    assert run("init")[0] == 0 and run("init")[0] == 1
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.md").write_text("# A\n\nred fox")
    assert run("scan", str(tmp_path / "v"))[0] == 0
    for bad in (["--offset", "1"], ["--weights", "1", "0", "--mode", "text"], ["--preset", "balanced", "--mode", "unified"], ["--meta", "nothing=1"], ["--scope", "nowhere"]):
        code, out = run("search", "red", *bad)
        assert code == 1 and not out["ok"], bad
    assert run("search", "red", "--mode", "text", "--tag", "none")[1]["data"] == []
    found = run("search", "red", "--mode", "text")[1]["data"]
    assert len(found) == 1 and run("chunk", found[0]["unit_id"])[1]["data"]["text"].endswith("red fox")
    assert run("chunk", "none")[0] == 1
    assert {r["code"]: r["n"] for r in run("doctor")[1]["data"]} == {"missing_fts": 0, "orphan_fts": 0, "missing_embedding": 0, "stale_embedding": 0, "orphan_embedding": 0}
