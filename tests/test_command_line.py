"""The stages from files to files, and questions read from lines."""

import io
import json

import pytest

from quillspark.__main__ import asked, main


def test_stages_and_search(spark, tmp_path, capsys, monkeypatch):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "raw").mkdir()
    lines = [{"id": "7", "title": " Red\nfoxes ", "abstract": "A den  of foxes"}, {"id": "8", "title": "Blue birds", "abstract": "nests"}, {"id": "9", "title": None, "abstract": "fox hunting"}]
    (tmp_path / "raw/a.json").write_text("\n".join([*map(json.dumps, lines), "{broken", ""]))
    main(["sanitize", at("raw"), at("clean")])
    main(["tokenize", at("clean"), at("tokens")])
    assert {tuple(r.title_tokens) for r in spark.read.json(at("tokens")).collect()} == {("red", "foxe"), ("blue", "bird"), ()}
    main(["index", at("clean"), at("index")])
    main(["index", at("clean"), at("index")])  # once more: the ids are overwritten
    main(["search", at("index"), "--titles", at("clean"), "red fox"])
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("1. [Score: ") and out[0].endswith("Red foxes (ID: 7)") and len(out) == 2
    monkeypatch.setattr("sys.stdin", io.StringIO("nothing of it\n\n  \nBIRDS\n:Q\nfoxes\n"))
    main(["search", at("index"), "-k", "1"])
    none, bird = capsys.readouterr().out.splitlines()
    assert none == "No results found." and bird.endswith("] Title not found. (ID: 8)")
    (tmp_path / "gone.txt").write_text("7\nunknown\n")
    main(["delete", at("gone.txt"), at("index")])
    main(["compact", at("index")])
    main(["search", at("index"), "red"])
    assert capsys.readouterr().out == "No results found.\n"


def test_fused_search(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    (tmp_path / "clean").mkdir()
    rows = [{"id": str(i), "clean_title": t, "clean_abstract": ""} for i, t in enumerate(["red fox den", "red fox hole", "blue bird nest", "green frog pond"])]
    (tmp_path / "clean/a.json").write_text("\n".join(map(json.dumps, rows)))
    main(["index", at("clean"), at("index")])
    main(["vectors", at("clean"), at("vectors")])
    main(["cells", at("vectors"), at("cells")])
    for option in (["--vectors", at("vectors")], ["--cells", at("cells")]):
        main(["search", at("index"), *option, "-k", "2", "fox hole"])
        assert "(ID: 1)" in capsys.readouterr().out.splitlines()[0]


def test_what_is_asked():
    assert list(asked(["a\n", " \n", "b", ":Q", "c"])) == ["a", "b"] and list(asked([])) == []
    with pytest.raises(SystemExit):
        main(["sanitize", "one"])
