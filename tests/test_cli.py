from cstloom import cli


def test_from_sources_to_hits(spark, tmp_path, capsys):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("import os\n\nclass Reader:\n    def read_lines(self, path):\n        return os.open(path)\n")
    (source / "b.py").write_text("def broken(:\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["parse", str(source), "--output", at("parsed"), "--max-bytes", "100000"])
    cli.main(["chunk", at("parsed"), at("chunks")])
    cli.main(["load", at("chunks"), "--db-path", at("db")])
    cli.main(["search", "--query", "read_lines path", "--k", "2", "--db-path", at("db")])
    cli.main(["search", "--query", "Reader", "--brief", "--language", "python", "--db-path", at("db")])
    cli.main(["stats", "--db-path", at("db")])
    cli.main(["graph", str(source), at("graph")])
    shown = capsys.readouterr().out
    assert "read_lines" in shown and "class_definition" in shown and "test query: 1 result(s)" in shown
    assert (tmp_path / "graph" / "graph.graphml").read_text().count("<edge") == 2
