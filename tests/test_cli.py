"""Commands end to end, and the driver's contract."""

import importlib
import sys

from treeledger.cli import run
from treeledger.store import Store


def test_commands(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "f").write_text("one")
    repo = ["--repo", str(tmp_path / "r")]
    do = lambda *args: (run(spark, [*repo, *args]), capsys.readouterr().out.strip())
    do("init")
    code, first = do("commit", str(src), "main", "--message", "m", "--metadata", "k=v")
    assert code == 0 and len(first) == 64
    (src / "g").write_text("two")
    _, second = do("commit", str(src), "next")
    assert do("diff", "main", "next")[1] == "+ g"
    assert do("cat-file", "next:g")[1] == "two"
    assert do("rev-parse", "main", "--short")[1] == first[:12]
    assert do("show", "main", "--key", "k")[1] == "v"
    assert do("ls-tree", "next")[1].splitlines()[0].startswith("100644 regular ")
    assert do("refs")[1].splitlines() == [f"{first} main", f"{second} next"]
    assert "0.0 MB  next" in do("du")[1]
    assert do("union", "both", "--refs", "main,next", "--on-conflict", "last")[0] == 0
    assert do("fsck")[0] == 0
    assert "commits 3" in do("stats")[1]
    assert do("delete-refs", "n*")[1] == "next"
    assert "commit 0 0" in do("gc", "--dry-run")[1]
    do("checkout", "both", str(tmp_path / "out"))
    assert (tmp_path / "out/g").read_text() == "two"
    tree = Store(spark, str(tmp_path / "r")).tree_of("both")
    assert tree in do("show", "both")[1]
    do("checkout-tree", tree, str(tmp_path / "tree"))
    assert (tmp_path / "tree/g").read_text() == "two"


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 50


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("treeledger.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "treeledger.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "diff" in entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
