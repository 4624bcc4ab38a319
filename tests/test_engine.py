"""From a directory to bundles, on a small tree."""

import io
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.plans import cli
from tessera.plans.engine import Cancelled, Engine, pack_to_string, prepared, read_resource
from tessera.plans.options import Options
from tessera.plans.serve import serve
from tessera.sources.files import read_contents, read_tree
from tessera.streaming.files import stream_entries, stream_files, write_entries


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "My.Repo"
    contents = {
        "src/A.cs": b"using A;\r\n\r\nclass A { }\r\n", "src/B.cs": b"\xef\xbb\xbfclass B {   int x; }\n", "src/_C.cshtml": b"<p>  x</p>", ".editorconfig": b"root = true\n", "pkg/__init__.py": b"x = 1\n",
        "bin/x.cs": b"class X {}", "empty.txt": b"", "img.png": b"\x89PNG\xff\xfe\x00\x80\x81" * 50, "u16.txt": "héllo wörld".encode("utf-16"), "gen.g.cs": b"class G {}", "auto.cs": b"//\n// <auto-generated>\nclass Q {}",
        "Foo.Tests/T.cs": b"class T {}", ".gitignore": b"*.log\n!keep.log\nout/\n", "sub/.gitignore": b"*\n", "a.log": b"log", "sub/b.log": b"log b", "note.md": b"# Title\n\ntext\n", "nothing.json": b" {} ",
    }
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def names(df):
    return {r.relative_path for r in df.select("relative_path").collect()}


def test_source_lists_and_decodes(spark, tree):
    rows = {r.relative_path: r for r in read_tree(spark, tree).collect()}
    assert {".editorconfig", "pkg/__init__.py", "src/_C.cshtml", "empty.txt", "bin/x.cs"} <= set(rows)
    assert rows["u16.txt"].content == "héllo wörld" and rows["src/B.cs"].content.startswith("class") and "�" in rows["img.png"].content
    assert rows["src/A.cs"].extension == ".cs" and rows["src/A.cs"].length == 25 and rows["empty.txt"].length == 0
    assert "src/A.cs" not in names(read_tree(spark, tree, recursive=False)) and "bin/x.cs" not in names(read_tree(spark, tree, excluded=("BIN",)))
    assert names(read_tree(spark, tree, metadata=True).where("length <= 5 and length > 0")) == {"a.log", "sub/b.log", "nothing.json", "sub/.gitignore"}
    with pytest.raises(Exception, match="Directory not found"):
        read_tree(spark, tree + "/none").collect()


def test_engine_takes_the_right_files(spark, tree):
    found = names(Engine(spark, Options.dotnet(source_directory=tree, exclude_test_projects=True)).files())
    assert found == {"src/A.cs", "src/B.cs", "src/_C.cshtml", ".editorconfig", "note.md", "nothing.json"}
    every = names(Engine(spark, Options(source_directory=tree)).files())
    assert "sub/b.log" in every and "a.log" not in every and "img.png" not in every and "empty.txt" not in every


def test_part_files(spark, tree, tmp_path):
    o = Options.root(source_directory=tree, output_directory=str(tmp_path), include_extensions=(".cs", ".md"), split_tokens=60, tokenizer="approx")
    clock = lambda: datetime(2026, 2, 12, 14, 30, 15)
    first = Engine(spark, o, clock).run()
    assert len(first.generated_paths) > 1 and all("My_Repo_2026-02-12_1430_part" in p for p in first.generated_paths)
    assert first.processed_files == first.total_files and first.top == () and first.total_tokens >= 30 * first.processed_files
    whole = "".join(open(p, encoding="utf-8-sig").read() for p in first.generated_paths)
    assert whole == Engine(spark, o).run_in_memory().generated_paths[0]
    assert open(first.generated_paths[0], "rb").read(3) == b"\xef\xbb\xbf"
    again = Engine(spark, Options.root(**{**o.__dict__, "overwrite": False}), clock).run()
    assert all(p.endswith("_3015.txt") for p in again.generated_paths) and not list(tmp_path.glob("*.tmp"))


def test_in_memory_text(spark, tree):
    text = pack_to_string(spark, tree, "dotnet", aggressive_minification=True)
    assert '<file path="src/A.cs">\nusing A;class A{}\n</file>\n' in text and "files | ~" in text.splitlines()[-1]
    assert "nothing.json" not in text
    assert pack_to_string(spark, tree, max_tokens=1).count("<file ") == 1
    assert "<file " in read_resource(spark, "generic", tree) and "files | ~" not in read_resource(spark, "generic", tree)


def test_included_endings_of_the_tool_are_the_only_ones(spark, tree):
    for template in ("dotnet", None):
        text = pack_to_string(spark, tree, template, include_extensions="md, ,.cshtml")
        assert text.count("<file ") == 2 and '<file path="note.md">' in text and '<file path="src/_C.cshtml">' in text
    assert pack_to_string(spark, tree, "dotnet", include_extensions=" , ").count("<file ") > 2
    folder = pack_to_string(spark, tree, "dotnet", include_extensions=".cs")
    assert '<file path="bin/x.cs">' in folder  # the template's folders count for nothing either


def test_errors_of_the_tool_are_texts(spark, tree):
    assert pack_to_string(spark, tree + "/none") == read_resource(spark, "generic", tree + "/none") == f"Error: Directory not found: {tree}/none"
    assert pack_to_string(spark, tree, "Vue").startswith("Error: Unknown template 'Vue'. Valid values: Generic, DotNet, ")
    assert read_resource(spark, "Vue", tree).startswith("Error: Unknown template 'Vue'. Valid values: generic, Generic, DotNet, ")
    assert pack_to_string(spark, tree, include_extensions="zig") == "No files found matching the criteria."
    assert pack_to_string(spark, tree, tokenizer="nothing").startswith("Error during fusion: ")


def test_only_files_that_the_listing_leaves_are_read(spark, tree, monkeypatch):
    plan = Engine(spark, Options(source_directory=tree, only_extensions=(".md",))).files()
    assert names(plan) == {"note.md"}
    listed = read_tree(spark, tree, metadata=True).where("name = 'note.md'")
    assert [r.content for r in read_contents(listed).collect()] == ["# Title\n\ntext\n"]
    gone = read_contents(listed.withColumn("path", F.lit("/nowhere/at/all"))).collect()
    assert [r.content for r in gone] == [None]


def test_minifiers_run_once_a_file(spark):
    files = spark.createDataFrame([("a", "a.cs", "a.cs", ".cs", 1, "x")], "path string, relative_path string, name string, extension string, length long, content string")
    done = prepared(spark, files, Options.dotnet(tokenizer="approx"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 180


def test_a_run_can_be_cancelled(spark, tree):
    engine = Engine(spark, Options(source_directory=tree))
    engine.cancel()
    with pytest.raises(Cancelled):
        engine.run_in_memory()
    assert Engine(spark, Options(source_directory=tree, tokenizer="approx")).run_in_memory().processed_files > 0


def test_nothing_found_writes_nothing(spark, tree, tmp_path):
    assert Engine(spark, Options(source_directory=tree, output_directory=str(tmp_path), include_extensions=(".zig",))).run().generated_paths == ()
    assert list(tmp_path.iterdir()) == []


def test_command_line(spark, tree, tmp_path, capsys):
    assert cli.options_of(["dotnet", "--directory", "d", "--all", "--exclude-extensions", ".a, .b", "--no-recursive", "--max-tokens", "5"]) == Options.dotnet(all=True, source_directory="d", exclude_extensions=(".a", ".b"), recursive=False, max_tokens=5)
    assert cli.main(["wiki", "--directory", tree, "--output", str(tmp_path), "--tokenizer", "approx"]) == 0
    assert str(tmp_path) in capsys.readouterr().out
    assert cli.main(["--directory", tree + "/none"]) == 1


def test_server_of_tools(spark, tree):
    source = io.StringIO("".join(json.dumps(m) + "\n" for m in (
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "get_optimized_context", "arguments": {"path": tree, "includeExtensions": "md"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_optimized_context", "arguments": {"path": tree + "/none"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "get_optimized_context", "arguments": {"path": tree, "maxTokens": "many"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "resources/templates/list"},
        {"jsonrpc": "2.0", "id": 7, "method": "resources/read", "params": {"uri": "bundle://generic/" + tree}},
        {"jsonrpc": "2.0", "id": 8, "method": "nothing"},
    )) + "no json\n")
    sink = io.StringIO()
    serve(spark, source, sink)
    replies = [json.loads(line) for line in sink.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    by_id = {r["id"]: r for r in replies}
    assert by_id[1]["result"]["protocolVersion"] == "2024-11-05" and by_id[2]["result"]["tools"][0]["name"] == "get_optimized_context"
    called = by_id[3]["result"]
    assert not called["isError"] and called["content"][0]["text"].count("<file ") == 1 and '<file path="note.md">' in called["content"][0]["text"]
    assert by_id[4]["result"]["isError"] and by_id[4]["result"]["content"][0]["text"].startswith("Error: Directory not found")
    assert [by_id[k]["error"]["code"] for k in (5, 8, None)] == [-32602, -32601, -32700]
    assert "<file " in by_id[7]["result"]["contents"][0]["text"] and by_id[6]["result"]["resourceTemplates"]


def test_token_counts_of_the_tokenizer(spark):
    from tessera.functions.tokens import encoding, token_count

    texts = ["", "hello world", "<|endoftext|>", "日本語"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(token_count(spark, F.col("t")).alias("n")).collect()]
    assert got == [len(encoding("byte_bpe_50k").encode_ordinary(t)) for t in texts] + [0]
    with pytest.raises(ValueError):
        token_count(spark, F.col("t"), "nothing")


def test_stream(spark, tree, tmp_path):
    entries = stream_entries(stream_files(spark, tree), Options(tokenizer="approx"))
    write_entries(entries, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {"src/A.cs", "note.md"} <= names(out) and not {"img.png", "auto.cs", "nothing.json"} & names(out)
