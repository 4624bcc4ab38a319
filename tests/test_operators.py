"""Options, filters, budgets and rendering on small relations."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters, packing, render
from tessera.plans.options import Options, parse_extensions, resolve, resource_template, tool_template
from tessera.plans.templates import TEMPLATES, template
from tessera.sources.globs import any_glob, glob_regex, ignore_globs


def files(spark, *rows):
    out = [(f"/r/{p}", p, p.rsplit("/", 1)[-1], "", len(c.encode()), c) for p, c in rows]
    return spark.createDataFrame(out, "path string, relative_path string, name string, extension string, length bigint, content string")


def kept(spark, predicate, *rows):
    rows = [r if isinstance(r, tuple) else (r, "x") for r in rows]
    return [r.relative_path for r in files(spark, *rows).where(predicate).orderBy("relative_path").collect()]


def test_resolve():
    o = Options(template="dotnet", exclude_extensions=[".xml", ".md"], include_extensions=[".sql"])
    assert len(resolve(o).extensions) == 17 and len(resolve(o).exclude_directories) == 9 and len(resolve(o).exclude_patterns) == 27
    assert resolve(Options(exclude_extensions=(".md",))).extensions == ("*.*",)
    only = resolve(Options(template="DotNet", only_extensions=(".cs",), exclude_directories=("x",)))
    assert (only.extensions, only.exclude_directories, only.exclude_patterns) == ((".cs",), ("x",), ())
    assert len(TEMPLATES) == 26 and template("nothing") == TEMPLATES["Generic"]


def test_names_from_outside():
    assert parse_extensions("cs, .md,,x") == (".cs", ".md", ".x") and parse_extensions(" ") is None
    assert tool_template(" python ") == "Python" and tool_template("") is None and tool_template("generic") == "Generic" and resource_template("generic") is None
    with pytest.raises(ValueError):
        tool_template("Node")
    with pytest.raises(ValueError):
        Options(template="Node")


def test_defaults_of_the_commands():
    assert Options().split_tokens is None and Options.root().split_tokens == 800_000
    assert Options.root(track_top_token_files=True).track_top_token_files is False
    assert Options.wiki(exclude_test_projects=True).exclude_test_projects is False
    assert all(getattr(Options.dotnet(all=True), f"remove_csharp_{x}") for x in ("comments", "usings", "namespaces", "regions"))


def test_filters(spark):
    assert kept(spark, filters.has_extension((".CS", "file")), "a.cs", "b.css", "Gemfile") == ["Gemfile", "a.cs"]
    assert kept(spark, filters.has_extension(()), "a.cs") == [] and kept(spark, filters.has_extension(("",)), "a.cs") == ["a.cs"]
    assert kept(spark, filters.outside_folders(("build", "a/b")), "src/BUILD/x.cs", "build", "a/b/c", "builder/x") == ["a/b/c", "builder/x"]
    unit = filters.outside_tests(filters.UNIT_TEST_ENDINGS)
    assert kept(spark, unit, "A.IntegrationTests/x.cs", "latest/x.cs", "A.Benchmarks/x.cs") == ["A.Benchmarks/x.cs"]
    assert kept(spark, filters.outside_tests(), "A.Benchmarks/x.cs", "src/x.cs") == ["src/x.cs"]
    assert kept(spark, filters.is_text(), ("a", "é" * 50), ("b", "日" * 50), ("c", ""), ("d", "a" * 8000 + "日" * 5000)) == ["a", "c", "d"]
    assert kept(spark, filters.not_generated(), ("a", "1\n2\n3\n4\n<Auto-Generated>"), ("b", "1\n2\n3\n4\n5\n<auto-generated>"), ("c", "<auto_generated>")) == ["b", "c"]
    assert kept(spark, filters.outside_globs(("*.Designer.cs", "sub/**/x?.[!a]")), "a.designer.cs", "b.Designer.cs", "sub/p/q/x1.b", "sub/x1.a", "sub/x1.b") == ["a.designer.cs", "sub/x1.a"]
    assert kept(spark, filters.at_most(1), ("a", "x" * 1024), ("b", "x" * 1025)) == ["a"]
    assert kept(spark, filters.not_empty(), ("a", ""), ("b", " ")) == ["b"]
    assert kept(spark, filters.not_named(("A.CS",)), "a.cs", "b.cs") == ["b.cs"]
    assert kept(spark, filters.not_ignored(("/r/*.log",)), "a.log", "s/b.log") == ["s/b.log"]


def test_trivial(spark):
    rows = [("a", " {} "), ("b", "[]"), ("c", "<r />"), ("d", " \n\u2003"), ("e", "<r a='12'/>"), ("f", "x")]
    assert kept(spark, ~filters.is_trivial(F.col("content")), *rows) == ["e", "f"]
    assert kept(spark, ~filters.is_trivial(F.col("content"), self_closing=False), *rows) == ["c", "e", "f"]


def test_globs_and_ignore_files(tmp_path):
    assert glob_regex("a*b?[!x]**/c**") == "a[^/]*b[^/][^x](?:.*/)?c.*" and any_glob(()) is None
    root, sub = tmp_path / "repo", tmp_path / "repo" / "sub"
    (sub / "deep").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("root\n")
    (sub / ".gitignore").write_text("# no\n\n *.log \n!keep\n")
    (sub / "deep" / ".gitignore").write_text("nested\n")
    assert ignore_globs(str(sub)) == [f"{sub}/*.log", f"{sub}/!keep"]
    assert f"{root}/root" in ignore_globs(str(root))


def entries(spark, *costs):
    rows = [(f"f{k:03d}", 1000 - k, c) for k, c in enumerate(costs)]
    return packing.ranked(spark.createDataFrame(rows, "relative_path string, length bigint, cost bigint"))


def by_rank(df, column):
    return [r[column] for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("limit, expected", [(100, [60, 50]), (110, [60, 50, 40]), (0, [60]), (None, [60, 50, 40])])
def test_budget_includes_the_entry_that_crosses_it(spark, limit, expected):
    assert by_rank(packing.within_budget(entries(spark, 60, 50, 40), limit), "cost") == expected


@pytest.mark.parametrize("costs, split, expected", [((400, 500, 200, 900, 100), 800, [1, 2, 2, 3, 4]), ((900,), 800, [1]), ((5, 5), None, [1, 1]), ((), 800, [])])
def test_parts(spark, costs, split, expected):
    assert by_rank(packing.split_parts(entries(spark, *costs), split), "part") == expected


def test_parts_hold_the_budget_and_keep_order(spark):
    import random

    rng = random.Random(3)
    rows = packing.split_parts(entries(spark, *[rng.randint(1, 900) for _ in range(300)]), 1000).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 301)) and [r.part for r in rows] == sorted(r.part for r in rows)
    sums, counts = {}, {}
    for r in rows:
        sums[r.part], counts[r.part] = sums.get(r.part, 0) + r.cost, counts.get(r.part, 0) + 1
    assert all(s <= 1000 or counts[p] == 1 for p, s in sums.items())
    running = 0
    for r in rows:
        assert r.prev == running
        running += r.cost


def test_ties_go_by_path(spark):
    df = spark.createDataFrame([("b", 5, 1), ("a", 5, 1), ("c", 9, 1)], "relative_path string, length bigint, cost bigint")
    assert by_rank(packing.ranked(df), "relative_path") == ["c", "a", "b"]


def test_rendering(spark):
    shown = spark.createDataFrame([("a\\b", "x"), ("c", "y\n"), ("d", "")], "p string, c string").select(render.entry(F.col("p"), F.col("c")).alias("e")).collect()
    assert [r.e for r in shown] == ['<file path="a/b">\nx\n</file>\n', '<file path="c">\ny\n</file>\n', '<file path="d">\n\n</file>\n']
    parts = spark.createDataFrame([(1, 800_000), (2, 999)], "part int, part_tokens bigint")
    assert sorted(r.file_name for r in render.part_file_names(parts, "p").collect()) == ["p_part1_800k.txt", "p_part2_999t.txt"]
    assert [r.file_name for r in render.part_file_names(parts.where("part = 1"), "p").collect()] == ["p_800k.txt"]
    assert render.base_name("/x/My.Project", None, True, datetime(2026, 2, 12, 14, 30)) == "My_Project_all_2026-02-12_1430"
    assert render.base_name("/x", "out.txt") == "out"
    assert render.consumers([("a", 1250), ("b", 7)]) == ["1. a (1.3k)", "2. b (7)"]
    assert render.summary(12.4, 554_300, 3, 4, 1.25).startswith("12 KB • 554k tokens • 3/4 files")
