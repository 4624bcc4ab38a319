"""A query for each operator over the driver's tables, and the SQL of those that DuckDB can express."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import minify as m
from tessera.functions import text as tx
from tessera.functions.tokens import approximate, token_count
from tessera.operators import filters, packing, render, sinks
from tessera.plans.options import Options, extension_list, resolve
from tessera.plans.templates import TEMPLATES, template_dim
from tessera.session import reach, scratch, stored
from tessera.sources.tables import PATHS, table_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# What the SQL needs: literals, replacements in RE2's dialect, the relation of files.


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str, lines: bool) -> str:
    flags = "m" * lines + "s" * pattern.startswith("(?s)")
    pattern = pattern.removeprefix("(?s)").replace("*+", "*")
    return f"(?{flags}){pattern}" if flags else pattern


#: Steps with look-around, as equal ones without; see the tests.
_REWRITTEN: dict[tx.Step, list[tx.Step]] = {
    m.LINE_COMMENT: [(r"(^|[^:])//[^/\r\n][^\r\n]*", "$1", False), (r"(^|[^:])//(\r|\n|$)", "$1$2", False)],
    (r"(?<!  )[ \t]+$", "", True): [(r"[ \t]+$", "", True)],
    (r"[\r\n]+(?!<\?)", "", False): [(r"[\r\n]<\?", "\ufdd0<?", False), (r"[\r\n]+", "", False), ("\ufdd0", "\n", False)],
}


def _sql_steps(expression: str, steps: list[tx.Step]) -> str:
    for step in steps:
        for pattern, by, lines in _REWRITTEN.get(step, [step]):
            by = by.replace("\\", "\\\\").replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")
            expression = f"regexp_replace({expression}, {_quoted(_re2(pattern, lines))}, {_quoted(by)}, 'g')"
    return expression


def _sql_trim(expression: str) -> str:
    return f"regexp_replace({expression}, '\\A\\s+|\\s+\\z', '', 'g')"


def _sql_files(*tables: str) -> str:
    parts = [f"SELECT {PATHS[t][0]} AS relative_path, coalesce({PATHS[t][1]}, '') AS content FROM {t}" for t in tables or PATHS]
    return (
        "(SELECT '/corpus/' || relative_path AS path, relative_path, regexp_extract(relative_path, '[^/]*$') AS name,"
        " lower(regexp_extract(relative_path, '\\.[^./]*$')) AS extension, octet_length(encode(content)) AS length, content"
        f" FROM ({' UNION ALL '.join(parts)}) p) files"
    )


# Sources.

_add("scan_files", lambda s, d: table_files(s, d).select("path", "name", "length"), f"SELECT path, name, length FROM {_sql_files()}")
_add("relative_path", lambda s, d: table_files(s, d, "documents").select(F.translate(F.translate("path", "/", "\\"), "\\", "/").alias("path"), "relative_path"), f"SELECT path, relative_path FROM {_sql_files('documents')}")


def _written_tree(s: SparkSession, d: str) -> str:
    """Documents as files of a new tree, in three encodings, some hidden, with ignore rules; its folder, which executors and
    driver must see as a local one."""
    place = scratch(s, "tree")
    if not place.startswith(("file:", "/")):
        raise ValueError(f"files of a tree need a mounted folder, not {place}")
    root = "/" + place.removeprefix("file:").lstrip("/") + "/tree"
    reach(s)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text, folder in zip(pdf.doc_id, pdf.text, pdf.folder, strict=True):
                os.makedirs(f"{root}/{folder}", exist_ok=True)
                data = text.encode(("utf-8", "utf-8-sig", "utf-32")[doc_id % 3])
                with open(f"{root}/{folder}/{'.' * (doc_id % 5 == 0)}doc_{doc_id}.md", "wb") as f:
                    f.write(data)
            yield pd.DataFrame({"n": [len(pdf)]})

    folder = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")))
    docs = s.read.parquet(f"{d.rstrip('/')}/documents.parquet").where("doc_id is not null")
    docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), folder.alias("folder")).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    os.makedirs(f"{os.path.dirname(root)}/.git", exist_ok=True)  # the walk for ignore rules ends below it
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/.gitignore", "w", encoding="utf-8") as f:
        f.write("# rules\n\nde/*/*\n*.log\n")
    return root


def _repo_tree(s: SparkSession, d: str) -> DataFrame:
    from tessera.plans.engine import Engine

    kept = Options(source_directory=_written_tree(s, d), only_extensions=(".md",), exclude_directories=("src3",), ignore_binary_files=False, exclude_auto_generated=False)
    return Engine(s, kept).files().select("relative_path", "name", "extension", "length", "content")


_add(
    "repo_tree",
    _repo_tree,
    "SELECT relative_path, regexp_extract(relative_path, '[^/]*$') AS name, '.md' AS extension, length, text AS content FROM ("
    "SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END || 'doc_' || CAST(doc_id AS VARCHAR) || '.md' AS relative_path, lang, source, coalesce(text, '') AS text,"
    " CASE doc_id % 3 WHEN 0 THEN octet_length(encode(coalesce(text, ''))) WHEN 1 THEN 3 + octet_length(encode(coalesce(text, ''))) ELSE 4 + 4 * length(coalesce(text, '')) END AS length"
    " FROM documents WHERE doc_id IS NOT NULL) f WHERE length > 0 AND lang IS DISTINCT FROM 'de' AND source IS DISTINCT FROM 'src3'",
)
_add("file_extension", lambda s, d: table_files(s, d).groupBy("extension").agg(F.count(F.lit(1)).alias("files")), f"SELECT extension, count(*) AS files FROM {_sql_files()} GROUP BY extension")

# Configuration.

_CASES = {
    "only": Options(template="DotNet", only_extensions=(".sql",), exclude_directories=("tmp",), exclude_patterns=("*.bak",)),
    "none": Options(exclude_extensions=(".md",)),
    "included": Options(include_extensions=(".sql", ".md")),
    "dotnet": Options(template="DotNet", exclude_extensions=(".xml", ".md"), include_extensions=(".sql", ".cs"), exclude_directories=("bin", "tmp"), exclude_patterns=("*.map", "*.bak")),
    "wiki": Options(template="azuredevopswiki"),
}


def _resolved(s: SparkSession, d: str) -> DataFrame:
    rows = [(k, list(r.extensions), list(r.exclude_directories), list(r.exclude_patterns)) for k, r in ((k, resolve(o)) for k, o in _CASES.items())]
    df = s.createDataFrame(rows, "name string, extensions array<string>, folders array<string>, patterns array<string>")
    return df.select("name", *[F.array_join(c, " ").alias(c) for c in ("extensions", "folders", "patterns")])


def _joined(*names: str) -> str:
    return _quoted(" ".join(names))


_dotnet, _wiki = TEMPLATES["DotNet"], TEMPLATES["AzureDevOpsWiki"]
_add(
    "resolve_config",
    _resolved,
    "SELECT * FROM (VALUES "
    f"('only', '.sql', 'tmp', '*.bak'), ('none', '*.*', '', ''), ('included', '.sql .md', '', ''), "
    f"('dotnet', {_joined(*(e for e in _dotnet.extensions if e not in ('.xml', '.md')), '.sql')}, {_joined(*_dotnet.folders, 'tmp')}, {_joined(*_dotnet.patterns, '*.bak')}), "
    f"('wiki', {_joined(*_wiki.extensions)}, {_joined(*_wiki.folders)}, '')) v(name, extensions, folders, patterns)",
)
_add(
    "template_dim",
    lambda s, d: template_dim(s).select("template", F.array_join("extensions", " ").alias("extensions"), F.array_join("folders", " ").alias("folders"), F.array_join("patterns", " ").alias("patterns")),
    "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_joined(*t.extensions)}, {_joined(*t.folders)}, {_joined(*t.patterns)})" for k, t in TEMPLATES.items()) + ") v(template, extensions, folders, patterns)",
)
_LISTS = "concat(lang, ', .', source, ',,', cast(doc_id as string))"
_add(
    "extension_list",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(extension_list(F.expr(_LISTS)), " ").alias("extensions")),
    f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split({_LISTS}, ','), lambda x: x <> ''), lambda x: CASE WHEN starts_with(trim(x), '.') THEN trim(x) ELSE '.' || trim(x) END), ' ') AS extensions FROM documents",
)

# Filters. Each query keeps paths; contents that the tables lack are put in by the same expression on both sides.

_ODD = (
    "case doc_id % 7 when 0 then concat(repeat('日', 400), text) when 1 then concat(repeat('é', 400), text) when 2 then ''"
    " when 3 then concat('a', chr(10), 'b', chr(13), chr(10), '// <Auto-Generated> x', chr(10), text)"
    " when 4 then concat('1', chr(10), '2', chr(10), '3', chr(10), '4', chr(10), '5', chr(10), '<autogenerated>', chr(10), text)"
    " when 5 then concat(' ', chr(10), case doc_id % 4 when 0 then '{}' when 1 then '[] ' when 2 then '<r />' else ' ' end) else text end"
)


def _odd_files(s: SparkSession, d: str) -> DataFrame:
    from tessera.sources.tables import as_files

    return as_files(s.read.parquet(f"{d}/documents.parquet"), PATHS["documents"][0], _ODD)


_ODD_SQL = _sql_files("documents").replace("coalesce(text, '')", f"coalesce({_ODD}, '')")


def _filter(name: str, kept: Column | Callable[[], Column], sql: str, odd: bool = False) -> None:
    source = _odd_files if odd else table_files
    _add(name, lambda s, d: source(s, d).where(kept()).select("relative_path"), f"SELECT relative_path FROM {_ODD_SQL if odd else _sql_files()} WHERE {sql}")


def _endings_sql(column: str, endings: list[str]) -> str:
    return f"regexp_matches({column}, {_quoted('(?:' + '|'.join(e.lower() for e in endings) + ')$')})"


_PARTS = "string_split(lower(relative_path), '/')"
_filter("filter_extension", lambda: filters.has_extension((".md", ".YML", "min.js")), r"regexp_matches(lower(name), '(?:\.md|\.yml|min\.js)$')")
_filter("filter_excluded_dir", lambda: filters.outside_folders(("FR", "system", "docs/src1")), f"NOT list_has_any({_PARTS}, ['fr', 'system', 'docs/src1'])")
_filter("filter_test_dirs", lambda: filters.outside_tests(), f"len(list_filter({_PARTS}, lambda p: {_endings_sql('p', filters.TEST_ENDINGS)})) = 0")
_filter("filter_unit_test_dirs", lambda: filters.outside_tests(filters.UNIT_TEST_ENDINGS), f"len(list_filter({_PARTS}, lambda p: {_endings_sql('p', filters.UNIT_TEST_ENDINGS)})) = 0")
_filter("filter_max_size", lambda: filters.at_most(2), "length <= 2048")
_filter("filter_empty", filters.not_empty, "length > 0", odd=True)
_filter("filter_name", lambda: filters.not_named(("DOC_0.md", "page_7.html")), "lower(name) NOT IN ('doc_0.md', 'page_7.html')")
_filter("filter_glob", lambda: filters.outside_globs(("*.min.js", "docs/**/doc_1*.md", "page_[1-3]?.html")), r"NOT regexp_matches(name, '^([^/]*\.min\.js|page_[1-3][^/]\.html)$') AND NOT regexp_matches(relative_path, '^docs/(.*/)?doc_1[^/]*\.md$')")
_filter("filter_gitignore", lambda: filters.not_ignored(("/corpus/web/*", "/corpus/docs/src1/*/*.md")), r"NOT regexp_matches(path, '^/corpus/(web/[^/]*|docs/src1/[^/]*/[^/]*\.md)$')")
_filter("filter_binary", filters.is_text, r"coalesce(length(regexp_replace(substring(content, 1, 8000), '[\x00-\x{FF}]', '', 'g')) / nullif(length(substring(content, 1, 8000)), 0) <= 0.1, true)", odd=True)
_filter("filter_autogenerated", filters.not_generated, r"NOT regexp_matches(lower(array_to_string(regexp_split_to_array(content, '\r\n|\r|\n')[1:5], chr(10))), '<auto-?generated')", odd=True)
_TRIVIAL_SQL = f"{_sql_trim('content')} IN ('', '{{}}', '[]')"
_SHORT_TAG_SQL = f"(starts_with({_sql_trim('content')}, '<') AND ends_with({_sql_trim('content')}, '/>') AND length({_sql_trim('content')}) < 10)"
_filter("filter_trivial", lambda: ~filters.is_trivial(F.col("content")), f"NOT ({_TRIVIAL_SQL} OR {_SHORT_TAG_SQL})", odd=True)
_filter("filter_trivial_in_memory", lambda: ~filters.is_trivial(F.col("content"), self_closing=False), f"NOT {_TRIVIAL_SQL}", odd=True)
_COLLECT = Options(include_extensions=(".md", ".html", ".json", ".js", ".yaml"), exclude_directories=("de", "system"), exclude_patterns=("*.min.js",), exclude_unit_test_projects=True, max_file_size_kb=16)
_add(
    "collect_files",
    lambda s, d: filters.collect_files(table_files(s, d), _COLLECT, resolve(_COLLECT), ("/corpus/web/page_1*",)).select("relative_path", "length"),
    f"SELECT relative_path, length FROM {_sql_files()} WHERE regexp_matches(lower(name), '\\.(md|html|json|js|yaml)$') AND NOT list_has_any({_PARTS}, ['de', 'system'])"
    f" AND {SQL['filter_unit_test_dirs'].partition(' WHERE ')[2]} AND length BETWEEN 1 AND 16384 AND NOT ends_with(name, '.min.js') AND NOT regexp_matches(path, '^/corpus/web/page_1[^/]*$')",
)

# Contents. Frames around the texts exercise what the texts themselves leave untouched.

_LF = "chr(10)"


def _frame(*parts: str) -> str:
    """Lines of literals (quoted here) and SQL expressions (marked with a leading =), joined by line feeds."""
    return "concat(" + f", {_LF}, ".join(p[1:] if p.startswith("=") and not p.endswith("=") else _quoted(p) for p in parts) + ")"


FRAMES = {
    "text": "replace(text, '. ', concat('.  ', chr(10), chr(10), '   '))",
    "css": _frame("/* c */", ".a , .b { color : red ; }", "=concat('/* ', text, ' */', ' .c :hover { margin : 0 , 1 ; }')"),
    "js": _frame("// c", 'var u = "http://h" ; ///d', "if ( a ) {  b ( 1 , 2 ) ; }  //", "=concat('/* ', text, ' */ x = [ 1 , 2 ]')"),
    "razor": _frame("<!-- a --><div>  <b>x</b>", "@* c *@ // d", "  @( x ) y </div>", " ", " ", "", "=concat('<p>/* ', text, ' */</p>')"),
    "xml": _frame('<?xml version="1.0"?>', "<d>", "=concat('  <t a=\"1\">', cast(doc_id as string), '</t>  <!-- ', lang, ' -->')", "=concat('  <p>  ', text, '  </p>  <!-- ', text, ' -->')", "</d>"),
    "md": _frame("<!-- h -->", "Title", "=====", "", "  | a  | b |  ", "---", '[x](http://y "t")', "=text", "***", "Low", "---", "", "", "", "end  ", ""),
    "yml": _frame("# head", "  key: v  ", "", "", "", "   # tail", "=text", "", ""),
    "cs": _frame(
        "using A.B;", "using static X.Y;", "using Z = A.B;", "namespace N {", "    #region r", "    // c", '    string s = "a // b", t = @"c "" /* d";', "    /* e",
        "    f */ public int P {  get;  set; } = this.x ;", "    #endregion", "    [Obsolete(1)] [Foo] int Q { get ; }", "}", "=concat('// ', replace(text, chr(10), concat(chr(10), '// ')))", "", "", "", "int last ;",
    ),
    "cs_flat": _frame("namespace A.B.C;", "", "[assembly: SuppressMessage(1)]", "class D  { string s = $\"x {  1 }\" ; } // e", "=concat('// ', replace(text, chr(10), concat(chr(10), '// ')))"),
}


def _content(name: str, frame: str, build: Callable[[Column], Column], sql: Callable[[str], str] | None) -> None:
    """doc_id and the built content of each framed document."""
    _add(
        name,
        lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(FRAMES[frame]).alias("framed")).select("doc_id", build(F.col("framed")).alias("content")),
        None if sql is None else f"SELECT doc_id, {sql('framed')} AS content FROM (SELECT doc_id, {FRAMES[frame]} AS framed FROM documents) f",
    )


def _steps(name: str, frame: str, steps: list[tx.Step], trimmed: bool = False) -> None:
    _content(name, frame, lambda c: tx.trim(tx.apply(c, steps)) if trimmed else tx.apply(c, steps), lambda e: _sql_trim(_sql_steps(e, steps)) if trimmed else _sql_steps(e, steps))


_steps("trim_lines", "text", tx.TRIM_LINES)
_steps("condense_lines", "text", tx.CONDENSE)
_steps("minify_css", "css", m.CSS, trimmed=True)
_steps("minify_scss", "js", m.SCSS, trimmed=True)
_steps("minify_js", "js", m.JAVASCRIPT, trimmed=True)
_steps("minify_razor", "razor", m.RAZOR)
_steps("minify_xml", "xml", m.XML, trimmed=True)
_steps("minify_markdown", "md", m.MARKDOWN)
_steps("minify_yaml", "yml", m.YAML)
_steps("minify_csharp_comments", "cs", [m.CS_COMMENTS])
_steps("minify_csharp_regions", "cs", [m.CS_REGIONS])
_steps("minify_csharp_directives", "cs", [m.CS_DIRECTIVES])
_steps("minify_csharp_usings", "cs", m.CS_USINGS)
_steps("minify_csharp_namespaces", "cs", m.CS_NAMESPACES)
_steps("minify_csharp_file_namespaces", "cs_flat", m.CS_NAMESPACES)
_steps("minify_csharp_aggressive", "cs", m.CS_AGGRESSIVE)
_steps("minify_csharp_attributes", "cs_flat", m.CS_AGGRESSIVE)
_steps("minify_csharp_whitespace", "cs", m.CS_BLANKS, trimmed=True)


def _sql_compress(expression: str) -> str:
    literal = _quoted(m.LITERAL.replace("*+", "*"))
    between, literals = f"regexp_split_to_array({expression}, {literal})", f"list_append(regexp_extract_all({expression}, {literal}), '')"
    return f"array_to_string(list_transform(list_zip({between}, {literals}), lambda x: {_sql_steps('x[1]', m.CS_SYNTAX)} || x[2]), '')"


_content("minify_csharp_compress", "cs", m.csharp_compress, _sql_compress)
_ALL = Options.dotnet(all=True)
_content(
    "minify_csharp_all", "cs", lambda c: m.csharp(c, _ALL),
    lambda e: _sql_trim(_sql_compress(_sql_steps(e, [m.CS_COMMENTS, m.CS_DIRECTIVES, *m.CS_USINGS, *m.CS_NAMESPACES, *m.CS_AGGRESSIVE]))),
)
_content("minify_csharp_none", "cs", lambda c: m.csharp(c, Options()), lambda e: _sql_trim(_sql_steps(e, m.CS_BLANKS)))
_PROCESS = [*tx.TRIM_LINES, *tx.CONDENSE]
_BY_EXTENSION = {".html": (m.HTML, False), ".json": (m.JSON, True), ".yaml": (m.YAML, False), ".md": (m.MARKDOWN, False), ".yml": (m.YAML, False), ".css": (m.CSS, True), ".cs": (m.CS_BLANKS, True), ".js": (m.JAVASCRIPT, True)}


def _sql_process(expression: str, *extensions: str) -> str:
    done = _sql_steps(expression, _PROCESS)
    if not extensions:
        return done
    cases = []
    for e in extensions:
        steps, trimmed = _BY_EXTENSION[e]
        value = _sql_steps("done", steps)
        cases.append(f"WHEN extension = {_quoted(e)} THEN {_sql_trim(value) if trimmed else value}")
    return f"CASE {' '.join(cases)} ELSE done END"


def _sql_processed(*tables: str) -> str:
    """Files of the tables with processed content."""
    return f"(SELECT path, relative_path, name, extension, length, {_sql_process('', *_BY_EXTENSION)} AS content FROM (SELECT *, {_sql_process('content')} AS done FROM {_sql_files(*tables)}) q) files"


_add(
    "process_content",
    lambda s, d: table_files(s, d).select("relative_path", m.process(F.col("content"), F.col("extension"), Options()).alias("content")),
    f"SELECT relative_path, content FROM {_sql_processed()}",
)
_add("minify_html", lambda s, d: table_files(s, d, "pages").select("relative_path", m.html(F.col("content"), Options()).alias("content")), f"SELECT relative_path, {_sql_steps('content', m.HTML)} AS content FROM {_sql_files('pages')}")
_add("minify_json", lambda s, d: table_files(s, d, "events").select("relative_path", m.json(F.col("content"), Options()).alias("content")), f"SELECT relative_path, {_sql_trim(_sql_steps('content', m.JSON))} AS content FROM {_sql_files('events')}")

# Tokens, order, budgets, parts.

MAX, SPLIT = 100_000, 8_000


def _entries(s: SparkSession, d: str) -> DataFrame:
    files = table_files(s, d, "documents")
    return packing.with_cost(files, approximate(F.col("content")))


_COST = "CAST(ceil(length(content) / 4.0) AS BIGINT)"
_RANKED = (
    "(SELECT *, row_number() OVER (ORDER BY length DESC, relative_path) AS rank,"
    " coalesce(sum(cost) OVER (ORDER BY length DESC, relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev"
    f" FROM (SELECT *, {_COST} AS tokens, {_COST} + 30 AS cost FROM {_sql_files('documents')}) c) ranked"
)
_PARTED = (
    f"WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {_RANKED}), f(rank, part, held) AS (SELECT rank, 1, cost FROM r WHERE rank = 1 UNION ALL"
    f" SELECT r.rank, CASE WHEN f.held + r.cost > {SPLIT} AND f.held > 0 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + r.cost > {SPLIT} AND f.held > 0 THEN r.cost ELSE f.held + r.cost END"
    " FROM f JOIN r ON r.rank = f.rank + 1), parted AS (SELECT r.*, f.part FROM r JOIN f ON r.rank = f.rank) "
)


def _narrow(s: SparkSession, d: str) -> DataFrame:
    """Ranked entries without contents."""
    return packing.ranked(_entries(s, d).drop("content", "path", "name", "extension"))


def _parted(s: SparkSession, d: str) -> DataFrame:
    return packing.split_parts(_narrow(s, d), SPLIT)


def _parted_texts(s: SparkSession, d: str) -> DataFrame:
    return _parted(s, d).join(table_files(s, d, "documents").select("relative_path", "content"), "relative_path")


_add("token_count_bpe", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", token_count(s, F.col("text")).alias("tokens")))
_add("token_cost", lambda s, d: _entries(s, d).select("relative_path", "tokens", "cost"), f"SELECT relative_path, {_COST} AS tokens, {_COST} + 30 AS cost FROM {_sql_files('documents')}")
_add("sort_largest_first", lambda s, d: _narrow(s, d).select("rank", "relative_path", "length"), f"SELECT rank, relative_path, length FROM {_RANKED}")
_add("max_tokens_cut", lambda s, d: packing.within_budget(_narrow(s, d), MAX).select("relative_path", "rank", "cost", "prev"), f"SELECT relative_path, rank, cost, CAST(prev AS BIGINT) AS prev FROM {_RANKED} WHERE rank = 1 OR prev <= {MAX}")
_add("split_parts", lambda s, d: _parted(s, d).select("relative_path", "rank", "cost", "part"), _PARTED + "SELECT relative_path, rank, cost, part FROM parted")
_add("part_totals", lambda s, d: packing.part_totals(_parted(s, d)), _PARTED + "SELECT part, CAST(sum(cost) AS BIGINT) AS part_tokens, count(*) AS entries FROM parted GROUP BY part")
_add("top5_tokens", lambda s, d: packing.top_tokens(_narrow(s, d)), f"SELECT relative_path, tokens FROM {_RANKED} ORDER BY tokens DESC, rank LIMIT 5")
_add("stats", lambda s, d: packing.totals(packing.within_budget(_narrow(s, d), MAX)), f"SELECT CAST(sum(cost) AS BIGINT) AS total_tokens, count(*) AS processed_files FROM {_RANKED} WHERE rank = 1 OR prev <= {MAX}")

# Rendering.

_LABEL_SQL = "CASE WHEN {n} < 1000 THEN CAST({n} AS VARCHAR) || 't' ELSE CAST(CAST(round({n} / 1000.0, 0) AS BIGINT) AS VARCHAR) || 'k' END"
_ENTRY_SQL = "'<file path=\"' || relative_path || '\">' || chr(10) || content || CASE WHEN ends_with(content, chr(10)) THEN '' ELSE chr(10) END || '</file>' || chr(10)"
_with_entry = lambda df: df.withColumn("entry", render.entry(F.col("relative_path"), F.col("content")))
_add("token_label", lambda s, d: _entries(s, d).select("relative_path", tx.token_label(F.col("tokens")).alias("label"), tx.token_label(F.col("tokens") * 500).alias("label_500")), f"SELECT relative_path, {_LABEL_SQL.format(n='tokens')} AS label, {_LABEL_SQL.format(n='(tokens * 500)')} AS label_500 FROM {_RANKED}")
_add("render_entry", lambda s, d: _with_entry(table_files(s, d)).select("relative_path", "entry"), f"SELECT relative_path, {_ENTRY_SQL} AS entry FROM {_sql_files()}")
_add("render_parts", lambda s, d: render.part_texts(_with_entry(_parted_texts(s, d))), _PARTED + f"SELECT part, string_agg({_ENTRY_SQL}, '' ORDER BY rank) AS part_text FROM parted GROUP BY part")
_add(
    "part_file_names",
    lambda s, d: render.part_file_names(packing.part_totals(_parted(s, d)), "corpus").select("part", "file_name"),
    _PARTED + f"SELECT part, 'corpus' || CASE WHEN max(part) OVER () > 1 THEN '_part' || CAST(part AS VARCHAR) ELSE '' END || '_' || {_LABEL_SQL.format(n='t')} || '.txt' AS file_name FROM (SELECT part, CAST(sum(cost) AS BIGINT) AS t FROM parted GROUP BY part) p",
)


# End to end: the largest pages, minified, within a budget.

PAGES = Options(include_extensions=(".html",), max_tokens=60_000, tokenizer="approx")


def _packed_pages(s: SparkSession, d: str, self_closing: bool = True) -> DataFrame:
    from tessera.plans.engine import prepared

    files = filters.collect_files(table_files(s, d, "pages"), PAGES, resolve(PAGES), ())
    done = stored(prepared(s, files, PAGES, self_closing), "prepared")
    chosen = packing.within_budget(packing.ranked(done.select("relative_path", "length", "tokens", "cost")), PAGES.max_tokens)
    return _with_entry(chosen.join(done.select("relative_path", "content"), "relative_path"))


_PACKED_SQL = (
    "(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY length DESC, relative_path) AS rank,"
    " coalesce(sum(cost) OVER (ORDER BY length DESC, relative_path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev"
    f" FROM (SELECT *, {_COST} AS tokens, {_COST} + 30 AS cost FROM {_sql_processed('pages')} WHERE length > 0) c) ranked WHERE rank = 1 OR prev <= {PAGES.max_tokens}) packed"
)
_add("pack_end_to_end", lambda s, d: _packed_pages(s, d).select("rank", "relative_path", "tokens", "cost", "entry"), f"SELECT rank, relative_path, tokens, cost, {_ENTRY_SQL} AS entry FROM {_PACKED_SQL}")
_add("pack_in_memory", lambda s, d: sinks.one_text(_packed_pages(s, d, self_closing=False)), f"SELECT string_agg({_ENTRY_SQL}, '' ORDER BY rank) AS text FROM {_PACKED_SQL}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
