"""Text functions against hand-made rows, and minifiers against Python's own regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import minify as m
from tessera.functions import text as tx
from tessera.plans.options import Options

ALL = Options.dotnet(all=True)
NONE = Options()


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("t")).first()[0]


GOLDEN = [
    ("a\n\nb", "ab", tx.trim_lines),
    ("a\r\n\r\nb", "a\nb", tx.trim_lines),
    ("  a\t\n  b ", "a\nb", tx.trim_lines),
    ("a\n  \n\nb", "a\nb", tx.condense),
    ("a \n\n b", "a\n\nb", tx.trim_lines_apart),
    ('<p class="x" t="a b">', '<p class=x t="a b">', lambda c: m.html(c, NONE)),
    ('a="b="c&d"', 'a="b="c&d"', lambda c: m.html(c, NONE)),
    ("<b>\n <i>  x</i></b><!-- c -->", "<b><i> x</i></b>", lambda c: m.html(c, NONE)),
    ("|a | b|\n|---|", "|a|b||---|", lambda c: tx.apply(c, [m.TABLES])),
    ("title: x\n---", "## title: x", lambda c: m.markdown(c, NONE)),
    ("a\n===\n---", "# a\n---", lambda c: tx.apply(c, m.HEADINGS)),
    ("***bold*** x", "bold*** x", lambda c: m.markdown(c, NONE)),
    ('[x](http://y "t")', "[x](http://y)", lambda c: m.markdown(c, NONE)),
    ("///doc", "/", lambda c: m.javascript(c, NONE)),
    ('u = "http://x" // c', 'u = "http://x"', lambda c: m.javascript(c, NONE)),
    ('<?xml version="1.0"?>\n<a/>', '<?xml version="1.0"?><a/>', lambda c: m.xml(c, NONE)),
    ("a :hover{}", "a:hover{}", lambda c: m.css(c, NONE)),
    ("// x\n.a { b : c ; }", ".a{b:c;}", lambda c: m.scss(c, NONE)),
    ('{ "a" : 1,  "b": [ 2 ] }', '{"a" :1,"b":[2]}', lambda c: m.json(c, NONE)),
    ("# c\na: b  \n\n\n\nc: d\n", "a: b\n\nc: d", lambda c: m.yaml(c, NONE)),
    ("@* x *@<p>@( a ) </p>", "<p>@(a) </p>", lambda c: m.razor(c, NONE)),
    ('var u = "http://x"; // c', 'var u = "http://x"; ', lambda c: tx.apply(c, [m.CS_COMMENTS])),
    ('if ( x )  { y = "a ; b" ; }', 'if(x){y="a ; b";}', m.csharp_compress),
    ('[Obsolete("a")] int X; [Foo(1)] Y', "Y", lambda c: tx.apply(c, m.CS_AGGRESSIVE)),
    ("namespace A.B\n{\nclass C\n{\n}\n}", "\nclass C\n{\n}\n}", lambda c: tx.apply(c, m.CS_NAMESPACES)),
    ("using A.B;\nusing static C;\nint x;", "using static C;\nint x;", lambda c: m.csharp(c, Options(remove_csharp_usings=True))),
    ("#region a\nint x;\n#endregion\n#if B", "int x;\n#if B", lambda c: m.csharp(c, Options(remove_csharp_regions=True))),
    ("int P { get; set; }", "int P {get;set;}", lambda c: tx.apply(c, m.CS_AGGRESSIVE)),
    ("", "", lambda c: m.csharp(c, ALL)),
    (None, None, lambda c: m.process(c, F.lit(".md"), NONE)),
]


@pytest.mark.parametrize("text, expected, build", GOLDEN, ids=range(len(GOLDEN)))
def test_golden(spark, text, expected, build):
    assert one(spark, text, build) == expected


@pytest.mark.parametrize("n, label", [(999, "999t"), (1000, "1k"), (2500, "3k"), (554_300, "554k"), (0, "0t")])
def test_token_label(spark, n, label):
    assert spark.range(1).select(tx.token_label(F.lit(n)).alias("x")).first()[0] == label


def test_long_literals_neither_overflow_nor_stall(spark):
    text = 'string s = "' + "\\n" * 20_000 + '"; // c'
    assert one(spark, text, lambda c: tx.apply(c, [m.CS_COMMENTS])) == text[:-4]


def test_only_line_feeds_end_lines(spark):
    assert one(spark, "#a\rb c\nd", lambda c: tx.apply(c, [(r"^\s*#.*$", "", True)])) == "\nd"


def test_utf16_length(spark):
    assert one(spark, "a😀é", lambda c: tx.utf16_length(c)) == 4


def in_python(text, steps):
    for pattern, by, lines in steps:
        text = re.sub(pattern.replace(r"\z", r"\Z"), re.sub(r"\$(\d)", r"\\g<\1>", by.replace("\\", "\\\\")), text, flags=re.M if lines else 0)
    return text


SNIPPETS = [
    "a\n\nb  c\r\n\r\n  d", "<div class=\"a\">  <!-- x\ny -->\n  <p id='b' data=\"c>d\">t  u</p>\n</div>", "x: 1 # no\n  # yes\n\n\n\ny:   2\n", "/* a\nb */ .c { d : e ; }\n// f\n// http://g\nu('http://h')",
    "T\n===\n\nU\n---\n| a | b |\n|---|---|\n* * *\n- - -\n___ x\n[a](b \"c\") [d](e)  \nend   ", "using A;\nnamespace B\n{\n    // c\n    var s = \"x // y\"; /* z */ var t = @\"p\"\"q\";\n\t#region r\n}\n", "{ \"a\" : [ 1, 2 ],\n \"b\": { } }", "<?xml?>\n<a>\n  <b/>\n</a>\n", "é  ü\u2003x\n\u00a0\n日本", "", "  ", "\n", "@(  a  ) @* b *@",
]
CHAINS = {"lines": tx.TRIM_LINES, "condense": tx.CONDENSE, "css": m.CSS, "scss": m.SCSS, "js": m.JAVASCRIPT, "json": m.JSON, "html": m.HTML, "razor": m.RAZOR, "xml": m.XML, "md": m.MARKDOWN, "yml": m.YAML, "cs": [m.CS_COMMENTS, m.CS_DIRECTIVES, *m.CS_USINGS, *m.CS_NAMESPACES, *m.CS_AGGRESSIVE], "blanks": m.CS_BLANKS}


@pytest.mark.parametrize("name", CHAINS)
def test_chains_agree_with_python(spark, sf_dir, name):
    texts = SNIPPETS + [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").limit(20).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tx.apply(F.col("t"), CHAINS[name]).alias("t")).collect()
    for row in rows:
        assert row.t == in_python(texts[row.n], CHAINS[name]), texts[row.n]


def test_condensing_twice_changes_nothing(spark):
    for text in SNIPPETS:
        assert one(spark, text, lambda c: tx.condense(tx.condense(c))) == one(spark, text, tx.condense)


def test_switches_are_heeded_by_the_last_ending_of_a_family_only(spark):
    off, html = Options(minify_html_and_razor=False, minify_xml_files=False), '<a b="c">'
    for ending, text, changed in [(".html", html, True), (".htm", html, False), (".razor", "<!-- -->", True), (".cshtml", "<!-- -->", False), (".xml", "<a> <b/></a>", True), (".csproj", "<a> <b/></a>", False), (".txt", html, False)]:
        assert (one(spark, text, lambda c, e=ending: m.minify(c, F.lit(e), off)) != text) == changed, ending
