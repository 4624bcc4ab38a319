"""Minifiers: one Column → Column function for each kind of file, as ordered replacements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import Step, apply, condense, replace, trim, trim_lines
from tessera.plans.options import Options

# The patterns of all minifiers. They follow one another in the order written here.
BLOCK_COMMENT: Step = (r"(?s)/\*.*?\*/", "", False)
LINE_COMMENT: Step = (r"(?<!:)//(?!/)[^\r\n]*", "", False)
TAG_COMMENT: Step = (r"(?s)<!--.*?-->", "", False)
BETWEEN_TAGS: Step = (r">\s+<", "><", False)
SPACES: Step = (r" {2,}", " ", False)
LINE_ENDS: Step = (r"^\s+|\s+$", "", True)
BLANKS_TO_TWO: Step = (r"(\r?\n){3,}", "\n\n", False)
BLANKS_TO_ONE: Step = (r"(\r?\n){2,}", "\n", False)
NO_NEWLINES: Step = (r"[\r\n]+", "", False)
FIRST_NEWLINES: Step = (r"\A[\r\n]+", "", False)
LAST_NEWLINES: Step = (r"[\r\n]+\z", "", False)

STYLE: list[Step] = [NO_NEWLINES, *((rf"\s*{c}\s*", c.removeprefix("\\"), False) for c in (r"\{", r"\}", ":", ";", ",")), SPACES]
CSS: list[Step] = [BLOCK_COMMENT, *STYLE]
SCSS: list[Step] = [LINE_COMMENT, BLOCK_COMMENT, *STYLE]
JAVASCRIPT: list[Step] = [LINE_COMMENT, BLOCK_COMMENT, BLANKS_TO_ONE, LINE_ENDS, SPACES, (r"\s*([{}\[\]();,:])\s*", "$1", False)]
JSON: list[Step] = [NO_NEWLINES, (r":\s+", ":", False), (r",\s+", ",", False), (r"([\[{])\s+", "$1", False), (r"\s+([\]}])", "$1", False)]
# Marks are noncharacters, which texts don't hold. A quoted attribute loses its quotes unless its value has one of < > & ' ": marked, unquoted where allowed, unmarked.
ATTRIBUTES: list[Step] = [
    (r'(\S+)="([^"\s]+)"', "\ufdd0$1\ufdd1$2\ufdd2", False),
    ("\ufdd0([^\ufdd0-\ufdd2]*)\ufdd1([^\ufdd0-\ufdd2<>&']*)\ufdd2", "$1=$2", False),
    ("\ufdd0([^\ufdd1]*)\ufdd1([^\ufdd2]*)\ufdd2", '$1="$2"', False),
]
HTML: list[Step] = [TAG_COMMENT, BETWEEN_TAGS, *ATTRIBUTES, SPACES, LINE_ENDS]
RAZOR: list[Step] = [TAG_COMMENT, BLOCK_COMMENT, LINE_COMMENT, (r"(?s)@\*.*?\*@", "", False), BETWEEN_TAGS, (r"@\(\s+", "@(", False), (r"\s+\)", ")", False), SPACES, LINE_ENDS, BLANKS_TO_TWO]
XML: list[Step] = [TAG_COMMENT, BETWEEN_TAGS, (r"^\s+", "", True), (r"\s+$", "", True), (r"(\?>\s*)", "?>\n", False), (r"[\r\n]+(?!<\?)", "", False), SPACES]
# A line underlined with = or - becomes a heading: marked with the kind of line, then written.
HEADINGS: list[Step] = [
    (r"^(.+)(\r?\n)([=\-])[=\-]{2,}\s*$", "\ufdd0$3$1\ufdd1", True),
    ("\ufdd0=\\s*(.*?)\\s*\ufdd1", "# $1", False),
    ("\ufdd0-\\s*(.*?)\\s*\ufdd1", "## $1", False),
]
RULES: Step = (r"^\s*[-*_]{3,}\s*(\r?\n)?", "", True)
TABLES: Step = (r"\s*\|\s*", "|", False)
MARKDOWN: list[Step] = [
    TAG_COMMENT,
    *HEADINGS,
    RULES,
    TABLES,
    (r'\[([^\]]+)\]\(([^\s)]+)\s+"[^"]*"\)', "[$1]($2)", False),
    BLANKS_TO_TWO,
    (r"(?<!  )[ \t]+$", "", True),
    FIRST_NEWLINES,
    LAST_NEWLINES,
]
YAML: list[Step] = [(r"^\s*#.*$", "", True), (r"[ \t]+$", "", True), BLANKS_TO_TWO, FIRST_NEWLINES, LAST_NEWLINES]

# C#. Literals are matched with possessive quantifiers, which neither overflow the stack nor backtrack.
_VERBATIM, _PLAIN = r'[^"]*+(?:""[^"]*+)*+"', r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
LITERAL = "|".join([r'\$@"' + _VERBATIM, r'@\$"' + _VERBATIM, '@"' + _VERBATIM, r'\$"' + _PLAIN, '"' + _PLAIN])
CS_COMMENTS: Step = (rf"({LITERAL})|//[^\r\n]*|/\*[\s\S]*?\*/", "$1", False)
CS_REGIONS: Step = (r"^\s*#(region|endregion)[^\r\n]*", "", True)
CS_DIRECTIVES: Step = (r"^\s*#.*", "", True)
CS_USINGS: list[Step] = [(r"^\s*using\s+[\w\.]+;\s*(\r?\n)?", "", True), (r"^\s*using\s+[A-Za-z0-9_]+\s*=\s*[\w\.]+;\s*(\r?\n)?", "", True)]
CS_NAMESPACES: list[Step] = [(r"^\s*namespace\s+[\w\.]+\s*;\s*(\r?\n)?", "", True), (r"^\s*namespace\s+[\w\.]+\s*[\r\n\s]*\{", "", True), (r"^(\s{4}|\t)", "", True)]
NOISE = (
    "DebuggerDisplay DebuggerStepThrough DebuggerNonUserCode MethodImpl EditorBrowsable Serializable Obsolete GeneratedCode"
    " CompilerGenerated ExcludeFromCodeCoverage SuppressMessage AssemblyVersion AssemblyFileVersion AssemblyTitle"
    " AssemblyDescription AssemblyConfiguration AssemblyCompany AssemblyProduct AssemblyCopyright AssemblyTrademark"
    " AssemblyCulture"
).split()
CS_AGGRESSIVE: list[Step] = [
    (rf"\[\s*({'|'.join(NOISE)})(\(.*\))?\s*\]\s*", "", False),
    (r"^\s*\[assembly:\s*SuppressMessage.*\]\s*$", "", True),
    (r"\bthis\.", "", False),
    (r"\{\s*get;\s*set;\s*\}", "{get;set;}", False),
    (r"\{\s*get;\s*\}", "{get;}", False),
    (r"\{\s*set;\s*\}", "{set;}", False),
]
CS_SYNTAX: list[Step] = [(r"\s*([{};,:()=\[\]])\s*", "$1", False), (r"\s+", " ", False)]
CS_BLANKS: list[Step] = [(r"[\t ]+$", "", True), (r"^\s+$", "", True), BLANKS_TO_ONE]

Minifier = Callable[[Column, Options], Column]


def csharp_compress(text: Column) -> Column:
    """Syntax without spare white space, outside literals: what lies between literals is compressed, and both are put
    together again in turn."""
    between = F.transform(F.split(text, "(?dU)" + LITERAL, -1), lambda x: apply(x, CS_SYNTAX))
    literals = F.concat(F.regexp_extract_all(text, F.lit("(?dU)" + LITERAL), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, literals, lambda a, b: F.concat(a, b)), "")


def csharp(text: Column, o: Options) -> Column:
    every, hard = o.apply_all_options, o.apply_all_options or o.aggressive_csharp_reduction
    if o.remove_csharp_comments or every:
        text = apply(text, [CS_COMMENTS])
    if hard:
        text = apply(text, [CS_DIRECTIVES])
    elif o.remove_csharp_regions:
        text = apply(text, [CS_REGIONS])
    if o.remove_csharp_usings or every:
        text = apply(text, CS_USINGS)
    if o.remove_csharp_namespaces or every:
        text = apply(text, CS_NAMESPACES)
    text = csharp_compress(apply(text, CS_AGGRESSIVE)) if hard else apply(text, CS_BLANKS)
    return trim(text)


def _of(steps: list[Step], trimmed: bool = False) -> Minifier:
    return lambda text, o: trim(apply(text, steps)) if trimmed else apply(text, steps)


def _if(switch: str, minifier: Minifier) -> Minifier:
    return lambda text, o: minifier(text, o) if getattr(o, switch) else text


css, scss, javascript, json = _of(CSS, True), _of(SCSS, True), _of(JAVASCRIPT, True), _of(JSON, True)
html, razor, xml, markdown, yaml = _of(HTML), _of(RAZOR), _of(XML, True), _of(MARKDOWN), _of(YAML)

#: The minifier of each ending. Of each family only the last ending heeds its switch. Users may add their own.
MINIFIERS: dict[str, Minifier] = {
    ".cs": csharp,
    ".razor": razor,
    ".cshtml": _if("minify_html_and_razor", razor),
    ".html": html,
    ".htm": _if("minify_html_and_razor", html),
    ".css": css,
    ".scss": scss,
    ".js": javascript,
    ".json": json,
    ".xml": xml,
    ".targets": xml,
    ".props": xml,
    ".csproj": _if("minify_xml_files", xml),
    ".md": markdown,
    ".yml": yaml,
    ".yaml": yaml,
}


def minify(text: Column, extension: Column, options: Options) -> Column:
    """By lower-case extension; other files stay as they are. A row runs its own branch only."""
    chosen = None
    for minifier in dict.fromkeys(MINIFIERS.values()):
        names = [e for e, m in MINIFIERS.items() if m is minifier]
        value = minifier(text, options)
        chosen = F.when(extension.isin(names), value) if chosen is None else chosen.when(extension.isin(names), value)
    return text if chosen is None else chosen.otherwise(text)


def process(text: Column, extension: Column, options: Options) -> Column:
    """Trim lines, condense, minify. A null text stays null."""
    if options.trim_content:
        text = trim_lines(text)
    if options.use_condensing:
        text = condense(text)
    return minify(text, extension, options)


__all__ = ["MINIFIERS", "minify", "process", "replace"]
