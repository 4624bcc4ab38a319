"""Project templates: which name endings belong to a kind of project, which folders and names don't."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Template(NamedTuple):
    extensions: tuple[str, ...]
    folders: tuple[str, ...]
    patterns: tuple[str, ...] = ()


def _t(extensions: str, folders: str, patterns: str = "") -> Template:
    return Template(tuple(extensions.split()), tuple(folders.split()), tuple(patterns.split()))


#: Name endings, excluded folders and excluded name patterns of each template.
TEMPLATES: dict[str, Template] = {
    "Generic": _t(".txt .md .json .xml .yaml .yml", ".git .svn .hg node_modules .vscode .idea"),
    "DotNet": _t(
        ".cs .razor .cshtml .xaml .csproj .props .targets .config .json .xml .yml .yaml .md .scss .css .html .htm .editorconfig",
        "bin obj .vs .git .idea node_modules TestResults packages artifacts",
        "*.feature.cs *Steps.g.cs *.AssemblyHooks.cs *.g.cs *.g.i.cs *.Designer.cs *.designer.cs *_i.c *.generated.cs"
        " TemporaryGeneratedFile_*.cs *.Cache.cs *.cache *.baml ServiceReference.cs Reference.cs AssemblyInfo.cs *.xsd.cs"
        " *.resx *.resources launchSettings.json packages.lock.json bundleconfig.json *.min.js *.min.css *.map"
        " package-lock.json yarn.lock",
    ),
    "Java": _t(".java .gradle .xml .properties .jar .jsp .jspx .class", "build target .gradle .mvn node_modules .git"),
    "Python": _t(".py .pyc .pyd .pyo .pyw .pyx .pxd .pxi .ipynb .req .txt", "__pycache__ .venv venv env .tox dist build .git .pytest_cache"),
    "JavaScript": _t(".js .jsx .json .ts .tsx .html .css .scss .less .mjs", "node_modules dist build coverage .next .nuxt .git"),
    "TypeScript": _t(".ts .tsx .js .jsx .json .html .css .scss .less", "node_modules dist build coverage .next .nuxt .git"),
    "Ruby": _t(".rb .rake .gemspec Gemfile Rakefile .erb .haml .slim", "vendor .bundle coverage tmp log .git"),
    "Go": _t(".go .mod .sum", "vendor bin .git"),
    "Rust": _t(".rs .toml .lock", "target .cargo .git"),
    "Php": _t(".php .phtml .php7 .phps .php-s .pht .phar", "vendor node_modules .git"),
    "CppCSharp": _t(".cpp .hpp .h .c .cc .cs .csproj .sln", "bin obj Debug Release x64 x86 .vs .git"),
    "Swift": _t(".swift .xib .storyboard .xcodeproj .pbxproj .plist", ".build Pods .git"),
    "Kotlin": _t(".kt .kts .java .xml .gradle", "build .gradle .idea .git"),
    "Scala": _t(".scala .sbt .sc", "target project/target .bloop .metals .git"),
    "Dart": _t(".dart .yaml .lock", "build .dart_tool .pub-cache .git"),
    "Lua": _t(".lua .rockspec", ".git"),
    "Perl": _t(".pl .pm .t", "blib _build .git"),
    "R": _t(".R .Rmd .Rproj .RData .rds", ".Rproj.user .Rhistory .RData .Ruserdata .git"),
    "VbNet": _t(".vb .vbproj .config .settings .resx .sln", "bin obj .vs packages node_modules .git"),
    "Fsharp": _t(".fs .fsi .fsx .fsproj .config .sln", "bin obj .vs packages node_modules .git"),
    "Clojure": _t(".clj .cljs .cljc .edn", "target .cpcache .git"),
    "Haskell": _t(".hs .lhs .cabal .hs-boot", "dist dist-newstyle .stack-work .git"),
    "Erlang": _t(".erl .hrl .app.src rebar.config", "_build .rebar3 .git"),
    "Elixir": _t(".ex .exs .eex .leex mix.exs", "_build deps .git"),
    "Infrastructure": _t(
        ".tf .tfvars .yaml .yml .json .md .sh .ps1 .hcl .tpl .env .properties .conf .config",
        ".terraform node_modules .git .vs .idea bin obj dist build .pytest_cache __pycache__ tmp temp logs",
        "*.tfstate *.tfstate.backup *.tfplan *.tfvars.json override.tf override.tf.json *_override.tf *_override.tf.json"
        " .terraformrc terraform.rc crash.log crash.*.log .terraform.lock.hcl",
    ),
    "AzureDevOpsWiki": _t(".md", ".git .attachments"),
}


def template(name: str) -> Template:
    """The template, or Generic's endings and folders (without patterns) for an unknown name."""
    return TEMPLATES.get(name) or TEMPLATES["Generic"]._replace(patterns=())


def template_named(name: str) -> str | None:
    """The template that a name means, whatever its case."""
    return next((t for t in TEMPLATES if t.lower() == name.strip().lower()), None)


def template_dim(spark: SparkSession) -> DataFrame:
    """Templates as a dimension: template, extensions, folders, patterns."""
    rows = [(name, list(t.extensions), list(t.folders), list(t.patterns)) for name, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template string, extensions array<string>, folders array<string>, patterns array<string>")
