"""Readers of manifests: a text, the rows wanted."""

import json

import pytest

from shelfmark.operators import dependencies as d
from shelfmark.operators import manifests as m

POM = """<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><properties><x.v> 1.2 </x.v></properties>
<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId><version>${x.v}</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${x.v}</version></dependency><dependency><groupId>g</groupId><artifactId>managed</artifactId></dependency>
<dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4.13</version><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>open</artifactId><version>${gone}</version></dependency></dependencies></project>"""
PROJECT = """<Project Sdk="S"><ItemGroup><PackageReference Include="N.Json" Version="13.0.1" /><PackageReference Include="Lint"><Version>2</Version><PrivateAssets>all</PrivateAssets></PackageReference></ItemGroup>
<ItemGroup><Compile Include="a.cs" /></ItemGroup></Project>"""
CASES = [
    ("requirements.txt", "production", "# all\nDjango[x]>=4.2,<5 ; python_version > '3'\n-r more.txt\nflask\nreq==2.31.0  # why\nurl @ https://x.y/z.whl\n./local\nlong==1 \\\n  --hash=sha256:abc\n--index-url https://x\n",
     [("production", "Django", ">=4.2,<5"), ("production", "flask", None), ("production", "req", "==2.31.0"), ("production", "url", "@https://x.y/z.whl"), ("production", "long", "==1")]),
    ("requirements-dev.txt", "dev", "pytest~=8.0\r\nruff\r\n", [("dev", "pytest", "~=8.0"), ("dev", "ruff", None)]),
    ("go.mod", "production", "module x\n\ngo 1.22\n\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n\tc.d/e v0.0.1\n)\nrequire f.g/h v2.0.0\nreplace c.d/e => ../e\n",
     [("production", "github.com/a/b", "v1.2.3"), ("production", "c.d/e", "v0.0.1"), ("production", "f.g/h", "v2.0.0")]),
    ("Gemfile", "production", "source 'x'\ngem 'rails', '~> 7.0', '>= 7.0.4'\ngem \"pg\"\ngroup :development, :test do\n  gem 'rspec', require: false\nend\n", [("production", "rails", "~>7.0,>=7.0.4"), ("production", "pg", None), ("dev", "rspec", None)]),
    ("build.gradle", "production", "dependencies {\n  implementation 'a.b:c:1.0'\n  testImplementation(\"j:j:4\")\n  api(\"k:l\")\n}", [("production", "a.b:c", "1.0"), ("dev", "j:j", "4"), ("production", "k:l", None)]),
    ("package.json", "production", json.dumps({"dependencies": {"react": "^18.2.0", "odd": {"x": 1}}, "devDependencies": {"jest": "29"}, "peerDependencies": {"p": "*"}}), [("production", "react", "^18.2.0"), ("production", "odd", None), ("production", "p", "*"), ("dev", "jest", "29")]),
    ("package.json", "production", '{"dependencies": []}', []), ("package.json", "production", "{}", []), ("package.json", "production", "[1]", None), ("package.json", "production", "{broken", None), ("package.json", "production", None, None),
    ("composer.json", "production", json.dumps({"require": {"php": ">=8", "ext-json": "*", "a/b": "~1"}, "require-dev": {"c/d": "2.*"}}), [("production", "a/b", "~1"), ("dev", "c/d", "2.*")]),
    ("pom.xml", "production", POM, [("production", "g:a", "1.2"), ("production", "g:managed", "1.2"), ("dev", "junit:junit", "4.13"), ("production", "g:open", "${gone}")]),
    ("pom.xml", "production", "<project/>", []), ("pom.xml", "production", "<project><dep", None), ("pom.xml", "production", "", None),
    ("app.csproj", "production", PROJECT, [("production", "N.Json", "13.0.1"), ("dev", "Lint", "2")]),
    ("packages.config", "production", '<packages><package id="A" version="1" /><package id="B" version="2" developmentDependency="true" /></packages>', [("production", "A", "1"), ("dev", "B", "2")]),
    ("pyproject.toml", "production", '[project]\ndependencies = ["a>=1", "b"]\n[project.optional-dependencies]\nt = ["c==2"]\n[tool.poetry.dependencies]\npython = "^3"\nd = {version = "^1", extras = ["x"]}\n[tool.poetry.group.x.dependencies]\ne = "*"\n',
     [("production", "a", ">=1"), ("production", "b", None), ("dev", "c", "==2"), ("production", "d", "^1"), ("dev", "e", "*")]),
    ("pyproject.toml", "production", "project = 5", None), ("pyproject.toml", "production", "[x", None),
    ("Cargo.toml", "production", '[dependencies]\nserde = {version = "1.0", features = ["x"]}\nlog = "0.4"\nown = {path = "../o"}\n[dev-dependencies]\nt = "3"\n[target."cfg(unix)".dependencies]\nlibc = "0.2"\n',
     [("production", "serde", "1.0"), ("production", "log", "0.4"), ("production", "own", None), ("dev", "t", "3"), ("production", "libc", "0.2")]),
    ("Pipfile", "production", '[packages]\na = "*"\n[dev-packages]\nb = {version = "==1"}\n', [("production", "a", "*"), ("dev", "b", "==1")]),
    ("Dockerfile", "production", "FROM x", []),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [("r", f"/{i}/{name}", kind, text) for i, (name, kind, text, _) in enumerate(CASES)]
    out: dict = {}
    for r in d.dependency_rows(spark.createDataFrame(rows, "repo_name string, full_path string, dep_type string, content string").repartition(3)).collect():
        out.setdefault(int(r["full_path"].split("/")[1]), []).append(r)
    return out


@pytest.mark.parametrize("at", range(len(CASES)))
def test_readers(read, at):
    name, _, _, want = CASES[at]
    got = read.get(at, [])
    if want is None:
        assert [(r["name"], r["error"]) for r in got] == [(None, f"cannot be read: {name}")]
    else:
        assert sorted(((r["dep_type"], r["name"], r["constraint"]) for r in got), key=str) == sorted(want, key=str)
        assert not any(r["error"] for r in got)


def test_constraints_as_columns(spark):
    texts = ["^18.2.0", ">=4.2,<5", "==1", "~> 7.0", "1.0", "v1.2.3", "*", "~=8", "@https://x", "!=3", None]
    parts = d.constraint_parts
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [tuple(r) for r in rows.select(*(p.alias(n) for p, n in zip(parts(rows["c"]), "ov"))).collect()]
    assert got == [("^", "18.2.0"), (">=", "4.2"), ("==", "1"), ("~>", "7.0"), ("", "1.0"), ("", "1.2.3"), ("", None), ("~=", "8"), ("", None), ("!=", "3"), (None, None)]


def test_files_to_catalog_and_technologies(spark):
    files = [("r", "a/requirements.txt", "Flask==2\nmy_lib"), ("r", "b/package.json", '{"devDependencies": {"my-lib": "1"}}'), ("r", "node_modules/x/package.json", '{"dependencies": {"hidden": "1"}}'), ("q", "go.mod", "{")]
    rows = d.read_dependencies(spark.createDataFrame(files, "repo_name string, path string, content string")).filter("error IS NULL")
    got = {r["dependency"]: (r["paths"], r["is_production"]) for r in m.dependency_catalog(rows).collect()}
    assert got == {"flask": (["/a/requirements.txt"], True), "mylib": (["/a/requirements.txt", "/b/package.json"], True)}
    catalogue = spark.createDataFrame([("MyLib", "tools")], "name string, technology string")
    assert [tuple(r) for r in m.detect_technologies(rows, catalogue).collect()] == [("r", "tools", 2)]


def test_a_file_is_parsed_once(spark):
    """XML is not parsed anew for each entry of a file."""
    files = [("r", "pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>")]
    rows = d.read_dependencies(spark.createDataFrame(files, "repo_name string, path string, content string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 3
    assert [(r["name"], r["error"]) for r in rows.collect()] == [("g:a", None)]
