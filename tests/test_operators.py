"""Portfolio operators on single cases."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import analyze, documents, files, manifests, registry, results, scans
from shelfmark.operators import history as h
from shelfmark.sources import files as file_source
from shelfmark.sources import registry as source

STATE = "repo_name string, commit_sha string, branch_name string, has_uncommitted_changes boolean, prompt_versions array<struct<prompt:string,version:string>>"
HISTORY = "repository_name string, analysis_timestamp long, analysis_type string, latest_commit string, branch_name string, prompt_versions map<string,string>"
SHA = "abc123de" + "0" * 32


def decide(spark, current, last, prompts=None, dirty=False, force=False):
    state = spark.createDataFrame([("r", *current, dirty, prompts)], STATE)
    past = spark.createDataFrame([("r", 1_700_000_000 if len(last) < 4 else last[3], "investigation", *last[:3])] if last else [], HISTORY)
    r = h.investigation_decision(state, past, force=force).first()
    return r["needs_investigation"], r["reason"]


@pytest.mark.parametrize(
    ("current", "last", "prompts", "want"),
    [
        ((SHA, "main"), None, None, (True, "No previous investigation found")),
        ((SHA, "main"), (SHA, "main", None), None, (False, "No changes since last investigation on 2023-11-14T22:13:20+00:00")),
        ((SHA, "main"), ("fff" + SHA[3:], "main", None), None, (True, "New commits detected (current: abc123de, last: fff123de)")),
        ((SHA, "main"), (None, "main", None), None, (True, "New commits detected (current: abc123de, last: unknown)")),
        ((SHA, "dev"), (SHA, "main", None), None, (True, "Branch changed (current: dev, last: main)")),
        ((SHA, "main"), (SHA, "main", None, 0), None, (False, "No changes since last investigation on 1970-01-01T00:00:00+00:00")),
        ((SHA, "main"), (SHA, "main", None), [("hl", "2"), ("dep", "1")], (True, "Prompt 'hl' updated to v2 (no previous version tracking)")),
        ((SHA, "main"), (SHA, "main", {}), [("hl", "1"), ("sec", "2")], (True, "Prompt 'sec' updated to v2 (no previous version tracking)")),
        ((SHA, "main"), (SHA, "main", {}), [("hl", "1")], (False, "No changes since last investigation on 2023-11-14T22:13:20+00:00")),
        ((SHA, "main"), (SHA, "main", {"hl": "1", "dep": "1"}), [("hl", "2"), ("dep", "1"), ("api", "1")], (True, "Prompt count changed (2 → 3)")),
        ((SHA, "main"), (SHA, "main", {"hl": "1", "dep": "1"}), [("hl", "1"), ("dep", "3")], (True, "Prompt 'dep' version changed (v1 → v3)")),
        ((SHA, "main"), (SHA, "main", {"hl": "1", "dep": "1"}), [("hl", "1"), ("new", "1")], (True, "Prompt 'dep' was removed")),
        ((SHA, "main"), (SHA, "main", {"hl": "4"}), [], (False, "No changes since last investigation on 2023-11-14T22:13:20+00:00")),
    ],
)
def test_decisions(spark, current, last, prompts, want):
    assert decide(spark, current, last, prompts) == want


def test_decisions_ignore_dirt_and_obey_force(spark):
    assert not decide(spark, (SHA, "main"), (SHA, "main", None), dirty=True)[0]
    assert decide(spark, (SHA, "main"), (SHA, "main", None), force=True) == (True, "Force flag enabled")


def test_an_expired_result_hides_an_older_live_one(spark):
    rows = [("r", "s", "c", "1", "old", 1, 0), ("r", "s", "c", "1", "new", 2, 50), ("r", "t", "c", "1", "", 1, 0)]
    cached = spark.createDataFrame(rows, "repo_name string, step_name string, commit_sha string, prompt_version string, content string, created_at long, ttl_at long")
    tasks = spark.createDataFrame([("r", "s", "c", "1"), ("r", "t", "c", "1"), ("r", "u", "c", "1")], "repo_name string, step_name string, commit_sha string, prompt_version string")
    look = lambda now: {r["step_name"]: r["cached"] for r in results.cache_lookup(tasks, cached, now).collect()}
    assert look(50) == {"s": True, "t": False, "u": False} and look(51)["s"] is False


def test_combining_prefers_new_even_if_empty(spark):
    steps = spark.createDataFrame([("r", i, s, None, "2") for i, s in enumerate("abcd")], "repo_name string, ordinal int, step_name string, description string, version string")
    new = spark.createDataFrame([("r", "a", "new a"), ("r", "b", "")], "repo_name string, step_name string, content string")
    old = spark.createDataFrame([("r", "a", "old a", "2"), ("r", "b", "old b", "2"), ("r", "c", "old c", "1"), ("r", "d", "", "2")], "repo_name string, step_name string, content string, version string")
    rows = results.combine_results(steps, new, old).orderBy("ordinal").collect()
    assert [(r["step_name"], r["content"], r["version"], r["cached"]) for r in rows] == [("a", "new a", "2", False), ("c", "old c", "2", True)]


def test_missing_monitoring_is_an_error(spark):
    steps = spark.createDataFrame([("r", 0, "hl"), ("r", 1, "monitoring")], "repo_name string, ordinal int, step_name string").withColumn("required", F.lit(None).cast("boolean"))
    have = spark.createDataFrame([("r", "hl", "x")], "repo_name string, step_name string, content string")
    assert results.completeness(steps, have).first().asDict() == {"repo_name": "r", "tracked": 2, "missing": "monitoring", "has_monitoring": False, "error": "monitoring is missing"}


def test_documents(spark):
    rows = spark.createDataFrame([("r", 1, "data_map", "about", "B"), ("r", 0, "hl", None, "A")], "repo_name string, ordinal int, step_name string, description string, content string")
    assert documents.assemble_document(rows).first()["document"] == "# hl\n\nA\n\n# data_map\n\nabout\n\nB"
    toc = "## Table of Contents\n\n1. [Hl](#hl)\n2. [Data Map](#data_map)\n"
    assert documents.assemble_document_toc(rows).first()["document"] == toc + "\n\n---\n\n## Hl {#hl}\n\nA\n\n---\n\n## Data Map {#data_map}\n\n*about*\n\nB"
    assert documents.saved_documents(spark.createDataFrame([("a", ""), ("", "x"), ("b", "x")], "repo_name string, document string")).first()["file_name"] == "b.arch.md"


def test_tree(spark):
    paths = ["b.txt", "a.txt", "src/z.py", "src/lib/deep/one/x.py", "src/lib/deep/f.py", "src/lib/deep/g.py", "node_modules/x/y.js", "foo.egg-info/PKG", "src/build"]
    tree = files.tree_lines(spark.createDataFrame([("repo", p) for p in paths], "repo_name string, path string"), icons=False).first()["tree"]
    assert tree.split("\n") == ["Repository: repo", "================", "", "  a.txt", "  b.txt", "  src/", "    build", "    z.py", "    lib/", "      deep/", "        one/ [NESTED]", "        [2 files]"]


def test_manifests(spark):
    rows = [
        ("r", "web/package.json", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}})), ("r", "node_modules/x/package.json", "{"), ("r", "package-lock.json", "{}"), ("r", "x.csproj", "<p/>"), ("r", "my.gemspec", "s"),
        ("r", "Gemfile", "gem 'a'\ngroup :development, :test do\n  gem 'b'\nend\ngem 'c'"), ("r", "pyproject.toml", '[project]\ndependencies = ["x"]\n[tool.poetry.dev-dependencies]\ny = "1"'), ("r", "requirements-dev.txt", "pytest"), ("r", "yarn.lock", ""),
    ]
    found = manifests.match_manifests(spark.createDataFrame(rows, "repo_name string, path string, content string"))
    parts = {(r["language"], r["dep_type"], r["full_path"]): r["content"] for r in manifests.split_manifests(found).collect()}
    assert parts[("JavaScript", "production", "/web/package.json")] == '{\n  "dependencies": {\n    "a": "1"\n  }\n}'
    assert parts[("JavaScript", "dev", "/web/package.json (dev)")] == '{\n  "devDependencies": {\n    "b": "2"\n  }\n}'
    assert parts[("JavaScript", "production", "/node_modules/x/package.json")] == "{"
    assert parts[("Ruby", "production", "/Gemfile")] == "gem 'a'\ngem 'c'" and parts[("Ruby", "dev", "/Gemfile (dev/test)")] == "  gem 'b'"
    assert parts[("Python", "production", "/pyproject.toml")] == 'dependencies = ["x"]\n' and parts[("Python", "dev", "/pyproject.toml (dev)")] == 'dev-dependencies = { "y" = "1" }\n'
    assert {k[2] for k in parts} >= {"/x.csproj", "/my.gemspec", "/requirements-dev.txt"} and not any("lock" in k[2] for k in parts)
    assert manifests.match_manifests(spark.createDataFrame(rows, "repo_name string, path string, content string"), prune=True).count() == 6


def slow_gemfile(text):
    """The parts of a Gemfile, line by line."""
    lines, dev = {False: [], True: []}, False
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("group "):
            dev = ":development" in bare or ":test" in bare
        elif dev and bare.startswith("end"):
            dev = False
        else:
            lines[dev].append(line)
    parts = [("production", "", "\n".join(lines[False])), ("dev", " (dev/test)", "\n".join(lines[True]))]
    return [p for p in parts if p[2].strip()]


def test_gemfiles_against_lines(spark):
    import random

    rng = random.Random(3)
    words = ("group :test do", "  group :development, :test do", "group :production do", "group ", "group", "end", "\t end", "ending", "gem 'a'", "  gem 'b'", "", " ", "\u3000end\r", "group\u00a0:test", "x group :test", "group  \u2003")
    texts = ["\n".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "end", "group :test do", "\n" * 5, "gem 'x'\n" * 2_000 + "group :test do\n" + "gem 'y'\n" * 2_000 + "end"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", manifests.gemfile_groups(F.col("t")).alias("p")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert [tuple(p) for p in r["p"]] == ([] if r["t"] is None else slow_gemfile(r["t"])), r["t"]


def test_packing_ends_before_the_budget_and_lets_large_files_stand_alone(spark):
    size = lambda tokens: int(tokens * 3.5) + 1 - len("**File:** `/f0`\n```\n\n```\n")
    rows = [("r", "Go", "production", 0, f"/f{i}", "x" * size(n)) for i, n in enumerate((40, 60, 10, 250, 90, 10))] + [("r", "Rust", "dev", 0, "/f9", "x")]
    packed = manifests.pack_batches(spark.createDataFrame(rows, "repo_name string, language string, dep_type string, pattern_ordinal int, full_path string, content string"), 100)
    got = [(r["full_path"], r["sub_batch"], r["batch_tokens"]) for r in packed.orderBy("language", "full_path").collect()]
    assert got[:6] == [("/f0", 0, 100), ("/f1", 0, 100), ("/f2", 1, 10), ("/f3", 2, 250), ("/f4", 3, 100), ("/f5", 3, 100)]
    numbers = manifests.number_batches(packed).orderBy("batch_index").collect()
    assert [(r["language"], r["files"], r["batch_index"], r["total_batches"]) for r in numbers] == [("Go", 2, 0, 5), ("Go", 1, 1, 5), ("Go", 1, 2, 5), ("Go", 2, 3, 5), ("Rust", 1, 4, 5)]


def test_batches_over_several_parts(spark):
    import random

    rng = random.Random(1)
    schema = "repo_name string, language string, dep_type string, pattern_ordinal int, full_path string, content string"
    rows = [(f"r{k % 2}", "Go", rng.choice(("production", "dev")), rng.randrange(3), f"/{k:05d}", "x" * rng.choice((0, 5, 40, 40, 90, 400, 2_000))) for k in range(900)]
    for budget, aqe, fan_in in ((100, "false", 64), (3_000, "false", 2), (40_000, "false", 2), (40_000, "false", 64), (100, "true", 64), (700, "false", 3)):
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        try:
            got = {r["full_path"]: (r["sub_batch"], r["batch_tokens"]) for r in manifests.pack_batches(spark.createDataFrame(rows, schema), budget, fan_in).collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        for repo in ("r0", "r1"):
            batches, held = [[]], 0
            for path, t in ((r[4], int((len(r[4]) + len(r[5]) + 22) / 3.5)) for r in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2] != "production", *r[3:5]))):
                if batches[-1] and held + t > budget:
                    batches, held = [*batches, []], 0
                batches[-1].append((path, t))
                held += t
            assert {p: (i, sum(t for _, t in b)) for i, b in enumerate(batches) for p, _ in b} == {p: v for p, v in got.items() if any(p == r[4] and r[0] == repo for r in rows)}


def test_no_text_of_a_whole_source_is_one_value(spark, data):
    """Digests of whole sources gather digests only; the pieces that they digest are the operators' texts."""
    from shelfmark.plans import files as plans

    for query in (plans.dependency_digest, plans.tree_digest):
        plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(d#" in plan and "collect_list(text" not in plan and "collect_list(struct(text" not in plan
    texts: dict = {}
    deps, paths = plans.dependency_files(spark, data), plans.paths(spark, data)
    for name, pieces, order in (("deps", manifests.dependency_pieces(deps, ["repo_name"]), ["language", "kind", "full_path"]), ("tree", files.tree_pieces(paths, icons=False), ["place"])):
        for r in pieces.orderBy("repo_name", *order).collect():
            before, gap = texts.get((name, r["repo_name"]), ("", ""))
            texts[name, r["repo_name"]] = (before + gap + r["text"], r["gap"])
    whole = {("deps", r["repo_name"]): r["formatted"] for r in manifests.format_dependencies(deps, ["repo_name"]).collect()} | {("tree", r["repo_name"]): r["tree"] for r in files.tree_lines(paths, icons=False).collect()}
    assert {k: t for k, (t, _) in texts.items()} == whole


@pytest.mark.parametrize("rows", [1, 5000])
def test_digest_trees_follow_the_pieces(spark, rows):
    from shelfmark.functions.digest import digest_tree

    pieces = [("r", f"p{i}", f"text {i}") for i in range(rows)]
    of = lambda p: digest_tree(spark.createDataFrame(p, "repo_name string, place string, text string").repartition(3), ["repo_name"], ["place", "text"], "d").first()["d"]
    assert of(pieces) == of(pieces[::-1]) and len({of(pieces), of(pieces[:-1] + [("r", "p0x", "text")]), of([*pieces, pieces[0]])}) == 3


def test_registry_round_trip_and_missing_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "https://x/b", None, None), ("a", "https://x/a", "d", "backend")], source.REGISTRY)
    with pytest.raises(ValueError):
        source.write_registry(rows, str(tmp_path / "r"), default=None)
    source.write_registry(rows, str(tmp_path / "r"), default="a", comment="c")
    text = next((tmp_path / "r").glob("part-*.txt")).read_text()
    assert json.loads(text)["default"] == "a" and json.loads(text)["_comment"] == "c" and list(json.loads(text)["repositories"]) == ["a", "b"]
    assert sorted(map(tuple, source.read_registry(spark, str(tmp_path / "r")).collect())) == [("a", "https://x/a", "d", "backend"), ("b", "https://x/b", "", "generic")]
    assert source.read_registry(spark, str(tmp_path / "none")).count() == 0 and source.read_skip_list(spark, str(tmp_path / "none")).count() == 0


def test_registry_and_skip_list_have_an_entry_a_line(spark, tmp_path):
    names = ["a", 'q"uote', "back\\slash", "new\nline", "é", ",x", *map(str, range(50))]
    rows = spark.createDataFrame([(n, f"https://x/{n}", "{d}", None) for n in names], source.REGISTRY)
    source.write_registry(rows, str(tmp_path / "r"), default="a", notes={"_c": "{no entry"})
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*.txt")))
    assert len(text.splitlines()) == len(names) + 3 and set(json.loads(text)["repositories"]) == {*names, "_c"}
    want = sorted((n, f"https://x/{n}", "{d}", "generic") for n in names)
    assert sorted(map(tuple, source.read_registry(spark, str(tmp_path / "r")).collect())) == want
    (tmp_path / "one.json").write_text(json.dumps(json.loads(text.replace("{no", "no")), indent=2))
    assert sorted(map(tuple, source.read_registry(spark, str(tmp_path / "one.json")).collect())) == want
    source.write_skip_list(spark.createDataFrame([(n, f"why {n}") for n in names], "repo_name string, reason string"), str(tmp_path / "s"))
    assert sorted(map(tuple, source.read_skip_list(spark, str(tmp_path / "s")).collect())) == sorted((n, f"why {n}") for n in names)
    with pytest.raises(ValueError):
        source.write_registry(rows.unionByName(rows), str(tmp_path / "twice"), default="")
    source.write_registry(rows.limit(0), str(tmp_path / "none"), default="")
    assert source.read_registry(spark, str(tmp_path / "none")).count() == 0


def test_sync_precedence(spark):
    now = 1_700_000_000
    listing = spark.createDataFrame([("known", True, now), ("skipped", True, now), ("arch", True, 0), ("old", False, now - 366 * 86_400), ("new", False, now - 364 * 86_400), ("unknown", None, None)], "repo_name string, archived boolean, at long").withColumn("last_commit_at", F.timestamp_seconds("at"))
    got = registry.sync_candidates(listing, spark.createDataFrame([("known",)], "repo_name string"), spark.createDataFrame([("skipped", "x")], "repo_name string, reason string"), now)
    assert {r["repo_name"]: r["decision"] for r in got.collect()} == {"arch": "archived", "old": "no commits in past 1 year", "new": "active", "unknown": "active"}


def test_files_that_are_not_utf8_are_left_out(spark, tmp_path):
    (tmp_path / "repo" / "d").mkdir(parents=True)
    (tmp_path / "repo" / "d" / "a.txt").write_text("ä")
    (tmp_path / "repo" / "b.txt").write_bytes(b"\xff\xfe")
    assert [tuple(r) for r in file_source.read_repo_files(spark, str(tmp_path)).collect()] == [("repo", "d/a.txt", "ä", 2)]


def test_scans(spark):
    rows = [("r", "src/a.py", "import openai\nc = OpenAI(key)\nx = os.environ['OPENAI_API_KEY']"), ("r", "arch-docs/b.md", "import openai"), ("r", "c.txt", "mail a.b@c.de twice a.b@c.de, token = 'abcdefgh1234'")]
    table = spark.createDataFrame(rows, "repo_name string, path string, content string")
    assert {(r["path"], r["kind"]) for r in scans.scan_llm_usage(table).collect()} == {("src/a.py", k) for k in ("import", "client", "variable")}
    assert [(r["kind"], r["matched"], r["count"]) for r in scans.scan_personal_data(table).collect()] == [("email", "a.b@c.de", 2)]
    assert [r["matched"] for r in scans.scan_secrets(table).collect()] == ["toke***"]


@pytest.mark.parametrize("text, want", [
    ("4111 1111 1111 1111", {"card"}), ("4111 1111 1111 1112", set()), ("4111-1111-1111-1111", {"card"}), ("378282246310005", {"card"}), ("0000000000000000", set()), ("10.0.0.255", {"ip"}), ("999.999.999.999", set()), ("1.2.3", set()),
    ("555-123-4567", {"phone"}), ("(555) 123-4567", {"phone"}), ("555.123.4567", {"phone"}), ("+44 20 7946 0958", {"phone"}), ("+1 (555) 123-4567", {"phone"}), ("123-45-6789", {"ssn"}), ("000-45-6789", set()), ("123-00-6789", set()), ("900-45-6789", set()),
    ('password = "aaaaaaaaaaaa"', set()), ('password = "k3Jx9qLm2vTz"', {"assignment"}), ("ghp_aaaaaaaaaaaaaaaaaaaaaaaa", set()), ("ghp_k3Jx9qLm2vTzR8wY", {"token"}), ('secret = "ÄÖÜßäöü日"', {"assignment"}),
])
def test_look_alikes(spark, text, want):
    table = spark.createDataFrame([("r", "p", f"x {text} y")], "repo_name string, path string, content string")
    assert {r["kind"] for rows in (scans.scan_personal_data(table), scans.scan_secrets(table)) for r in rows.collect()} == want


def test_failures_become_rows(spark):
    def analyzer(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    tasks = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, ""), (4, None)], "id int, prompt string")
    rows = {r["id"]: (r["status"], r["content"], r["error"]) for r in analyze.analyze_tasks(tasks, analyzer).collect()}
    assert rows == {1: ("success", "OK", None), 2: ("failed", None, "ValueError: no"), 3: ("failed", None, "empty prompt"), 4: ("failed", None, "empty prompt")}
    batches = spark.createDataFrame([("r", 1, "two"), ("r", 0, "one"), ("r", 2, "bad")], "repo_name string, batch_index int, prompt string")
    assert analyze.map_reduce_analyze(batches, analyzer, lambda p: p).first()["content"] == "## Batch 1\n\nONE\n\n## Batch 2\n\nTWO\n\n## Batch 3 failed"


def test_each_prompt_is_called_once(spark, tmp_path):
    """A task that dies half way, another run and repeated prompts: every call is made once, failures again in a later run."""
    calls, log = tmp_path / "calls", f"file://{tmp_path}/log"
    calls.mkdir()

    def analyzer(prompt):
        if prompt == "p20" and (calls / "dies").exists():
            raise SystemExit(1)  # takes the worker with it
        (calls / f"{prompt}-{len(list(calls.glob(prompt + '-*')))}").touch()
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    tasks = spark.createDataFrame([(i, f"p{i % 25}") for i in range(100)] + [(100, "bad"), (101, " "), (102, None)], "id int, prompt string").repartition(4)
    (calls / "dies").touch()
    with pytest.raises(Exception):
        analyze.analyze_once(tasks, log, analyzer, every=1).collect()
    (calls / "dies").unlink()
    for _ in range(2):
        rows = {r["id"]: (r["status"], r["content"], r["error"]) for r in analyze.analyze_once(tasks, log, analyzer, every=1).collect()}
        assert len(rows) == 103 and rows[7] == ("success", "P7", None) and rows[100] == ("failed", None, "ValueError: no") and rows[101] == rows[102] == ("failed", None, "empty prompt")
    made = [p.name.split("-")[0] for p in calls.iterdir()]
    assert sorted(set(made)) == sorted({f"p{i}" for i in range(25)} | {"bad"}) and all(made.count(f"p{i}") == 1 for i in range(25)) and made.count("bad") in (2, 3)


@pytest.mark.parametrize("budget, levels", [(10_000, 1), (100, 5), (60, 7)])
def test_reduction_tree(spark, budget, levels):
    """No prompt above the budget, every text in some prompt, in order, up to one answer a repository."""

    def analyzer(prompt):
        assert len(prompt) <= budget
        if "bad" in prompt:
            raise ValueError("no")
        numbers = prompt.replace("..", " ").split()
        assert [int(n) for n in numbers] == sorted(int(n) for n in numbers)
        return f"{numbers[0]}..{numbers[-1]}"

    parts = spark.createDataFrame([("r", i, f"{1000 + i}") for i in range(300)] + [("long", 0, "7 " * 3000), ("one", 0, "5"), ("fails", 0, "bad")], "repo_name string, at int, text string").repartition(5)
    got = {r["repo_name"]: r for r in analyze.reduce_tree(parts, analyzer, budget).collect()}
    assert got["r"]["content"] == "1000..1299" and got["r"]["levels"] <= levels and (got["r"]["levels"] >= 3 or budget > 100)
    assert got["long"]["content"] == "7..7" and got["one"]["levels"] == 1 and got["fails"]["status"] == "failed" and got["fails"]["error"] == "ValueError: no"
    with pytest.raises(ValueError, match="too long"):
        analyze.reduce_tree(spark.createDataFrame([("r", i, "x" * 30) for i in range(40)], "repo_name string, at int, text string"), lambda p: p, 70).collect()


def test_validation(spark):
    rows = spark.createDataFrame([("r", " ", "abc", -1.0, 400), ("ok", "main", "abcdefg", 1.0, 90)], "repo_name string, branch_name string, commit_sha string, analysis_timestamp double, ttl_days int")
    assert {(r["repo_name"], r["column"]) for r in h.validate_rows(rows).collect()} == {("r", c) for c in ("branch_name", "commit_sha", "analysis_timestamp", "ttl_days")}


@pytest.mark.parametrize("text", ["tool = 1", "project = 1", "[project]\ndependencies = 3\n[tool]\npoetry = 'x'", "= broken", "", "[" * 3000])
def test_odd_pyproject_files_never_fail_the_job(spark, text):
    rows = spark.createDataFrame([("k", text)], "k string, t string").select("k", F.explode(manifests.pyproject_sections(F.col("t"))).alias("p")).collect()
    assert all(r["p"]["dep_type"] == "production" for r in rows)
    if text in ("tool = 1",):
        assert rows == [] or rows[0]["p"]["content"] == text


@pytest.mark.parametrize("text", ["[1]", "3", '{"dependencies": ' + '{"a":' * 3000 + "1" + "}" * 3001, '{"dependencies": 7}', "null", '"x"'])
def test_odd_package_files_never_fail_the_job(spark, text):
    spark.createDataFrame([("k", text)], "k string, t string").select("k", F.explode(manifests.package_json_sections(F.col("t"))).alias("p")).collect()


def test_stream_of_three_arrivals(spark, tmp_path):
    """A commit, another, and the first again are three changes, each against the one before; repeats and late rows are none."""
    from shelfmark.streaming import decisions

    past, arrivals, latest, decided, checkpoint = (f"file://{tmp_path}/{n}" for n in ("history", "arrivals", "latest", "decisions", "checkpoint"))
    spark.createDataFrame([("other", 5, "investigation", "old", "main")], f"{h.KEY} string, {h.AT} long, {h.KIND} string, {h.COMMIT} string, {h.BRANCH} string").write.parquet(f"{past}/batch=-1")
    shape = "repo_name string, commit_sha string, branch_name string, seconds long"
    for rows in ([("r", "zz", "main", 100)], [("r", "aa", "main", 200), ("r", "zz", "main", 100)], [("r", "zz", "main", 300), ("other", "old", "main", 300)], [("r", "late", "main", 250), ("other", "new", "main", 400)]):
        frame = spark.createDataFrame(rows, shape).withColumn("event_time", F.timestamp_seconds("seconds")).drop("seconds")
        frame.write.mode("append").parquet(arrivals)
        decisions.stream_decisions(spark.readStream.schema(frame.schema).parquet(arrivals), past, latest, decided, checkpoint).awaitTermination()
    got = {(r["repo_name"], r["commit_sha"], r["needs_investigation"], r["reason"], r["last_timestamp"]) for r in spark.read.parquet(decided).collect()}
    assert got == {
        ("r", "zz", True, "No previous investigation found", None), ("r", "aa", True, "New commits detected (current: aa, last: zz)", 100), ("r", "zz", True, "New commits detected (current: zz, last: aa)", 200),
        ("other", "old", False, "No changes since last investigation on 1970-01-01T00:00:05+00:00", 5), ("other", "new", True, "New commits detected (current: new, last: old)", 5),
    }
    stamps = sorted((r[h.AT], r[h.COMMIT]) for r in spark.read.parquet(past).collect())
    assert stamps == [(5, "old"), (100, "zz"), (200, "aa"), (300, "zz"), (400, "new")]
    latest_rows = {(r[h.KEY], r[h.COMMIT], r[h.AT]) for r in spark.read.parquet(latest).collect()}
    assert latest_rows == {("r", "zz", 300), ("other", "new", 400)}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    """Of a portfolio of 300 only the bucket of the repository that came is written; a batch that runs again takes its decisions as they were."""
    from shelfmark.streaming import decisions

    past, arrivals, latest, decided = (f"file://{tmp_path}/{n}" for n in ("history", "arrivals", "latest", "decisions"))
    spark.createDataFrame([(f"r{i}", 5, "investigation", "old", "main") for i in range(300)], f"{h.KEY} string, {h.AT} long, {h.KIND} string, {h.COMMIT} string, {h.BRANCH} string").write.parquet(f"{past}/batch=-1")

    def arrive(commit, seconds, checkpoint):
        frame = spark.createDataFrame([("r7", commit, "main", seconds)], "repo_name string, commit_sha string, branch_name string, seconds long").withColumn("event_time", F.timestamp_seconds("seconds")).drop("seconds")
        frame.write.mode("append").parquet(arrivals)
        decisions.stream_decisions(spark.readStream.schema(frame.schema).parquet(arrivals), past, latest, decided, f"file://{tmp_path}/{checkpoint}", buckets=16).awaitTermination()

    arrive("a", 10, "one")
    files = lambda: {p for p in (tmp_path / "latest").glob("bucket=*/*.parquet")}
    before = files()
    arrive("b", 20, "one")
    assert len({p.parent.name for p in before}) == 16 and len({p.parent.name for p in before ^ files()}) == 1
    first = sorted(map(str, spark.read.parquet(decided).collect()))
    # A lost checkpoint runs both arrivals again as batch 0: its decisions stand, and no state is lost or taken back.
    decisions.stream_decisions(spark.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals), past, latest, decided, f"file://{tmp_path}/two", buckets=16).awaitTermination()
    assert sorted(map(str, spark.read.parquet(decided).collect())) == first
    assert spark.read.parquet(latest).count() == 300


def test_more_rules(spark):
    rows = spark.createDataFrame([("a", " ", 1.5, True, None, 3, 2, 1, 1), ("b", "1", 0.0, True, "why", 3, 1, 1, 1), ("c", "1", None, False, None, 3, 4, 0, 0)], "repo_name string, prompt_version string, temperature double, cached boolean, cache_reason string, total int, successful int, failed int, skipped int")
    found = {(r["repo_name"], r["column"]) for r in h.validate_rows(rows).collect()}
    assert found == {("a", "prompt_version"), ("a", "temperature"), ("a", "cached"), ("a", "total"), ("c", "successful"), ("c", "total")}


def test_documents_are_files_of_their_own_name(spark, tmp_path):
    rows = spark.createDataFrame([("one", "text\nof one"), ("group/two", "two"), ("", "x"), ("none", "")], "repo_name string, document string")
    listed = {r["file_name"] for r in documents.write_documents(rows, str(tmp_path / "out")).collect()}
    assert listed == {"one.arch.md", "group_two.arch.md"} and {p.name for p in (tmp_path / "out").iterdir()} == listed
    assert (tmp_path / "out" / "one.arch.md").read_text() == "text\nof one"
