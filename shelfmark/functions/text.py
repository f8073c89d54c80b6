"""Column functions: names, keys, URLs, prompt texts and sizes. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and estimates that results depend on.
CHARS_PER_TOKEN = 3.5
MAX_INPUT_TOKENS = 180_000
BATCH_TOKENS = 100_000
BATCHING_FROM = 50_000
DAY_SECONDS = 86_400
KEPT_TEMPLATE_TOKENS = 2_000
LEAST_STRUCTURE_CHARS = 1_000
LEAST_TEMPLATE_CHARS = 10_000
NO_DEPENDENCIES = "No dependency files found!"
# A prompt with one of these words is given the dependency files.
DEPENDENCY_WORDS = ("dependencies", "packages", "requirements", "libraries", "npm", "pip", "gem", "cargo", "maven", "gradle", "nuget", "pyproject", "package.json", "gemfile", "{repo_deps}")


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


# ---- names and keys ----------------------------------------------------------


def repo_name_from_url(location: Column) -> Column:
    """Last part of a URL or path (after the last colon for ``git@``), without ``.git``, unsafe characters as ``_``."""
    bare = F.regexp_replace(location, "/+$", "")
    last = F.when(location.startswith("git@"), F.regexp_replace(F.element_at(F.split(location, ":"), -1), "/+$", "")).otherwise(F.element_at(F.split(bare, "/"), -1))
    return F.regexp_replace(F.regexp_replace(last, r"\.git$", ""), r"(?U)[^\w\-.]", "_")


def safe_key(name: Column) -> Column:
    """A name usable as a file name."""
    bare = F.regexp_replace(name, r"^(?:https://|http://|git@|ssh://)", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r'[/\\:*?"<>|@#]', "_"), "_+", "_"), r"^[_.]+|[_.]+$", "")


def result_key(repo: Column, step: Column, commit: Column, version: Column) -> Column:
    return F.concat(repo, F.lit("_"), step, F.lit("_"), commit, F.lit("_v"), version)


def parse_result_key(key: Column) -> dict[str, Column]:
    """Split from the right, so a step with ``_`` in its name does not come back whole."""
    pattern = r"(?s)^(.*)_([^_]*)_([^_]*)_v(.*)$"
    return {name: F.regexp_extract(key, pattern, i) for i, name in enumerate(("repo_name", "step_name", "commit_sha", "prompt_version"), 1)}


def history_file_key(repo: Column, kind: Column) -> Column:
    return F.concat(safe_key(repo), F.lit("_"), kind)


def parse_history_file_key(key: Column) -> dict[str, Column]:
    return {"repo_name": F.regexp_extract(key, r"(?s)^(.*)_([^_]*)$", 1), "analysis_type": F.regexp_extract(key, r"(?s)^(.*)_([^_]*)$", 2)}


def bracket_name(document: Column) -> Column:
    """The first ``[[name]]`` of a document."""
    name = F.trim(F.regexp_extract(document, r"(?s)\[\[(.*?)\]\]", 1))
    return F.when(document.isNull() | (name == ""), "unknown_repo").otherwise(F.regexp_replace(name, r"(?U)[^\w\-.]", "_"))


def section_heading(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def branch_label(branch: Column, commit: Column) -> Column:
    """A detached head is named by its commit."""
    return F.when(branch.isNull() | (branch == "") | (branch == "HEAD"), F.concat(F.lit("detached-"), F.substring(commit, 1, 8))).otherwise(branch)


# ---- URLs --------------------------------------------------------------------


def _host(url: Column) -> Column:
    return F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit(""))


def sanitize_url(url: Column, token: str | None = None) -> Column:
    """Without user info, which is said; a known token is masked."""
    shown = F.concat(F.regexp_replace(url, r"^(https?://)[^/?#]*@", "$1"), F.lit(" (authentication hidden)"))
    masked = F.replace(url, F.lit(token), F.lit("***HIDDEN***")) if token else url
    return F.when(~url.rlike("^https?://"), url).when(url.rlike(r"^https?://[^/?#]*@"), shown).otherwise(masked)


def url_provider(url: Column) -> Column:
    host = _host(url)
    return (
        F.when(url.contains("git-codecommit") & url.contains("amazonaws.com"), "codecommit")
        .when(url.contains("github.com"), "github")
        .when(url.contains("gitlab.com") | host.contains("gitlab."), "gitlab")
        .when(url.contains("bitbucket.org") | host.contains("bitbucket."), "bitbucket")
        .when(url.contains("dev.azure.com") | url.contains("visualstudio.com"), "azure_devops")
    )


def _is_full_repo(base: Column) -> Column:
    after_scheme = F.regexp_replace(base, r"^.*?://", "")
    path = F.regexp_extract(after_scheme, r"^[^/]*/(.*)$", 1)
    return F.size(F.filter(F.split(path, "/"), lambda part: part != "")) >= 2


def hub_repo_url(base_url: Column, hub_name: Column) -> Column:
    base = F.regexp_replace(base_url, "/+$", "")
    return F.when(_is_full_repo(base), F.when(base.endswith(".git"), base).otherwise(F.concat(base, F.lit(".git")))).otherwise(F.concat(base, F.lit("/"), hub_name, F.lit(".git")))


def hub_web_url(base_url: Column, hub_name: Column) -> Column:
    base = F.regexp_replace(base_url, "/+$", "")
    return F.when(_is_full_repo(base), F.regexp_replace(F.regexp_replace(base, r"\.git$", ""), "/+$", "")).otherwise(F.concat(base, F.lit("/"), hub_name))


# Words in names, descriptions and languages that tell the kind of a repository.
MOBILE_NAMES = ("mobile", "ios", "android", "react-native")
INFRA_NAMES = ("terraform", "infra", "helm", "k8s", "kubernetes", "ansible", "cloudformation")
LIBRARY_NAMES = ("sdk", "lib", "library", "client", "api-client", "package")
LIBRARY_TEXTS = ("sdk", "library", "package", "client library")
FRONTEND_NAMES = ("frontend", "ui", "web", "portal", "dashboard", "admin")
FRONTEND_FRAMEWORKS = ("react", "vue", "angular")
SCRIPT_BACKEND_NAMES = ("service", "api", "server", "backend", "worker")
BACKEND_NAMES = ("service", "api", "server", "backend", "worker", "processor")
BACKEND_LANGUAGES = ("python", "ruby", "go", "java", "c#", "rust")
SCRIPT_LANGUAGES = ("javascript", "typescript")


def detect_repo_type(name: Column, description: Column, language: Column) -> Column:
    """The first rule that fits decides; names are tested for substrings."""
    n, d, lang = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, description, language))
    script = lang.isin(*SCRIPT_LANGUAGES)
    return (
        F.when(_has_any(n, MOBILE_NAMES) | (lang == "swift"), "mobile")
        .when(_has_any(n, INFRA_NAMES) | (lang == "hcl"), "infra-as-code")
        .when(_has_any(n, LIBRARY_NAMES) | _has_any(d, LIBRARY_TEXTS), "libraries")
        .when(script & (_has_any(n, FRONTEND_NAMES) | (~_has_any(n, SCRIPT_BACKEND_NAMES) & _has_any(n, FRONTEND_FRAMEWORKS))), "frontend")
        .when(lang == "vue", "frontend")
        .when(lang.isin(*BACKEND_LANGUAGES) | _has_any(n, BACKEND_NAMES), "backend")
        .otherwise("generic")
    )


# ---- prompts -----------------------------------------------------------------


def prompt_version(content: Column, default: str | None = "1") -> Column:
    """The version in the first line; ``default`` (null: an error value of the caller's) where there is none."""
    first = F.substring_index(content, "\n", 1)
    value = F.trim(F.get(F.split(first, "="), F.lit(1)))
    return F.when(first.startswith("version=") & (value != ""), value).otherwise(F.lit(default))


def clean_prompt(content: Column) -> Column:
    """Without a version line and the blank lines below it."""
    return F.regexp_replace(content, r"^version[^\n]*(?:\n|\z)(?:[^\S\n]*(?:\n|\z))*", "")


def estimate_tokens(text: Column) -> Column:
    return F.coalesce(F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("long")


def needs_batching(formatted: Column, above: int = BATCHING_FROM) -> Column:
    return estimate_tokens(formatted) > above


def needs_dependencies(prompt: Column) -> Column:
    return _has_any(F.lower(prompt), DEPENDENCY_WORDS)


def with_dependencies(prompt: Column, dependencies: Column) -> Column:
    """``{repo_deps}`` replaced where the prompt asks for dependencies; a fixed sentence where there are none."""
    have = F.coalesce(dependencies, F.lit("")) != ""
    return F.when(have & needs_dependencies(prompt), F.replace(prompt, F.lit("{repo_deps}"), dependencies)).when(have, prompt).otherwise(F.replace(prompt, F.lit("{repo_deps}"), F.lit(NO_DEPENDENCIES)))


# The notices that stand where a prompt was cut, and the heading of earlier results.
STRUCTURE_CUT = "\n\n... [TRUNCATED: showing first "
TEMPLATE_CUT = "\n\n... [TEMPLATE TRUNCATED: showing first "
HARD_CUT = "\n\n... [TRUNCATED] ..."
CONTEXT_HEADING = "\n\n## Previous Analysis Context\n\n"


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fit_prompt(template: Column, structure: Column, context: Column, limit: int = MAX_INPUT_TOKENS) -> dict[str, Column]:
    """template, structure and context cut to ``limit`` tokens: the structure first, then the context, the template last."""
    t, s = estimate_tokens(template), estimate_tokens(structure)
    has_context = F.coalesce(context, F.lit("")) != ""
    c = F.when(has_context, estimate_tokens(context)).otherwise(F.lit(0))
    excess = t + s + c - F.lit(limit)
    fits, by_structure = excess <= 0, s > excess
    by_context = has_context & (excess - c <= 0)
    room = F.floor((s - excess) * CHARS_PER_TOKEN).cast("int")
    noted = F.concat(
        F.substring(structure, F.lit(1), room), F.lit(STRUCTURE_CUT), _thousands(room), F.lit(" of "), _thousands(F.length(structure)),
        F.lit(f" characters to fit within {limit:,} token limit] ..."),
    )
    left = F.greatest(F.floor(F.greatest(F.lit(limit) - t, F.lit(0)) * CHARS_PER_TOKEN), F.lit(LEAST_STRUCTURE_CHARS)).cast("int")
    hard = F.concat(F.substring(structure, F.lit(1), left), F.lit(HARD_CUT))
    kept = max(int((limit - KEPT_TEMPLATE_TOKENS) * CHARS_PER_TOKEN), LEAST_TEMPLATE_CHARS)
    short = F.concat(
        F.substring(template, 1, kept), F.lit(f"{TEMPLATE_CUT}{kept:,} of "), _thousands(F.floor(t * CHARS_PER_TOKEN)),
        F.lit(f" characters to fit within {limit:,} token limit] ..."),
    )
    return {
        "template": F.when(fits | by_structure | by_context | (t <= limit), template).otherwise(short),
        "structure": F.when(fits, structure).when(by_structure, noted).when(by_context, structure).otherwise(hard),
        "context": F.when(fits | by_structure, context),
    }


def render_prompt(template: Column, structure: Column, context: Column) -> Column:
    before = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_HEADING), context, F.lit("\n\n"))).otherwise("")
    return F.replace(F.replace(template, F.lit("{repo_structure}"), structure), F.lit("{previous_context}"), before)


def render_batch_prompt(template: Column, batch_index: Column, total_batches: Column, languages: Column) -> Column:
    """Batch numbers are shown from 1."""
    out = F.replace(template, F.lit("{batch_index}"), (batch_index + 1).cast("string"))
    return F.replace(F.replace(out, F.lit("{total_batches}"), total_batches.cast("string")), F.lit("{batch_languages}"), languages)


# ---- sizes and times ---------------------------------------------------------


def human_size(n_bytes: Column) -> Column:
    """One decimal, halves to even, in steps of 1024 up to TB."""
    out, value = None, n_bytes.cast("double")
    shown = lambda x, unit: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        test = value < 1024.0 ** (power + 1)
        out = F.when(test, shown(value / 1024.0**power, unit)) if out is None else out.when(test, shown(value / 1024.0**power, unit))
    return out.otherwise(shown(value / 1024.0**4, "TB"))


def ttl_at(at: Column, days: Column | None = None, minutes: Column | None = None) -> Column:
    """Seconds since 1970 at which a row expires."""
    return at + (days * DAY_SECONDS if days is not None else minutes * 60)


def not_expired(ttl: Column, now: Column) -> Column:
    """No or zero time to live never expires; the last second still counts."""
    return ~F.coalesce((ttl > 0) & (now > ttl), F.lit(False))
