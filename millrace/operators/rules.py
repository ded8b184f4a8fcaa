"""Filter rules for command output: a table of rules, first match wins, inline tests and trust by content hash."""

from __future__ import annotations

import hashlib
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in rules, in the order in which they are tried.
RULES = tomllib.loads(r'''
[[filters]]
name = "terraform-plan"
match_command = '^(terraform|tofu)\s+plan\b'
strip_ansi = true
keep_lines_matching = ['^Plan:', '^No changes', '^\s*[~+\-]', '^Error:', '^Warning:']
max_lines = 120
on_empty = "terraform plan: no relevant changes"

[[filters]]
name = "docker-ps"
match_command = '^(docker|podman)\s+ps\b'
strip_ansi = true
max_lines = 80

[[filters]]
name = "systemctl-status"
match_command = '^systemctl\s+status\b'
strip_ansi = true
keep_lines_matching = ['Loaded:', 'Active:', 'Main PID:', '^\s*Process:', '^\s*[A-Z][a-z]{2} ', 'error|failed|warning']
max_lines = 80

[[filters]]
name = "package-install"
match_command = '^(npm|pnpm|yarn)\s+(install|i|add)\b'
strip_ansi = true
strip_lines_matching = ['^\s*$', '^Progress:', '^\s*[\|/\-\\]$', '^\s*resolved ', '^\s*reused ', '^\s*downloaded ']
keep_lines_matching = ['added ', 'removed ', 'changed ', 'audited ', 'vulnerab', 'deprecated', 'WARN', 'ERR!', 'error', 'failed']
max_lines = 120
on_empty = "package install: completed"

[[filters]]
name = "brew-install"
match_command = '^brew\s+(install|upgrade)\b'
strip_ansi = true
strip_lines_matching = ['^==> Downloading', '^==> Pouring', '^Already downloaded:', '^\s*$']
keep_lines_matching = ['^==>', 'Error:', 'Warning:', 'installed', 'upgraded', 'Pouring']
max_lines = 120
on_empty = "brew: completed"

[[filters]]
name = "make"
match_command = '^(g?make|make)\b'
strip_ansi = true
keep_lines_matching = ['error', 'Error', 'warning', 'Warning', 'failed', 'FAILED', 'Entering directory', 'Leaving directory']
max_lines = 160
on_empty = "make: completed"

[[filters]]
name = "gh"
match_command = '^gh\s+(pr|issue|run|workflow)\b'
strip_ansi = true
strip_lines_matching = ['^\s*$']
max_lines = 120

[[filters]]
name = "go-test"
match_command = '^go\s+test\b'
strip_ansi = true
keep_lines_matching = ['^--- FAIL:', '^FAIL', '^ok\s', '^\?', 'panic:', 'Error Trace:', 'error']
max_lines = 160
on_empty = "go test: passed"

[[filters]]
name = "dotnet"
match_command = '^dotnet\s+(test|build)\b'
strip_ansi = true
keep_lines_matching = ['FAILED', 'Failed', 'Error', 'error', 'Warning', 'warning', 'Passed!', 'Total tests:', 'Build FAILED', 'Build succeeded']
max_lines = 180
on_empty = "dotnet: completed"

[[filters]]
name = "jvm-build"
match_command = '^(mvn|gradle|\.\/gradlew|gradlew)(\s|$)'
strip_ansi = true
keep_lines_matching = ['\[ERROR\]', '\[WARNING\]', 'BUILD SUCCESS', 'BUILD FAILURE', 'FAILURE:', 'FAILED', 'Failed', 'error', 'warning', 'Tests run:']
max_lines = 180
on_empty = "jvm build: completed"

[[filters]]
name = "python-package"
match_command = '^(pip|pipx|uv)\s+(install|sync|add|remove|pip)\b'
strip_ansi = true
strip_lines_matching = ['^\s*$', '^Collecting ', '^Downloading ', '^Installing collected packages:', '^Using cached ']
keep_lines_matching = ['Successfully installed', 'Successfully uninstalled', 'Resolved ', 'Installed ', 'Audited ', 'WARNING:', 'ERROR:', 'error', 'failed']
max_lines = 140
on_empty = "python package: completed"

[[filters]]
name = "python-lint"
match_command = '^(ruff|mypy)\b'
strip_ansi = true
keep_lines_matching = ['^[^\s].*:[0-9]+', '^error:', '^warning:', 'Found ', 'Success:']
max_lines = 180
on_empty = "python lint: clean"

[[filters]]
name = "js-quality"
match_command = '^(eslint|vitest|playwright|next)\b|^(npm|pnpm|yarn)\s+(run\s+)?(lint|test|build)\b'
strip_ansi = true
keep_lines_matching = ['FAIL', 'failed', 'Failed', 'Error', 'error', 'Warning', 'warning', '✓', 'passed', 'Tests', 'Duration', 'Compiled']
max_lines = 180
on_empty = "js quality: completed"

[[filters]]
name = "docker-logs"
match_command = '^(docker|podman)\s+logs\b'
strip_ansi = true
keep_lines_matching = ['error', 'ERROR', 'warn', 'WARN', 'failed', 'FAILED', 'panic', 'Exception']
tail_lines = 160
on_empty = "container logs: no warnings or errors"

[[filters]]
name = "kubectl"
match_command = '^kubectl\s+(get|describe|logs|events)\b'
strip_ansi = true
keep_lines_matching = ['^NAME\s', 'Error', 'Warning', 'Failed', 'BackOff', 'CrashLoop', 'Pending', 'Running', 'Ready', 'Events:']
max_lines = 180
on_empty = "kubectl: no relevant warnings"

[[filters]]
name = "aws"
match_command = '^aws\s+'
strip_ansi = true
keep_lines_matching = ['Error', 'ERROR', 'Failed', 'FAILED', 'Arn', 'Name', 'State', 'Status', 'FunctionName', 'InstanceId', 'StackName']
max_lines = 180
''')["filters"]
ROUTES = [
    (r"^git status\b", "git_status"),
    (r"^git (diff|show)\b", "diff_summary"),
    (r"^git log\b", "git_log"),
    (r"^cargo test\b", "cargo_test"),
    (r"^cargo (check|build|clippy)\b", "cargo_diagnostics"),
    (r"^tsc\b", "tsc"),
    (r"^pytest\b", "pytest"),
    (r"^(npm|pnpm|yarn) (test|run)\b", "js_test"),
    (r"^(rg|grep)\b", "search_results"),
    (r"^(find|fd|ls|dir|tree)\b", "listing"),
]
KEYS = {"name", "match_command", "strip_ansi", "replace", "strip_lines_matching", "keep_lines_matching", "truncate_lines_at", "head_lines", "tail_lines", "max_lines", "on_empty"}


def load(content: str) -> dict:
    """The rules and tests of a rule file; unknown keys are an error."""
    found = tomllib.loads(content)
    for rule in found.get("filters", []):
        if unknown := set(rule) - KEYS:
            raise ValueError(f"unknown keys {sorted(unknown)} in rule {rule.get('name')}")
    return found


def filter_of(command: Column, rules: list[dict] = RULES) -> Column:
    """The rule (toml:NAME) or route that a command's output goes through; the first match wins.

    One CASE over constant patterns: each is compiled once per task, and no join is needed."""
    out = None
    for pattern, name in [(r["match_command"], "toml:" + r["name"]) for r in rules] + ROUTES:
        out = F.when(command.rlike(pattern), name) if out is None else out.when(command.rlike(pattern), name)
    return out.otherwise("generic")


def verify(spark, content: str) -> DataFrame:
    """name, filter, passed: the inline tests of a rule file, run on Spark."""
    from .lines import apply_rule

    file = load(content)
    rules, tests = {r["name"]: r for r in file.get("filters", [])}, list(enumerate(file.get("tests", [])))
    # One job: a test is a document, and a rule takes all of its tests at once.
    lines = spark.createDataFrame([(k, i, t["filter"], c) for k, t in tests for i, c in enumerate(t["input"].splitlines())], "doc_id long, pos long, filter string, content string")
    used = [apply_rule(lines.filter(F.col("filter") == name), rule).select("doc_id", "pos", "content") for name, rule in rules.items() if any(t["filter"] == name for _, t in tests)]
    got: dict[int, list[str]] = {}
    for r in reduce(DataFrame.unionByName, used).orderBy("doc_id", "pos").collect() if used else []:
        got.setdefault(r["doc_id"], []).append(r["content"])
    out = []
    for k, t in tests:
        rule = rules.get(t["filter"])
        text = "".join(f"{line}\n" for line in got[k]) if k in got else (rule or {}).get("on_empty", "")
        out.append((t["name"], t["filter"], rule is not None and text == t["expected"]))
    return spark.createDataFrame(out, "name string, filter string, passed boolean")


def content_hash(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()


def trust(files: DataFrame, trusted: DataFrame) -> DataFrame:
    """path, status: untrusted, trusted-current or trusted-stale. files: path, content; trusted: path, hash."""
    j = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("now")).join(trusted, "path", "left")
    return j.select("path", F.when(F.col("hash").isNull(), "untrusted").when(F.col("hash") == F.col("now"), "trusted-current").otherwise("trusted-stale").alias("status"))
