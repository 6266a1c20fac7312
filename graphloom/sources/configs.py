"""Manifests, CI pipelines, containers and infrastructure files as node and edge rows."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML files are then left out
    yaml = None

NODES = "rel_path string, kind string, label string, name string, detail string"
EDGES = "rel_path string, type string, source string, target string"
Rows = tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]


def _documents(text: str) -> list:
    if yaml is None:
        return []
    try:
        return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    except yaml.YAMLError:
        return []


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def manifest(name: str, text: str) -> list[str]:
    """The packages that a manifest names."""
    try:
        if name in ("package.json", "composer.json"):
            d = json.loads(text)
            return sorted({k for part in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev") for k in (d.get(part) or {})})
        if name in ("Cargo.toml", "pyproject.toml"):
            d = tomllib.loads(text)
            listed = [re.split(r"[\s<>=!~\[;(]", x)[0] for x in d.get("project", {}).get("dependencies", [])]
            tables = [d.get("dependencies"), d.get("dev-dependencies"), d.get("tool", {}).get("poetry", {}).get("dependencies")]
            return sorted({*listed, *(k for t in tables if t for k in t)})
    except (ValueError, AttributeError):
        return []
    if name == "pubspec.yaml":
        return sorted({k for d in _documents(text) for part in ("dependencies", "dev_dependencies") for k in (d.get(part) or {})})
    # How the other manifests name a package.
    patterns = {
        "go.mod": r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v\d", "pom.xml": r"<artifactId>\s*([^<\s]+)\s*</artifactId>", "build.gradle": r"(?:implementation|api|compile|testImplementation)\s*\(?\s*['\"]([^'\":]+:[^'\":]+)",
        "build.gradle.kts": r"(?:implementation|api|testImplementation)\s*\(\s*\"([^\":]+:[^\":]+)", "mix.exs": r"\{\s*:(\w+)\s*,", "setup.py": r"['\"]([A-Za-z][\w.-]*)\s*(?:[<>=!~][^'\"]*)?['\"]\s*[,\]]", "requirements.txt": r"(?m)^\s*([A-Za-z][\w.-]*)",
    }
    pattern = r"add_(?:development_|runtime_)?dependency\s*\(?\s*['\"]([^'\"]+)" if name.endswith(".gemspec") else patterns.get(name)
    return sorted(set(re.findall(pattern, text))) if pattern else []


def compile_commands(text: str) -> list[tuple[str, list[str], list[str], str | None]]:
    """(file, include folders, definitions, standard) of each entry of a compilation database."""
    out = []
    for e in json.loads(text):
        words = e.get("arguments") or e.get("command", "").split()
        take = lambda flag: [w[len(flag) :] or (words[i + 1] if i + 1 < len(words) else "") for i, w in enumerate(words) if w.startswith(flag)]  # noqa: B023, E731
        std = next((w.removeprefix("-std=") for w in words if w.startswith("-std=")), None)
        out.append((e.get("file", ""), take("-I"), take("-D"), std))
    return out


def gitlab(text: str) -> Rows:
    """Stages in order, jobs with stage, needs."""
    # Keys that are no jobs.
    reserved = {"stages", "variables", "include", "default", "image", "services", "before_script", "after_script", "cache", "workflow", "pages", "spec"}
    nodes, edges = [], []
    for d in _documents(text):
        stages = [str(s) for s in _list(d.get("stages"))]
        nodes += [("Stage", s, str(i)) for i, s in enumerate(stages)]
        edges += [("NEXT_STAGE", a, b) for a, b in zip(stages, stages[1:])]
        for name, job in d.items():
            if name in reserved or str(name).startswith(".") or not isinstance(job, dict):
                continue
            stage = str(job.get("stage", "test"))
            nodes.append(("Job", str(name), stage))
            edges.append(("BELONGS_TO_STAGE", str(name), stage))
            edges += [("DEPENDS_ON", str(name), str(n.get("job") if isinstance(n, dict) else n)) for n in _list(job.get("needs"))]
            edges += _deploys(str(name), job.get("before_script"), job.get("script"))
        for told in _list(d.get("include")):  # an included file or component stands as a job of its name
            place = told if isinstance(told, str) else str(told.get("component") or told.get("local") or "")
            job = re.sub(r"\.ya?ml$", "", place.rsplit("/", 1)[-1].split("@")[0])
            stage = str((told.get("inputs") or {}).get("stage", "")) if isinstance(told, dict) else ""
            if job:
                nodes.append(("Job", job, stage))
                edges += [("BELONGS_TO_STAGE", job, stage)] if stage else []
    return nodes, edges


def _jobs(jobs: dict, needs: str) -> Rows:
    nodes = [("Job", str(name), "") for name in jobs]
    return nodes, [("DEPENDS_ON", str(name), str(n)) for name, job in jobs.items() if isinstance(job, dict) for n in _list(job.get(needs))]


def github(text: str) -> Rows:
    """Jobs and needs of a workflow."""
    nodes, edges = [], []
    for d in _documents(text):
        triggers = d.get("on", d.get(True))
        names = sorted(triggers) if isinstance(triggers, dict) else _list(triggers)
        nodes.append(("Pipeline", str(d.get("name", "")), ",".join(map(str, names))))
        jobs = d.get("jobs") or {}
        n, e = _jobs(jobs, "needs")
        nodes, edges = nodes + n, edges + e
        for name, job in jobs.items():
            edges += _deploys(str(name), [step.get("run") for step in _list(job.get("steps")) if isinstance(step, dict) and step.get("run")]) if isinstance(job, dict) else []
    return nodes, edges


def circleci(text: str) -> Rows:
    """Jobs, and requirements of workflow entries."""
    nodes, edges = [], []
    for d in _documents(text):
        nodes += [("Job", str(j), "") for j in d.get("jobs") or {}]
        for name, job in (d.get("jobs") or {}).items():
            edges += _deploys(str(name), [step.get("run") for step in _list(job.get("steps")) if isinstance(step, dict) and step.get("run")]) if isinstance(job, dict) else []
        for flow in (d.get("workflows") or {}).values():
            for entry in _list(flow.get("jobs") if isinstance(flow, dict) else None):
                if isinstance(entry, dict):
                    edges += [("DEPENDS_ON", str(j), str(r)) for j, spec in entry.items() if isinstance(spec, dict) for r in _list(spec.get("requires"))]
    return nodes, edges


def azure(text: str) -> Rows:
    """Stages, their jobs and dependencies."""
    nodes, edges = [], []
    for d in _documents(text):
        trigger = d.get("trigger")
        names = trigger.get("branches", {}).get("include", []) if isinstance(trigger, dict) else _list(trigger)
        nodes.append(("Pipeline", str(d.get("name", "")), ",".join(map(str, names))))
        stages = [s for s in _list(d.get("stages")) if isinstance(s, dict)]
        names = [str(s.get("stage", "")) for s in stages]
        nodes += [("Stage", n, str(i)) for i, n in enumerate(names)]
        edges += [("NEXT_STAGE", a, b) for a, b in zip(names, names[1:])]
        for s in stages or [d]:
            edges += [("DEPENDS_ON", str(s.get("stage", "")), str(x)) for x in _list(s.get("dependsOn")) if "stage" in s]
            for job in _list(s.get("jobs")):
                if isinstance(job, dict) and (name := job.get("job") or job.get("deployment")):
                    nodes.append(("Job", str(name), str(s.get("stage", ""))))
                    edges += [("BELONGS_TO_STAGE", str(name), str(s["stage"]))] if "stage" in s else []
                    edges += [("DEPENDS_ON", str(name), str(x)) for x in _list(job.get("dependsOn"))]
    return nodes, edges


def bitbucket(text: str) -> Rows:
    """Steps of the default and branch pipelines as jobs."""
    nodes = []
    for d in _documents(text):
        p = d.get("pipelines") or {}
        lists = [p.get("default"), *(p.get("branches") or {}).values()]
        for steps in lists:
            for i, entry in enumerate(_list(steps), 1):
                if isinstance(entry, dict) and isinstance(entry.get("step"), dict):
                    nodes.append(("Job", str(entry["step"].get("name", f"step-{i}")), ""))
    return nodes, []


def jenkins(text: str) -> Rows:
    """Stages in order."""
    names = re.findall(r"\bstage\s*\(\s*['\"]([^'\"]+)['\"]", text)
    return [("Stage", n, str(i)) for i, n in enumerate(names)], [("NEXT_STAGE", a, b) for a, b in zip(names, names[1:])]


def kubernetes(text: str) -> Rows:
    """Resources, their images and the config maps and secrets they mount."""
    nodes, edges = [], []
    for d in _documents(text):
        kind, name = d.get("kind"), (d.get("metadata") or {}).get("name")
        if not kind or not name or "apiVersion" not in d:
            continue
        nodes.append(("Resource", str(name), str(kind)))
        flat = json.dumps(d)
        edges += [("USES_IMAGE", str(name), i) for i in dict.fromkeys(re.findall(r'"image": "([^"]+)"', flat))]
        refs = re.findall(r'"(?:configMapRef|configMapKeyRef|secretRef|secretKeyRef|configMap)": \{[^{}]*"name": "([^"]+)"', flat) + re.findall(r'"secretName": "([^"]+)"', flat)
        edges += [("MOUNTS_CONFIG", str(name), r) for r in dict.fromkeys(refs)]
    return nodes, edges


def kustomize(text: str) -> Rows:
    """Files that a kustomization refers to."""
    sections = ("resources", "bases", "components", "patches", "patchesStrategicMerge")
    found = [x.get("path") if isinstance(x, dict) else x for d in _documents(text) for s in sections for x in _list(d.get(s))]
    return [], [("IMPORTS", "kustomization", str(x)) for x in found if x]


def dockerfile(text: str) -> Rows:
    """Build stages with their base images, and copies between stages by alias or number."""
    nodes, edges, stages = [], [], []
    for line in text.split("\n"):
        m = re.match(r"\s*FROM\s+(?:--\S+\s+)*(\S+)(?:\s+AS\s+(\S+))?", line, re.I)
        if m:
            stages.append(m.group(2) or f"stage-{len(stages)}")
            nodes.append(("Docker_Image", stages[-1], m.group(1)))
            edges.append(("BUILDS_FROM", stages[-1], m.group(1)))
            continue
        m = re.match(r"\s*(?:COPY|ADD)\s+.*--from=(\S+)", line, re.I)
        if m and stages:
            source = m.group(1)
            edges.append(("COPIES_FROM", stages[-1], stages[int(source)] if source.isdigit() and int(source) < len(stages) else source))
    return nodes, edges


def terraform(text: str) -> Rows:
    """Blocks, and references between blocks of the file."""
    nodes, edges, owner, depth, blocks = [], [], None, 0, {}
    lines = text.split("\n")
    for line in lines:
        m = re.match(r'\s*(resource|data|module)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', line)
        if m:
            name = f"{m.group(2)}.{m.group(3)}" if m.group(3) else f"module.{m.group(2)}"
            blocks[name] = m.group(1)
            nodes.append(("Infra", name, m.group(1)))
    for line in lines:
        m = re.match(r'\s*(?:resource|data|module)\s+"([^"]+)"(?:\s+"([^"]+)")?\s*\{', line)
        if m and not depth:
            owner = f"{m.group(1)}.{m.group(2)}" if m.group(2) else f"module.{m.group(1)}"
        depth += line.count("{") - line.count("}")
        if owner:
            edges += [("DEPENDS_ON", owner, r) for r in re.findall(r"(?<![\w.])((?:module|[a-z]\w*)\.\w+)", line) if r in blocks and r != owner and not m]
        if depth <= 0:
            owner, depth = None, 0
    return nodes, list(dict.fromkeys(edges))


def cloudformation(text: str) -> Rows:
    """Resources of a template, with the HTTP events of its functions as routes."""
    nodes, edges = [], []
    for d in _documents(re.sub(r"(:\s*|-\s+)!\w+\s", r"\1", text)):
        for name, r in (d.get("Resources") or {}).items():
            if isinstance(r, dict) and "Type" in r:
                nodes.append(("Infra", str(name), str(r["Type"])))
                for e in ((r.get("Properties") or {}).get("Events") or {}).values():
                    p = (e.get("Properties") or {}) if isinstance(e, dict) else {}
                    if "Path" in p:
                        route = f"{str(p.get('Method', 'ANY')).upper()} {p['Path']}"
                        nodes.append(("Route", route, ""))
                        edges.append(("HANDLES_ROUTE", str(name), route))
    return nodes, edges


def serverless(text: str) -> Rows:
    """Functions of a service and the routes of their HTTP events."""
    nodes, edges = [], []
    for d in _documents(text):
        for name, f in (d.get("functions") or {}).items():
            if not isinstance(f, dict):
                continue
            nodes.append(("Infra", str(name), str(f.get("handler", ""))))
            for event in _list(f.get("events")):
                for kind in ("http", "httpApi"):
                    told = event.get(kind) if isinstance(event, dict) else None
                    if isinstance(told, str):
                        method, _, path = told.partition(" ")
                    elif isinstance(told, dict):
                        method, path = str(told.get("method", "any")), str(told.get("path", ""))
                    else:
                        continue
                    route = f"{method.upper()} /{path.lstrip('/')}"
                    nodes.append(("Route", route, ""))
                    edges.append(("HANDLES_ROUTE", str(name), route))
    return nodes, edges


# Commands of a script that deploy or build an image, the edge and its end.
_COMMANDS = (("DEPLOYS", "deploy_target", r"terraform (?:apply|plan)|kubectl apply|helm (?:install|upgrade)"), ("BUILDS_IMAGE", "docker_target", r"docker (?:build|push)"))


def _deploys(job: str, *scripts) -> list[tuple[str, str, str]]:
    """What the scripts of a job deploy or build, each kind once."""
    text = "\n".join(str(x.get("command", "")) if isinstance(x, dict) else str(x) for s in scripts for x in _list(s))
    return [(kind, job, end) for kind, end, pattern in _COMMANDS if re.search(pattern, text)]


def helm_chart(text: str) -> Rows:
    """A chart and its dependencies."""
    docs = _documents(text)
    return [("Infra", str(d.get("name", "")), str(d.get("version", ""))) for d in docs], [("DEPENDS_ON", str(d.get("name", "")), str(x.get("name"))) for d in docs for x in _list(d.get("dependencies")) if isinstance(x, dict)]


def kind_of(path: str, text: str) -> str | None:
    """Which reader a file takes, by path and content."""
    name = path.rsplit("/", 1)[-1]
    # File names and folders of the systems.
    by_name = {".gitlab-ci.yml": "gitlab", "Jenkinsfile": "jenkins", "azure-pipelines.yml": "azure", "bitbucket-pipelines.yml": "bitbucket", "kustomization.yaml": "kustomize", "kustomization.yml": "kustomize", "Chart.yaml": "helm_chart", "serverless.yml": "serverless", "serverless.yaml": "serverless"}
    if name in by_name:
        return by_name[name]
    if path.endswith(".circleci/config.yml"):
        return "circleci"
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path):
        return "github"
    if name.startswith("Dockerfile"):
        return "dockerfile"
    if name.endswith(".tf"):
        return "terraform"
    if name.endswith((".yaml", ".yml")):
        if "AWSTemplateFormatVersion" in text or "AWS::Serverless" in text:
            return "cloudformation"
        if re.search(r"(?m)^apiVersion:", text) and re.search(r"(?m)^kind:", text):
            return "kubernetes"
    return None


READERS = {f.__name__: f for f in (gitlab, github, circleci, azure, bitbucket, jenkins, kubernetes, kustomize, dockerfile, terraform, cloudformation, serverless, helm_chart)}


def config_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the CI, container and infrastructure files among ``files(rel_path, content)``; broken files have none."""

    def run(which: int, columns: list[str]):
        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for path, text in zip(pdf["rel_path"], pdf["content"]):
                    kind = kind_of(path, text) if text else None
                    if kind:
                        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                        found = [(r[0], stem, *r[2:]) if r[:2] == ("Pipeline", "") else r for r in READERS[kind](text)[which]]  # a pipeline without a name has the file's
                        rows += [(path, *([kind] if which == 0 else []), *r) for r in found]
                yield pd.DataFrame(rows, columns=columns)

        return emit

    narrow = files.select("rel_path", "content")
    names = lambda spec: [c.split()[0] for c in spec.split(", ")]
    return narrow.mapInPandas(run(0, names(NODES)), NODES), narrow.mapInPandas(run(1, names(EDGES)), EDGES)


def kinds(files: DataFrame) -> DataFrame:
    """(rel_path, kind) of the files among ``files(rel_path, content)`` that a reader takes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [kind_of(p, t) if t else None for p, t in zip(pdf["rel_path"], pdf["content"])]
            yield pd.DataFrame({"rel_path": pdf["rel_path"], "kind": found}).dropna()

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, kind string")


def manifests(files: DataFrame) -> DataFrame:
    """(rel_path, package) of what the manifests among ``files(rel_path, content)`` name; broken ones name nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k) for p, t in zip(pdf["rel_path"], pdf["content"]) if t for k in manifest(p.rsplit("/", 1)[-1], t)]
            yield pd.DataFrame(rows, columns=["rel_path", "package"])

    return files.select("rel_path", "content").mapInPandas(run, "rel_path string, package string")


def compile_database(files: DataFrame) -> DataFrame:
    """(file, includes, definitions, standard) of the entries of the compilation databases among ``files(rel_path, content)``."""
    entry = "array<struct<file: string, command: string, arguments: array<string>>>"
    each = files.where(F.col("rel_path").endswith("compile_commands.json")).select(F.explode(F.from_json("content", entry)).alias("e"))
    words = F.coalesce("e.arguments", F.split("e.command", r"\s+"))
    rows = each.select("e.file", words.alias("w")).where("file is not null")

    def given(flag: str) -> Column:
        taken = F.transform("w", lambda x, i: F.when(x == flag, F.try_element_at("w", i + 2)).when(x.startswith(flag), F.substring(x, len(flag) + 1, 10_000)))
        return F.array_join(F.filter(taken, lambda x: x.isNotNull()), ",")

    std = F.try_element_at(F.filter("w", lambda x: x.startswith("-std=")), F.lit(1))
    return rows.select("file", given("-I").alias("includes"), given("-D").alias("definitions"), F.substring(std, 6, 100).alias("standard"))
