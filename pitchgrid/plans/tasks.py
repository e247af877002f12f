"""Task registry of a build: dependencies, skips, audit and scope rules."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass, field

PHASES = ["extract", "transform", "graph", "merge", "validate", "load"]
SCOPED = {"extract", "transform", "all"}


@dataclass(frozen=True)
class Task:
    """A named step: what it needs, what runs it, whether it runs once per league and season."""

    name: str
    phase: str
    run: Callable[..., dict | None]
    needs: tuple[str, ...] = ()
    check: Callable[[], list[str]] | None = None
    per_scope: bool = False


@dataclass(frozen=True)
class Artifact:
    """What a task leaves behind: a path with places for league and season, the columns it must have, its key."""

    path: str
    required: tuple[str, ...] = ()
    key: str | None = None
    per_scope: bool = False

    def paths(self, scope: list[tuple[str, str]]) -> list[str]:
        return [self.path.format(league=league, season=season) for league, season in scope] if self.per_scope else [self.path]


def artifact_failures(artifact: Artifact, scope: list[tuple[str, str]], read: Callable[[str], object]) -> list[str]:
    """What is wrong with an artefact's files; ``read`` gives a path's table or raises."""
    from pitchgrid.operators.quality import artifact as check_table

    wrong = []
    for path in artifact.paths(scope):
        try:
            table = read(path)
        except Exception as error:  # noqa: BLE001
            wrong.append(f"{path}: {error}")
            continue
        if artifact.key:
            wrong += [f"{path}: {r['rule']}" for r in check_table(table, path, list(artifact.required), artifact.key).where("failures > 0").collect()]
    return wrong


def merged_payload(entry: dict, payload: dict | None) -> dict:
    """An audit entry with what a child process says of itself: the worse status, its metrics, warnings and errors added."""
    rank = ["OK", "WARNING", "SKIPPED", "ERROR"]
    child = payload or {}
    status = max(entry.get("status", "OK"), str(child.get("status", "OK")).upper(), key=lambda s: rank.index(s) if s in rank else len(rank))
    lists = {k: [*entry.get(k, []), *child.get(k, [])] for k in ("warnings", "errors") if entry.get(k) or child.get(k)}
    return entry | {"status": status, "metrics": {**entry.get("metrics", {}), **child.get("metrics", {})}} | lists


@dataclass
class Audit:
    """What became of every task."""

    entries: list[dict] = field(default_factory=list)

    def add(self, name: str, status: str, **more: object) -> None:
        self.entries.append({"task": name, "status": status} | more)

    def summary(self) -> dict[str, int]:
        counts: dict[str, int] = {}
        for e in self.entries:
            counts[e["status"]] = counts.get(e["status"], 0) + 1
        return counts

    @property
    def blocked(self) -> bool:
        return any(e["status"] in {"ERROR", "SKIPPED"} for e in self.entries)

    def report(self) -> str:
        return json.dumps({"summary": self.summary(), "blocked": self.blocked, "tasks": self.entries}, indent=1, default=str)


def ordered(tasks: list[Task]) -> list[Task]:
    """Tasks after all they need; a cycle or an unknown need raises ValueError."""
    by_name, done, out = {t.name: t for t in tasks}, set(), []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path or name not in by_name:
            raise ValueError(f"cycle or unknown task: {' > '.join((*path, name))}")
        if name not in done:
            for need in by_name[name].needs:
                visit(need, (*path, name))
            done.add(name)
            out.append(by_name[name])

    for t in tasks:
        visit(t.name, ())
    return out


def run(tasks: list[Task], scope: list[tuple[str, str]] | None = None, dry: bool = False) -> Audit:
    """Run the tasks in order. One whose need failed or was skipped, or whose inputs fail, is skipped."""
    audit, bad = Audit(), set()
    for t in ordered(tasks):
        lost = [n for n in t.needs if n in bad]
        wrong = t.check() if t.check and not lost and not dry else []
        if lost or wrong:
            bad.add(t.name)
            audit.add(t.name, "SKIPPED", reason=[*(f"needs {n}" for n in lost), *wrong])
            continue
        for arguments in (scope or []) if t.per_scope else [()]:
            if dry:
                audit.add(t.name, "PLANNED", scope=arguments)
                continue
            try:
                audit.add(t.name, "OK", scope=arguments, **(t.run(*arguments) or {}))
            except Exception as error:  # noqa: BLE001
                bad.add(t.name)
                audit.add(t.name, "ERROR", scope=arguments, error=str(error))
    return audit


def arguments(argv: list[str]) -> argparse.Namespace:
    """Command line of a build: phases, leagues and seasons (both or neither), dry run."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--phases", nargs="+", choices=[*PHASES, "all"], required=True)
    parser.add_argument("--leagues", nargs="+", default=[])
    parser.add_argument("--seasons", nargs="+", default=[])
    parser.add_argument("--keep", action="store_true", help="add to the loaded triples instead of replacing them")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    if bool(args.leagues) != bool(args.seasons) or (SCOPED & set(args.phases) and not args.leagues):
        parser.error("leagues and seasons go together, and extract and transform need them")
    return args
