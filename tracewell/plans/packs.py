"""Packs of rules from plain data, with all faults of a pack told at once."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

from ..functions.text import glob_pattern
from ..operators.artifacts import MATCHERS, compiles
from .scan import Pack

CONDITIONS = ("retry_loops", "tool_count", "edit_count", "commands")


def _strings(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) and x for x in value)


def faults(data: dict) -> list[str]:
    """What is wrong with a pack's data."""
    out = []
    if not isinstance(data.get("name"), str) or not data["name"]:
        out.append("name: a text is needed")
    for k, rule in enumerate(data.get("fingerprints", [])):
        if not isinstance(rule.get("type"), str) or not isinstance(rule.get("bonus"), int | float):
            out.append(f"fingerprints[{k}]: type and bonus are needed")
        if not (rule.get("commands") or rule.get("tools")) or not all(_strings(rule[n]) for n in ("commands", "tools") if n in rule):
            out.append(f"fingerprints[{k}]: commands or tools, lists of texts, are needed")
    skills = [r.get("skill") for r in data.get("opportunities", [])]
    for k, rule in enumerate(data.get("opportunities", [])):
        if not isinstance(rule.get("skill"), str) or skills.count(rule.get("skill")) > 1:
            out.append(f"opportunities[{k}]: a skill of its own is needed")
        if rule.get("when") not in CONDITIONS:
            out.append(f"opportunities[{k}]: when is one of {', '.join(CONDITIONS)}")
        if rule.get("when") in CONDITIONS[1:] and not (isinstance(rule.get("threshold"), int) and rule["threshold"] >= 0):
            out.append(f"opportunities[{k}]: a threshold is needed")
        if rule.get("when") == "commands" and not _strings(rule.get("commands")):
            out.append(f"opportunities[{k}]: commands are needed")
    for name in ("namespaces", "globs"):
        if name in data and not _strings(data[name]):
            out.append(f"{name}: a list of texts is needed")
    return out + [f"globs: {g!r} is no pattern" for g in data.get("globs", []) if isinstance(g, str) and not compiles(glob_pattern(g))]


def pack_from(data: dict) -> Pack:
    """A pack; raises with all faults."""
    if found := faults(data):
        raise ValueError("; ".join(found))
    rules = tuple(r | ({"least": True} if r["when"] == "commands" else {}) for r in data.get("opportunities", []))
    more = {"opportunities": rules} if "opportunities" in data else {}
    return Pack(data["name"], tuple(data.get("fingerprints", ())), namespaces=tuple(data.get("namespaces", ())), globs=tuple(data.get("globs", ())), **more)


def _read(path: Path) -> object:
    with open(path, encoding="utf-8") as f:
        if path.suffix in (".yaml", ".yml"):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def read_pack(path: str) -> Pack:
    """A pack from a JSON or YAML file, or from a folder."""
    return read_folder(path) if Path(path).is_dir() else pack_from(_read(Path(path)))


def _part(folder: Path, *names: str) -> dict:
    """An optional file of a pack: nothing if it isn't there, an error if it isn't a mapping."""
    for name in names:
        for suffix in (".yaml", ".yml", ".json"):
            path = folder / f"{name}{suffix}"
            if path.is_file():
                data = _read(path)
                if not isinstance(data, dict):
                    raise ValueError(f"{path.name}: a mapping is needed")
                return data
    return {}


def _list(data: dict, name: str) -> list:
    return data[name] if isinstance(data.get(name), list) else []


def _templates(folder: Path) -> dict[str, str]:
    """Bodies by what they produce. A file outside the folder is left out, and so is one that isn't there."""
    out = {}
    for entry in _list(_part(folder, "manifest"), "templates"):
        file, kind = (entry.get("file"), entry.get("produces")) if isinstance(entry, dict) else (None, None)
        if isinstance(file, str) and isinstance(kind, str):
            path = (folder / file).resolve()
            if not Path(file).is_absolute() and path.is_relative_to(folder.resolve()) and path.is_file():
                out[kind] = path.read_text(encoding="utf-8")
    return out


def content_faults(laws: list, playbooks: list, evaluation: dict | None) -> list[str]:
    """What is wrong with a pack's laws, playbooks and dimensions."""
    out = []
    for what, rows, needed in (("laws", laws, "statement"), ("playbooks", playbooks, "body")):
        ids = [r.get("id") if isinstance(r, dict) else None for r in rows]
        for k, row in enumerate(rows):
            if not isinstance(row, dict) or not isinstance(row.get("id"), str) or ids.count(row.get("id")) > 1:
                out.append(f"{what}[{k}]: an id of its own is needed")
            elif not isinstance(row.get(needed), str) or not row[needed].strip():
                out.append(f"{what}[{k}]: {needed} is needed")
    if evaluation:
        if evaluation.get("mode") not in ("vendored", "exec-in-place"):
            out.append("eval: mode is vendored or exec-in-place")
        for k, dim in enumerate(evaluation.get("dimensions") or []):
            if not isinstance(dim, dict) or not isinstance(dim.get("name"), str) or not isinstance(dim.get("weight", 1.0), int | float):
                out.append(f"eval.dimensions[{k}]: name and weight are needed")
            elif not all(isinstance(c, dict) and c.get("type") in MATCHERS for c in dim.get("checks", [])):
                out.append(f"eval.dimensions[{k}]: a check's type is one of {', '.join(MATCHERS)}")
    return out


def read_folder(path: str) -> Pack:
    """A pack from a folder: a manifest, and of detect, laws, investigate, eval and templates what there is. All faults are told at once."""
    folder = Path(path)
    manifests = sorted(p for p in folder.iterdir() if p.name.endswith((".adapter.yaml", ".adapter.yml", ".adapter.json")) or p.stem == "manifest")
    if not manifests:
        raise ValueError(f"{path}: no manifest")
    manifest = _read(manifests[0])
    if not isinstance(manifest, dict):
        raise ValueError(f"{manifests[0].name}: a mapping is needed")
    found = _part(folder / "detect", "signatures")
    data = {"name": manifest.get("name"), "globs": manifest.get("file_globs", [])}
    data |= {k: found[k] for k in ("fingerprints", "opportunities") if isinstance(found.get(k), list)} | {"namespaces": _list(found, "skill_namespaces")}
    laws, playbooks = _list(_part(folder / "laws", "laws"), "laws"), _list(_part(folder / "investigate", "playbooks"), "playbooks")
    evaluation = _part(folder / "eval", "eval") or None
    if wrong := faults(data) + content_faults(laws, playbooks, evaluation):
        raise ValueError("; ".join(wrong))
    return replace(pack_from(data), laws=tuple(laws), playbooks=tuple(playbooks), evaluation=evaluation, templates=_templates(folder / "templates"))
