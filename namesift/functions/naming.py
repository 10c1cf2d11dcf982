"""Names of models, files and settings; scores printed by test runs. Driver code over single strings."""

from __future__ import annotations

import ast
import re


def base_name(model: str) -> str:
    return model.rstrip("/").rsplit("/", 1)[-1]


def resolve_model(name: str, presets: dict[str, str]) -> str:
    """The full name of a preset; any other name is one already."""
    return presets.get(name, name)


def model_suffix(model: str, presets: dict[str, str] | None = None) -> str:
    """A short form for file names: a preset's own key, else the model's base name without instruction marks, lower case."""
    for key, full in (presets or {}).items():
        if model in (key, full):
            return key
    x = re.sub(r"[-_](instruct|chat|base|hf)\b", "", base_name(model), flags=re.IGNORECASE)
    return re.sub(r"[^A-Za-z0-9.]+", "-", x).strip("-").lower()


def file_suffix(model: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", base_name(model))


def settings_suffix(settings: dict[str, object | None]) -> str:
    """key=value of all that is set, joined by underscores."""
    return "_".join(f"{k}={str(v).replace('/', '-')}" for k, v in settings.items() if v is not None)


def layer_pairs(text: str, layers: list[int]) -> list[tuple[int, int]]:
    """adjacent, all, or pairs as "0-1,3-7"; no pair twice."""
    if text == "adjacent":
        return list(zip(layers, layers[1:], strict=False))
    if text == "all":
        return [(a, b) for i, a in enumerate(layers) for b in layers[i + 1 :]]
    return list(dict.fromkeys((int(a), int(b)) for a, b in (p.strip().split("-") for p in text.split(",") if p.strip())))


def parse_scores(stdout: str) -> dict[str, dict[str, float]]:
    """{base or plus: {pass@k: score}} of a test run's output: a printed dictionary, else lines under headings."""
    out: dict[str, dict[str, float]] = {}
    part = "base"
    for line in stdout.splitlines():
        if re.search(r"(?i)\bbase \+ extra|\bplus\b", line):
            part = "plus"
        elif re.search(r"(?i)\bbase\b", line):
            part = "base"
        if m := re.search(r"\{.*\}", line):
            try:
                x = ast.literal_eval(m.group())
            except (ValueError, SyntaxError):
                continue
            if isinstance(x, dict):
                nested = {k: v for k, v in x.items() if isinstance(v, dict)}
                out |= {k: {a: float(b) for a, b in v.items()} for k, v in nested.items()}
                flat = {k: float(v) for k, v in x.items() if isinstance(v, (int, float))}
                if flat:
                    out.setdefault(part, {}).update(flat)
        elif m := re.search(r"(pass@\d+)\s*[:=]\s*([0-9.]+)", line):
            out.setdefault(part, {})[m.group(1)] = float(m.group(2))
    return out


def pass_at(scores: dict[str, dict[str, float]], k: int = 1, part: str = "base") -> float | None:
    return scores.get(part, {}).get(f"pass@{k}")
