"""The control plane: stages with needs and products, recipes as text, preflight and gates."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Block:
    """A kind of stage: what it needs, what it produces, its settings with defaults and bounds."""

    needs: tuple[str, ...] = ()
    produces: tuple[str, ...] = ()
    settings: dict[str, tuple[Any, float | None, float | None]] = field(default_factory=dict)


@dataclass
class Step:
    block: str
    settings: dict[str, Any] = field(default_factory=dict)
    gates: list[tuple[str, str, float]] = field(default_factory=list)


#: The library's stages.
BLOCKS = {
    "load": Block((), ("points",)),
    "filter": Block(("points",), ("points",), {"cell": (0.0, 0.0, None), "std_ratio": (1.5, 0.1, 10.0), "k": (12, 1, 64)}),
    "dem": Block(("points",), ("dem",), {"gsd": (1.0, 0.001, None), "how": ("max", None, None)}),
    "fill": Block(("dem",), ("dem",), {"radius": (2, 1, 64)}),
    "terrain": Block(("dem",), ("terrain",), {"z_factor": (1.0, 0.0, None)}),
    "contours": Block(("dem",), ("contours",), {"interval": (1.0, 0.0, None)}),
    "match": Block(("descriptors",), ("pairs",), {"ratio": (0.8, 0.1, 1.0), "mutual": (True, None, None)}),
    "graph": Block(("pairs",), ("components",)),
}


def typed(block: str, key: str, text: str) -> Any:
    """A setting's value by the type of its default, clamped to its bounds."""
    if key not in BLOCKS[block].settings:
        raise ValueError(f"{block} has no setting {key}")
    default, low, high = BLOCKS[block].settings[key]
    if isinstance(default, bool):
        if text.lower() not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
            raise ValueError(f"{key} takes yes or no")
        return text.lower() in ("true", "yes", "on", "1")
    if isinstance(default, (int, float)):
        value = type(default)(float(text))
        return max(low, value) if low is not None and value < low else min(high, value) if high is not None and value > high else value
    return text


def parse_run(line: str) -> list[Step]:
    """'run dem gsd=2 how=min terrain' to steps; words may be quoted."""
    words = shlex.split(line)
    if not words or words[0] != "run":
        raise ValueError("a line begins with: run")
    steps: list[Step] = []
    for w in words[1:]:
        key, equals, value = w.partition("=")
        if equals:
            if not steps:
                raise ValueError(f"{w} before any stage")
            steps[-1].settings[key] = typed(steps[-1].block, key, value)
        elif w in BLOCKS:
            steps.append(Step(w))
        else:
            raise ValueError(f"no stage {w}")
    return steps


def recipe(steps: list[Step]) -> str:
    """A step a line: block key=value, then a line for each gate."""
    out = []
    for s in steps:
        out.append(" ".join([s.block, *(f"{k}={shlex.quote(str(v))}" for k, v in sorted(s.settings.items()))]))
        out += [f"  gate {m} {op} {t:g}" for m, op, t in s.gates]
    return "\n".join(out) + "\n"


def parse_recipe(text: str) -> list[Step]:
    steps: list[Step] = []
    for number, line in enumerate(text.splitlines(), 1):
        line = line.split("#")[0].strip()
        if not line:
            continue
        if line.startswith("gate "):
            _, metric, op, limit = line.split()
            if op not in (">=", ">", "<=", "<", "==") or not steps:
                raise ValueError(f"line {number}: {line}")
            steps[-1].gates.append((metric, op, float(limit)))
        else:
            steps += parse_run(f"run {line}")
    return steps


def preflight(steps: list[Step], have: set[str]) -> list[str]:
    """What is missing, by simulating the steps."""
    have, problems = set(have), []
    for k, s in enumerate(steps, 1):
        problems += [f"step {k} ({s.block}) needs {n}" for n in BLOCKS[s.block].needs if n not in have]
        have |= set(BLOCKS[s.block].produces)
    return problems


def with_defaults(step: Step) -> dict[str, Any]:
    return {k: step.settings.get(k, d) for k, (d, _, _) in BLOCKS[step.block].settings.items()}


def changed(step: Step) -> dict[str, Any]:
    """Settings that differ from their defaults."""
    return {k: v for k, v in step.settings.items() if v != BLOCKS[step.block].settings[k][0]}


def judge(value: float | None, op: str, limit: float) -> str:
    if value is None:
        return "missing"
    return "pass" if {">=": value >= limit, ">": value > limit, "<=": value <= limit, "<": value < limit, "==": value == limit}[op] else "fail"


Runner = Callable[[SparkSession, dict[str, DataFrame], dict[str, Any]], dict[str, DataFrame]]


def execute(spark: SparkSession, steps: list[Step], state: dict[str, DataFrame], runners: dict[str, Runner], metrics: Callable[[dict[str, DataFrame], str], float | None] | None = None) -> tuple[dict[str, DataFrame], list[tuple[int, str, str]]]:
    """Runs the steps; a gate that isn't passed stops the run. Returns the state and the verdicts."""
    if problems := preflight(steps, set(state)):
        raise ValueError("; ".join(problems))
    verdicts = []
    for k, s in enumerate(steps, 1):
        state = state | runners[s.block](spark, state, with_defaults(s))
        for metric, op, limit in s.gates:
            verdict = judge(metrics(state, metric) if metrics else None, op, limit)
            verdicts.append((k, metric, verdict))
            if verdict != "pass":
                return state, verdicts
    return state, verdicts


def runners() -> dict[str, Runner]:
    """The library's operators as stages; grids begin at the origin given in the state's settings."""
    from terrafold.operators import cloud, graph, match, raster

    def dem(_, state, s):
        b = cloud.bounds(state["points"]).first()
        g = s["gsd"]
        x0, y1 = (b["x_min"] // g) * g, -((-b["y_max"]) // g) * g
        return {"dem": raster.rasterize(state["points"], g, x0, y1, int((b["x_max"] - x0) // g) + 1, int((y1 - b["y_min"]) // g) + 1, s["how"]).select("row", "col", "z")}

    return {
        "load": lambda _, state, s: {"points": state["points"]},
        "filter": lambda _, state, s: {"points": cloud.outlier_filter(state["points"], s["cell"], s["k"], s["std_ratio"]) if s["cell"] else state["points"]},
        "dem": dem,
        "fill": lambda _, state, s: {"dem": raster.fill_nodata(state["dem"], s["radius"]).select("row", "col", "z")},
        "terrain": lambda _, state, s: {"terrain": raster.horn(state["dem"], 1.0, s["z_factor"])},
        "contours": lambda _, state, s: {"contours": raster.contour_crossings(state["dem"], s["interval"])},
        "match": lambda _, state, s: {"pairs": match.ratio_matches(state["descriptors"], state["other"], ["img"], s["ratio"], s["mutual"])},
        "graph": lambda _, state, s: {"components": graph.components(state["pairs"].select("id_a").withColumnRenamed("id_a", "id"), state["pairs"].select("id_a", "id_b"))},
    }
