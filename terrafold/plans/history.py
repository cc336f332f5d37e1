"""What a project did: a bounded undo history over table versions, log lines by source, a digest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a log line belongs, in the order of the work.
LOG_SOURCES = ["Project", "Import", "Images", "Sensors", "Fiducials", "Poses", "Detection", "Matching", "Sparse", "Georeferencing", "Dense", "Products", "Evaluate", "Export", "Workflow", "Models", "System", "Viewer", "Console"]
LEVELS = ["error", "warning", "success", "info", "debug"]


@dataclass
class Edit:
    """A step: the version (a written table) before and after, and the bytes they keep."""

    label: str
    before: str
    after: str
    size: int = 0
    kind: str = ""


@dataclass
class EditHistory:
    """At most `entries` steps back and `size` bytes in all; the oldest go first, one step back stays.

    limits: the most steps of a kind. A new edit clears the redo side.
    """

    entries: int = 10
    size: int = 1 << 30
    limits: dict[str, int] = field(default_factory=dict)
    undo: list[Edit] = field(default_factory=list)
    redo: list[Edit] = field(default_factory=list)

    def _trim(self) -> None:
        del self.undo[: max(0, len(self.undo) - self.entries)]
        held = lambda: sum(e.size for e in (*self.undo, *self.redo))
        for side in (self.undo, self.redo):
            while len(side) > 1 and held() > self.size:
                side.pop(0)
        for kind, most in self.limits.items():
            while sum(e.kind == kind for e in (*self.undo, *self.redo)) > most:
                side = self.undo if any(e.kind == kind for e in self.undo) else self.redo
                side.remove(next(e for e in side if e.kind == kind))

    def record(self, edit: Edit) -> None:
        self.undo.append(edit)
        self.redo.clear()
        self._trim()

    def take_back(self) -> str | None:
        """The version to show after one step back, or None."""
        if not self.undo:
            return None
        edit = self.undo.pop()
        self.redo.append(edit)
        self._trim()
        return edit.before

    def repeat(self) -> str | None:
        """The version to show after one step forth again, or None."""
        if not self.redo:
            return None
        edit = self.redo.pop()
        self.undo.append(edit)
        self._trim()
        return edit.after

    def keep(self, ok: Callable[[Edit], bool]) -> None:
        self.undo, self.redo = [e for e in self.undo if ok(e)], [e for e in self.redo if ok(e)]

    def versions(self) -> set[str]:
        """The tables that must stay."""
        return {v for e in (*self.undo, *self.redo) for v in (e.before, e.after)}


def log_digest(lines: DataFrame) -> DataFrame:
    """(source, place, level, n, first, last): lines by source in the order of the work, unknown ones as System.

    lines: t, source, level, message. Sources are told apart without case; a level that isn't known is info.
    """
    names = {s.lower(): s for s in LOG_SOURCES}
    known = F.coalesce(*[F.when(F.lower(F.trim("source")) == k, v) for k, v in names.items()], F.lit("System"))
    place = F.coalesce(*[F.when(F.col("source") == s, k) for k, s in enumerate(LOG_SOURCES)]).cast("int")
    level = F.when(F.lower("level").isin(LEVELS), F.lower("level")).otherwise("info")
    told = lines.select("t", known.alias("source"), level.alias("level"))
    return told.groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).withColumn("place", place).select("source", "place", "level", "n", "first", "last")


def digest_markdown(digest: DataFrame) -> str:
    """The digest as a table; a row for each source and level that has lines."""
    rows = sorted(digest.collect(), key=lambda r: (r["place"], LEVELS.index(r["level"])))  # sources times levels
    return "\n".join(["| source | level | lines |", "|-|-|-|", *(f"| {r['source']} | {r['level']} | {r['n']} |" for r in rows)])
