"""Figures for people: paging, progress, time left, confidence."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Statuses of a document in order, stages, final statuses.
STATUSES = ("pending", "parsing", "parsed", "extracting", "extracted", "resolving", "resolved", "reconciling", "done", "failed")
STAGES = ("parse", "extract", "resolve", "reconcile")
TERMINAL = ("done", "failed")


@dataclass(frozen=True)
class Paging:
    page: int
    limit: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


def parse_paging(page: str | float | None, limit: str | float | None, default_limit: int = 20, most: int = 100) -> Paging:
    """Pages count from 1, limits go from 1 to ``most``; what is no number gets the default."""

    def number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return math.nan

    p, n = number(page), number(limit)
    own = int(min(max(math.floor(n), 1), most)) if math.isfinite(n) else default_limit
    return Paging(math.floor(p) if math.isfinite(p) and p >= 1 else 1, own)


def total_pages(total: Column, limit: int) -> Column:
    return F.ceil(total / F.lit(limit))


def confidence_percent(c: Column) -> Column:
    """Whole per cent; 0 and null show as 100."""
    return F.round(100 * F.when((c == 0) | c.isNull(), F.lit(1.0)).otherwise(c)).cast("int")


def eta_ms(elapsed: Column, current: Column, total: Column) -> Column:
    """Time left at the pace so far; null before the first step and after the last."""
    return F.when((current > 0) & (total > current), elapsed * (total - current) / current)


def format_eta(ms: Column) -> Column:
    """Time left for people; null where it is not known."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("bigint")
    minutes, seconds = F.floor(s / 60), s % 60
    return (
        F.when(ms.isNull() | F.isnan(ms.cast("double")) | (F.abs(ms.cast("double")) == float("inf")), F.lit(None).cast("string"))
        .when(s < 5, "almost done")
        .when(s < 60, F.format_string("≈ %ds left", s))
        .when((minutes < 60) & (seconds == 0), F.format_string("≈ %dm left", minutes))
        .when(minutes < 60, F.format_string("≈ %dm %ds left", minutes, seconds))
        .otherwise(F.format_string("≈ %dh %dm left", F.floor(minutes / 60), minutes % 60))
    )


def progress_percent(current: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.round(100 * current / F.greatest(F.lit(1), total)).cast("int"))


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def is_live(status: Column) -> Column:
    return ~is_terminal(status)


def stage_of(status: Column) -> Column:
    """The stage that a status belongs to."""
    return (
        F.when(status.isin("pending", "parsing"), "parse")
        .when(status.isin("parsed", "extracting"), "extract")
        .when(status.isin("extracted", "resolving"), "resolve")
        .when(status.isin("resolved", "reconciling", "done"), "reconcile")
    )


def stage_state(status: Column, stage: Column, step: str) -> Column:
    """done, active, failed or pending: where a step (upload or a stage) stands while a document has a status and a stage.
    Uploads are done; of a failed document the stages before its own are done and those after it pending; a running
    document without a stage is at the first."""
    at = F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(0))  # from 1; 0 if unknown
    own = STAGES.index(step) + 1 if step in STAGES else 0
    failed = F.when(at == own, "failed").when(at > own, "done").otherwise("pending")
    active = F.greatest(at, F.lit(1))
    running = F.when(active > own, "done").when(active == own, "active").otherwise("pending")
    if step == "upload":
        return F.lit("done")
    return F.when(status == "done", "done").when(status == "failed", failed).otherwise(running)


#: Close codes of the status channel: (what is said, whether the document's status is final).
CLOSE_CODES = {
    4400: ("Invalid document ID format", False),
    4404: ("Document not found", False),
    4413: ("Live updates unavailable. Click to reconnect.", False),
    1000: (None, True),
}


def close_event(code: int) -> tuple[str | None, bool]:
    return CLOSE_CODES.get(code, ("Connection lost. Click to reconnect.", False))


def stage_line(state: Column, step: str, progress: Column, description: str, error: Column) -> Column:
    """What is said below a step: fixed words, the progress of an active one, the error of a failed one."""
    return (
        F.when(state == "done", "Received" if step == "upload" else "Complete")
        .when(state == "failed", F.coalesce(error, F.lit("Stage failed")))
        .when(state == "active", F.coalesce(progress, F.lit(description)))
        .otherwise("Waiting")
    )


def env_or(value: str | None, fallback: str) -> str:
    """A setting, or the fallback where it is missing or blank."""
    return value if value is not None and value.strip() else fallback


def upload_status(mime: Column, size: Column, most_mb: int = 100) -> Column:
    """The answer to an upload: 400 for what is no PDF, 413 for what is too large, else 201."""
    return F.when(~mime.eqNullSafe(F.lit("application/pdf")), 400).when(size > most_mb * 1024 * 1024, 413).otherwise(201)


def run_ranges(runs: Column) -> Column:
    """array<struct<start, end>>: where each run's text stands in the runs joined by one space; the end counts the space."""
    sizes = F.transform(runs, lambda r: F.length(F.coalesce(r["text"], F.lit(""))) + 1)
    ends = lambda sizes: F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    return let(sizes, lambda z: F.zip_with(z, ends(z), lambda n, e: F.struct((e - n).alias("start"), e.alias("end"))))


def matching_runs(runs: Column, quote: Column) -> Column:
    """The runs that a quote touches: where the texts, without case and repeated white space, contain it; or, if they do so
    only without marks, where its first 15 characters stand."""
    normal = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    bare = lambda c: F.regexp_replace(c, "[^a-z0-9_]", "")
    text = F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), " ")
    loose = lambda s: (F.length(bare(s["quote"])) > 5) & F.contains(bare(s["text"]), bare(s["quote"]))
    place = lambda s: F.when(F.instr(s["text"], s["quote"]) > 0, F.instr(s["text"], s["quote"])).when(loose(s), F.instr(s["text"], F.substring(s["quote"], 1, 15))).otherwise(0) - 1
    touched = lambda s: let(place(s), lambda at: F.filter(F.arrays_zip(runs.alias("run"), run_ranges(runs).alias("range")), lambda x: (at >= 0) & (x["range"]["start"] <= at + F.length(s["quote"])) & (x["range"]["end"] >= at)))
    found = let(F.struct(normal(text).alias("text"), normal(quote).alias("quote")), touched)
    none = F.filter(runs, lambda r: F.lit(False))
    return F.when((F.size(runs) == 0) | F.coalesce(quote == "", F.lit(True)), none).otherwise(F.transform(found, lambda x: x["run"]))


def highlight(run: Column, scale: float, page_height: Column) -> Column:
    """struct<left, top, width, height> of a run on a page drawn at a scale, the origin at its upper left; no less than 4
    wide and 8 high."""
    width, height = F.abs(run["width"]) * scale, F.abs(run["height"]) * scale
    left, low, high = F.least(run["x"], run["x"] + run["width"]) * scale, run["y"], run["y"] + run["height"]
    top = (page_height - F.greatest(low, high)) * scale
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(4.0), width).alias("width"), F.greatest(F.lit(8.0), height).alias("height"))
