"""From ordered bars to all structures of a series, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.operators.events import number_events, structure_events
from barloom.operators.folding import CHUNK
from barloom.operators.fractals import fractal_candidates, fractals
from barloom.operators.inclusion import assign_merged, merged_bars
from barloom.operators.segments import primary_segments
from barloom.operators.strokes import stroke_decisions, stroke_sequences, strokes
from barloom.profile import Profile
from barloom.session import stash


def parse(valid_bars: DataFrame, profile: Profile = Profile(), chunk: int = CHUNK) -> dict[str, DataFrame]:
    """Tables: assigned, merged, candidates, fractals, decisions, strokes, sequences.

    Merged bars are read by every later step, and a fold's output can't be planned around, so they
    are written once; the rest stays lazy.
    """
    assigned = stash(assign_merged(valid_bars, profile, chunk), "assigned")
    merged = stash(merged_bars(assigned), "merged")
    candidates = fractal_candidates(merged, profile)
    selected = fractals(candidates)
    decisions = stash(stroke_decisions(merged, selected, profile, chunk), "decisions")
    legs = strokes(decisions, merged, profile)
    return {"assigned": assigned, "merged": merged, "candidates": candidates, "fractals": selected, "decisions": decisions, "strokes": legs, "sequences": stroke_sequences(legs)}


def event_log(tables: dict[str, DataFrame]) -> DataFrame:
    return number_events(structure_events(tables["merged"], tables["candidates"], tables["fractals"], tables["decisions"], tables["strokes"]))


def segments(tables: dict[str, DataFrame]) -> DataFrame:
    return primary_segments(tables["sequences"])
