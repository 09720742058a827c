"""A pipeline document is a fold of its stages over a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import QueryError
from ..limits import MAX_STAGES
from ..operators import group, join, shape, window
from ..operators.frame import Frame, Resolver

_STAGES = {
    "$match": shape.match, "$project": shape.project, "$addFields": shape.add_fields, "$replaceRoot": shape.replace_root, "$unwind": shape.unwind,
    "$sort": shape.sort, "$limit": shape.limit, "$skip": shape.skip, "$densify": shape.densify, "$group": group.group, "$bucket": group.bucket,
    "$count": group.count, "$lookup": join.lookup, "$setWindowFields": window.set_window_fields,
}


def run_stages(frame: Frame, stages: list[dict]) -> Frame:
    for stage in stages:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise QueryError("a stage is an object with one key")
        ((name, spec),) = stage.items()
        if name == "$facet":
            frame = shape.facet(frame, spec, run_stages)
        elif name in _STAGES:
            frame = _STAGES[name](frame, spec)
        else:
            raise QueryError(f"unknown stage {name}")
    return frame


def aggregate(df: DataFrame, stages: list[dict], resolver: Resolver | None = None, tokens: str | None = None) -> DataFrame:
    if len(stages) > MAX_STAGES:
        raise QueryError(f"at most {MAX_STAGES} stages")
    return run_stages(Frame(df, resolver=resolver, tokens=tokens), stages).df
