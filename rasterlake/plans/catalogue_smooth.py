"""Queries of smoothed borders; tests hold them against brute force, SQL can't follow borders and mend them in turn."""

from __future__ import annotations

from rasterlake.operators import smoothing
from rasterlake.registry import query
from rasterlake.views import canvases


@query("smoothed", "asset:long x:long y:long idx:long smoothed:long")
def _(s, d):
    return smoothing.smoothed(canvases(s, d))


@query("smooth_report", "asset:long moved:long passes:long remaining:long over_limit:long geometric:long no_move:long")
def _(s, d):
    return smoothing.smooth_report(canvases(s, d))


@query("smooth_deep", "asset:long moved:long passes:long remaining:long over_limit:long geometric:long no_move:long")
def _(s, d):
    return smoothing.smooth_report(canvases(s, d), 2, losers=True)
