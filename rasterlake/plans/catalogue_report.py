"""One report over the canvas rules: every violation of each asset, and the totals that a release is judged by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake import registry
from rasterlake.registry import query

#: Rules of single canvases that SQL can check; 8 and 12 follow borders and are in ``lint_canvas_report`` only.
CHECKED = (1, 2, 3, 4, 6, 7, 9, 10, 11, 13, 14, 15, 16, 17, 19, 20, 21)
_COLUMNS = ("asset", "rule", "severity", "scope", "n")
_ROWS = " UNION ALL ".join(f"SELECT {', '.join(_COLUMNS)} FROM ({registry.ORACLES[f'lint_rule_{r}']})" for r in CHECKED)


def _violations(s, d, rules) -> DataFrame:
    return reduce(DataFrame.unionByName, (registry.QUERIES[f"lint_rule_{r}"](s, d).select(*_COLUMNS) for r in rules))


@query("lint_violations", "asset:long rule:long severity:string scope:string n:long", _ROWS)
def _(s, d):
    return _violations(s, d, CHECKED)


@query("lint_asset_verdicts", "asset:long blocking:long advisory:long rules:string", f"SELECT asset, sum(CASE WHEN severity = 'blocking' THEN n ELSE 0 END) AS blocking, sum(CASE WHEN severity = 'blocking' THEN 0 ELSE n END) AS advisory, string_agg(rule, ',' ORDER BY rule) AS rules FROM ({_ROWS}) GROUP BY 1")
def _(s, d):
    v = _violations(s, d, CHECKED)
    blocking = F.col("severity") == "blocking"
    return v.groupBy("asset").agg(F.sum(F.when(blocking, F.col("n")).otherwise(0)).alias("blocking"), F.sum(F.when(blocking, 0).otherwise(F.col("n"))).alias("advisory"), F.array_join(F.array_sort(F.collect_list("rule")).cast("array<string>"), ",").alias("rules"))


@query("lint_canvas_report", "rule:long severity:string scope:string assets:long violations:long")
def _(s, d):
    v = _violations(s, d, (*CHECKED, 8, 12))
    return v.groupBy("rule", "severity", "scope").agg(F.count_distinct("asset").alias("assets"), F.sum("n").alias("violations"))
