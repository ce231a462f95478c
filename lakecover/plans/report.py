"""Summary of a run as JSON in a static page."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from string import Template

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCOVERED = ("singleton", "fixed", "failed")

PAGE = Template("""<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:.2em .8em;border-bottom:1px solid #ccc;text-align:right}td:first-child,th:first-child{text-align:left}</style></head>
<body><h1>$title</h1><p>$n_taxa groups, $n_genomes items, $n_representatives representatives ($reduction % fewer), $n_failed failed.</p>
<input id="q" placeholder="search"> <button id="b">previous</button> <span id="p"></span> <button id="n">next</button><table id="t"></table><script id="data" type="application/json">$data</script>
<script>
const rows=JSON.parse(document.getElementById("data").textContent).taxa,t=document.getElementById("t"),q=document.getElementById("q"),SIZE=500;let at=0;
const found=()=>rows.filter(r=>r.taxonomy.toLowerCase().includes(q.value.toLowerCase()));
const turn=d=>{const n=found().length;at=Math.max(0,Math.min(at+d*SIZE,Math.floor(Math.max(0,n-1)/SIZE)*SIZE));draw()};
const draw=()=>{t.replaceChildren();const head=t.insertRow();for(const c of ["taxonomy","method","n_genomes","n_representatives","coverage_mean_ani"])head.insertCell().textContent=c;
const all=found();document.getElementById("p").textContent=(all.length?at+1:0)+" to "+Math.min(at+SIZE,all.length)+" of "+all.length;
for(const r of all.slice(at,at+SIZE)){const x=t.insertRow();for(const c of ["taxonomy","method","n_genomes","n_representatives","coverage_mean_ani"])x.insertCell().textContent=r[c]??"NA"}};
document.getElementById("b").onclick=()=>turn(-1);document.getElementById("n").onclick=()=>turn(1);q.oninput=()=>{at=0;draw()};draw();
</script></body></html>
""")


def taxon_rows(results: DataFrame, diversity: DataFrame) -> DataFrame:
    """Results with their diversity, largest reduction last by name."""
    return results.select("taxonomy", "method", "n_genomes", F.col("n_genomes_derep").alias("n_representatives")).join(
        diversity.drop("method", "n_genomes", "n_representatives"), "taxonomy", "left"
    ).orderBy("taxonomy")


def totals(results: DataFrame, diversity: DataFrame, stages: DataFrame) -> DataFrame:
    """One row; averages leave out methods without a cover of their own, failures come from the stage table."""
    joined = results.join(diversity.select("taxonomy", "coverage_mean_ani", "coverage_below_95"), "taxonomy", "left")
    own = ~F.col("method").isin(*UNCOVERED)
    counted = joined.agg(
        F.count("*").alias("n_taxa"), F.coalesce(F.sum("n_genomes"), F.lit(0)).alias("n_genomes"), F.coalesce(F.sum("n_genomes_derep"), F.lit(0)).alias("n_representatives"),
        F.avg(F.when(own, F.col("coverage_mean_ani"))).alias("mean_coverage_ani"), F.coalesce(F.sum(F.when(own, F.col("coverage_below_95"))), F.lit(0)).alias("below_95"),
    )
    return counted.crossJoin(stages.agg(F.count_if(F.col("error_message").isNotNull()).alias("n_failed")))


def build(tables: dict[str, DataFrame], title: str = "Representatives", most: int = 100_000, page: int = 0) -> str:
    """A page of the report: its table lists ``most`` groups from ``page`` times as many on, the totals count all."""
    t = totals(tables["results"], tables["diversity_stats"], tables["pipeline_stages"]).first().asDict()
    rows = [json.loads(r[0]) for r in taxon_rows(tables["results"], tables["diversity_stats"]).offset(page * most).limit(most).select(F.to_json(F.struct("*"))).collect()]
    data = json.dumps({"taxa": rows, "totals": t}).replace("<", "\\u003c")
    reduction = 100 * (1 - t["n_representatives"] / t["n_genomes"]) if t["n_genomes"] else 0.0
    return PAGE.substitute(title=html.escape(title), data=data, reduction=f"{reduction:.1f}", **{k: f"{t[k]:,}" for k in ("n_taxa", "n_genomes", "n_representatives", "n_failed")})


def pages(tables: dict[str, DataFrame], title: str = "Representatives", most: int = 100_000) -> Iterator[str]:
    """Pages that together list every group, one at a time; one page without any group."""
    for page in range(max(1, -(-tables["results"].count() // most))):
        yield build(tables, title, most, page)


def search(rows: DataFrame, text: str = "", sort: str = "taxonomy", descending: bool = False, page: int = 0, size: int = 50) -> DataFrame:
    """A page of the rows whose group holds the text, sorted by a column."""
    order = F.desc(sort) if descending else F.asc(sort)
    return rows.where(F.lower("taxonomy").contains(text.lower())).orderBy(order, "taxonomy").offset(page * size).limit(size)
