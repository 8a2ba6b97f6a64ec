"""The checked loop of investigations: reports that fail their check go back to the step that can mend them.

A pass takes only the investigations that are still open; each pass's state is staged, so a lost
executor costs a read and the plan of a pass doesn't grow with the passes before it. What has a row or
more for each investigation is merged(), so none of it goes through the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probitas.cluster import merged, stage, stage_rows
from probitas.operators import qa as Q
from probitas.operators import risk as K
from probitas.operators.evidence import evidence_for, split_valid
from probitas.operators.intake import resolved_entities
from probitas.operators.planning import apply_task_status, plan_tasks

ID = "investigation_id"
#: Steps in their order: each is followed by all behind it.
STEPS = ("planner", "entity_resolution", "risk_analysis", "report_generation")
REPORT = (ID, "business_name", "gstin", "cin", "epfo_code", "entity_confidence", "score", "level")
TASK = (ID, "task_type", "target", "preferred")

Research = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Ended:
    """state: (investigation_id, status, loops, issues, coverage); reports as they ended; the tasks that were
    made, with their status; the evidence that was added, with the columns of evidence."""

    state: DataFrame
    reports: DataFrame
    tasks: DataFrame
    evidence: DataFrame


def _at(d: DataFrame, *steps: str) -> DataFrame:
    return d.filter(F.col("step").isin(*steps)).select(ID)


def new_evidence(results: DataFrame, ev: DataFrame) -> DataFrame:
    """Valid ones of results (investigation_id, task_id, pos, field_name, field_value, source_name, confidence,
    verification_status, retrieved_at) as rows of ev, with ids of task and place, behind what ev holds."""
    good, _ = split_valid(results.withColumn("research_result_id", F.format_string("%s-%d", "task_id", "pos")))
    top = ev.groupBy(ID).agg(F.max("ev_seq").alias("top_"))
    k = F.row_number().over(Window.partitionBy(ID).orderBy("task_id", "pos"))
    d = good.withColumn("k_", k).join(merged(top), ID, "left").withColumn("ev_seq", (F.coalesce("top_", F.lit(0)) + F.col("k_")).cast(ev.schema["ev_seq"].dataType))
    return d.select(*(F.col(f.name).cast(f.dataType) for f in ev.schema))


def made_tasks(open_: DataFrame, requests: DataFrame, ev: DataFrame, tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """New tasks of the open investigations whose step is the planner's; pending."""
    mine = _at(open_, "planner")
    existing = evidence_for(tasks, mine).select(ID, "task_type", "target", F.col("preferred").alias("preferred_sources"))
    null = F.lit(None).cast("timestamp")
    return plan_tasks(merged(evidence_for(requests, mine)), evidence_for(ev, mine), merged(existing), catalog).withColumns({"status": F.lit("PENDING"), "started_at": null, "completed_at": null})


def mended(open_: DataFrame, requests: DataFrame, reports: DataFrame, findings: DataFrame, ev: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and findings of the open investigations after the steps that theirs leads to: the entity is
    resolved again, the score is computed again, or only the words are written again."""
    deep, scored = _at(open_, *STEPS[:2]), _at(open_, *STEPS[:3])
    who = resolved_entities(evidence_for(requests, deep), evidence_for(ev, deep)).select(ID, F.struct(F.col("name").alias("business_name"), "gstin", "cin", "epfo_code", "entity_confidence").alias("e_"))
    score = K.scores_of(scored, profile).select(ID, F.struct("score", "level").alias("s_"))
    d = reports.join(open_.select(ID), ID, "left_semi").join(merged(who), ID, "left").join(merged(score), ID, "left")
    take = lambda s, c: F.when(F.col(s).isNotNull(), F.col(f"{s}.{c}")).otherwise(F.col(c)).alias(c)
    again = d.select(ID, *(take("e_", c) for c in REPORT[1:6]), *(take("s_", c) for c in REPORT[6:]))
    worded = evidence_for(findings, _at(open_, STEPS[3])).select(ID, "code", "evidence_ids")
    found = K.exploded(evidence_for(profile, scored)).select(ID, "code", "evidence_ids").unionByName(worded)
    return again, found.withColumn("description", F.lower("code"))


def checked(open_: DataFrame, requests: DataFrame, reports: DataFrame, findings: DataFrame, ev: DataFrame, profile: DataFrame, max_loops: int) -> DataFrame:
    """open_ (investigation_id, loops) after its reports are checked: step, status, loops, issues, coverage."""
    grounded = Q.check_grounding(findings, ev)
    issues = Q.qa_issues(reports, requests, findings, ev, K.scores_of(open_, profile), grounded)
    v = Q.qa_verdict(open_, issues, merged(Q.grounding_coverage(open_, grounded))).select(ID, F.col("status").alias("verdict"), "issues", "coverage")
    d = open_.select(ID, "loops").join(merged(v), ID).withColumn("loops", F.col("loops") + F.when(F.col("verdict") == "FAIL", 1).otherwise(0))
    step, status = Q.next_step(F.col("verdict"), F.col("issues"), F.col("loops"), max_loops), Q.final_status(F.col("verdict"), F.col("loops"), max_loops)
    return d.select(ID, status.alias("status"), "loops", "issues", "coverage", step.alias("step"))


def run_until_ended(requests: DataFrame, reports: DataFrame, findings: DataFrame, ev: DataFrame, tasks: DataFrame, catalog: DataFrame, research: Research, max_loops: int = 2) -> Ended:
    """Check reports, and mend and check those that fail again, until each has passed or failed max_loops times.

    requests: intake, a row an investigation; reports and findings: what the check reads (qa_issues());
    tasks (investigation_id, task_type, target, preferred) that exist; research gives, for new tasks,
    results (new_evidence()) and changes of their status (apply_task_status()). Tasks that exist are
    never planned again. Investigations without a report stay out."""
    open_ = stage_rows(reports.select(ID).distinct().withColumn("loops", F.lit(0)), "open")
    reports, findings = merged(reports.select(*REPORT)), merged(findings.select(ID, "code", "evidence_ids", "description"))
    state, ended, made, added = [], [], [], []
    for loop in range(max_loops + 1):
        if loop:
            ev = stage(evidence_for(ev, open_), "evidence")
            new_tasks = stage(made_tasks(open_, requests, ev, tasks, catalog), "tasks")
            results, changes = research(new_tasks)
            made.append(stage_rows(apply_task_status(merged(new_tasks), changes), "tasks"))
            added.append(stage(new_evidence(results, ev), "evidence"))
            tasks, ev = tasks.select(*TASK).unionByName(new_tasks.select(*TASK)), ev.unionByName(added[-1])
        profile = stage_rows(K.risk_profile(ev), "profile")
        if loop:
            reports, findings = (stage_rows(d, "report") for d in mended(open_, requests, reports, findings, ev, profile))
        now = stage_rows(checked(open_, requests, reports, findings, ev, profile, max_loops), "state")
        closed, open_ = now.filter("step = 'end'"), now.filter("step <> 'end'")
        state.append(closed.drop("step"))
        ended.append(evidence_for(reports, closed))
        if open_.isEmpty():
            break
    if not made:  # nothing had to be mended: no task, no evidence
        made.append(apply_task_status(made_tasks(open_, requests, ev, tasks, catalog), research(made_tasks(open_, requests, ev, tasks, catalog))[1]))
        added.append(ev.limit(0))
    every = lambda parts: merged(reduce(DataFrame.unionByName, parts))
    return Ended(every(state), every(ended), every(made), every(added))
