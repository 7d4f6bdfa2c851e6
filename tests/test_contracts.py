"""Contracts of documents: whole ones pass, each planted break is found at its path, odd bodies fail without a crash."""

import json

import pytest

from auditlake.operators import contracts as ct

LINK = [{"url": "u"}]
LEARNING = {"id": "l", "title": "t", "summary": "s", "evidence": [{"blockerId": "b"}], "recommendation": "r", "maintainerActionStatus": "proposed"}
ITEM = {"id": "q", "findingId": "f", "title": "t", "owner": "o", "validationCommand": "v", "nextStep": "n"}
PART = {"status": "complete", "summary": "x", "finalAuditMarkdown": "x", "evidence": [1]}
WHOLE = {
    "FINDING": {"id": "a", "title": "t", "confidence": 100, "evidence": [{"id": "e", "type": "t", "timestamp": "2024"}], "impact": "i", "rootCause": "r", "recommendation": "r", "validation": ["v"], "affectedUrls": [], "affectedTemplates": ["x"]},
    "SCORE": {"total": 50, "categories": [1], "profiles": {"core_seo": {"score": 50.0, "includedInPrimary": True}, "agent_readiness": {"includedInPrimary": False}}, "coverage": {"measuredRules": 1, "applicableRules": 1, "percentMeasured": 100}, "experimentalCombined": 1},
    "PLAN": {"phases": [1], "safeFixes": [], "approvalRequired": [], "manualRecommendations": []},
    "DASHBOARD": {"targetUrl": "u", "score": {"total": 0}, "nextBestFixes": [ITEM], "implementationQueue": [], "approvalQueue": [], "impactEffortMatrix": [1, 2, 3, 4], "performanceSummary": {"metrics": [1], "browserEvidence": {"status": "ok"}, "fieldData": {"status": "partial"}}, "evidenceStats": {"evidenceEntries": 0, "groupedFindings": 0}, "agentReview": {"status": "pending"}},
    "REVIEW_INPUT": {"status": "ready", "targetUrl": "u", "sourceArtifacts": [1], "findingCount": 0, "groupedFindingCount": 0, "topFindings": [1] * 30},
    "REVIEW": {"status": "complete", "reviewer": "agent", "targetUrl": "u", "sourceArtifacts": [1], "executiveSummary": "s", "finalAudit": PART, "searchIntent": PART, "agentSkills": PART, "strategicFindings": [{"id": "s", "evidence": LINK, "validation": [1]}], "copyRecommendations": [{"id": "c", "proposed": "p", "evidence": LINK, "safeToApply": True, "approvalState": "not_required"}]},
    "RETROSPECTIVE_INPUT": {"status": "ready", "targetUrl": "u", "sourceArtifacts": [1], "artifactInventory": [1], "dashboardQueues": {"nextBestFixes": [1] * 20}},
    "RETROSPECTIVE": {"status": "complete", "reviewer": "fixture", "targetUrl": "u", "sourceArtifacts": [1], "summary": "s", "evidence": [{"reportSection": "r"}], "ruleGaps": [LEARNING], "maintainerActions": [LEARNING]},
}
#: By contract: place, value put there, and the check that finds it at the path.
BREAKS = {
    "FINDING": [(("id",), "", "finding.id", "$.id"), (("title",), None, "finding.title", "$.title"), (("confidence",), "50", "finding.confidence", "$.confidence"), (("confidence",), -1, "finding.confidence", "$.confidence"), (("evidence",), [], "finding.evidence", "$.evidence"),
        (("impact",), "", "finding.impact", "$.impact"), (("rootCause",), "", "finding.rootCause", "$.rootCause"), (("recommendation",), 3, "finding.recommendation", "$.recommendation"), (("validation",), "v", "finding.validation", "$.validation"), (("affectedTemplates",), [], "finding.affected", "$.affectedUrls"),
        (("evidence", 0, "id"), "", "evidence.id", "$.evidence[0].id"), (("evidence", 0, "type"), None, "evidence.type", "$.evidence[0].type"), (("evidence", 0, "timestamp"), "", "evidence.timestamp", "$.evidence[0].timestamp")],
    "SCORE": [(("total",), 101, "score.total", "$.total"), (("categories",), [], "score.categories", "$.categories"), (("profiles", "core_seo", "score"), 49, "score.primary-profile", "$.profiles.core_seo.score"), (("profiles", "core_seo", "includedInPrimary"), False, "score.primary-profile", "$.profiles.core_seo.score"),
        (("coverage",), None, "score.coverage", "$.coverage.measuredRules"), (("coverage", "percentMeasured"), 101, "score.coverage", "$.coverage.measuredRules"), (("experimentalCombined",), "1", "score.experimental-separation", "$.experimentalCombined"), (("profiles", "agent_readiness", "includedInPrimary"), True, "score.experimental-separation", "$.experimentalCombined")],
    "PLAN": [(("phases",), [], "plan.phases", "$.phases"), (("approvalRequired",), "x", "plan.classification", "$.safeFixes")],
    "DASHBOARD": [(("targetUrl",), "", "dashboard.target", "$.targetUrl"), (("score", "total"), 100.5, "dashboard.score", "$.score.total"), (("implementationQueue",), None, "dashboard.queues", "$.implementationQueue"), (("impactEffortMatrix",), [1], "dashboard.matrix", "$.impactEffortMatrix"),
        (("performanceSummary", "metrics"), [], "dashboard.performance", "$.performanceSummary.metrics"), (("performanceSummary", "browserEvidence", "status"), "partial", "dashboard.browser-evidence", "$.performanceSummary.browserEvidence.status"), (("performanceSummary", "fieldData", "status"), "", "dashboard.field-data", "$.performanceSummary.fieldData.status"),
        (("evidenceStats", "groupedFindings"), -1, "dashboard.evidence", "$.evidenceStats.evidenceEntries"), (("agentReview",), None, "dashboard.agent-review", "$.agentReview.status"), (("nextBestFixes", 0, "findingId"), "", "dashboard.queue.q.finding", "$.nextBestFixes[0].findingId"), (("nextBestFixes", 0, "title"), "", "dashboard.queue.q.title", "$.nextBestFixes[0].title"),
        (("nextBestFixes", 0, "owner"), None, "dashboard.queue.q.owner", "$.nextBestFixes[0].owner"), (("nextBestFixes", 0, "validationCommand"), "", "dashboard.queue.q.validation", "$.nextBestFixes[0].validationCommand"), (("nextBestFixes", 0, "nextStep"), "", "dashboard.queue.q.next-step", "$.nextBestFixes[0].nextStep")],
    "REVIEW_INPUT": [(("status",), "x", "agent-review-input.status", "$.status"), (("targetUrl",), "", "agent-review-input.target", "$.targetUrl"), (("sourceArtifacts",), None, "agent-review-input.sources", "$.sourceArtifacts"), (("groupedFindingCount",), None, "agent-review-input.findings", "$.findingCount"), (("nextBestFixes",), [1] * 21, "agent-review-input.bounded", "$.topFindings")],
    "REVIEW": [(("status",), "x", "agent-review.status", "$.status"), (("reviewer",), None, "agent-review.reviewer", "$.reviewer"), (("targetUrl",), "", "agent-review.target", "$.targetUrl"), (("sourceArtifacts",), [], "agent-review.sources", "$.sourceArtifacts"), (("executiveSummary",), " ", "agent-review.summary", "$.executiveSummary"),
        (("finalAudit", "finalAuditMarkdown"), "", "agent-review.final-audit", "$.finalAudit.status"), (("searchIntent", "status"), "pending", "agent-review.search-intent", "$.searchIntent.status"), (("agentSkills", "evidence"), [], "agent-review.agent-skills", "$.agentSkills.status"), (("strategicFindings", 0, "evidence"), [{"url": " "}], "agent-review.finding.s.evidence", "$.strategicFindings[0].evidence"),
        (("strategicFindings", 0, "validation"), [], "agent-review.finding.s.validation", "$.strategicFindings[0].validation"), (("copyRecommendations", 0, "proposed"), "", "agent-review.copy.c.proposal", "$.copyRecommendations[0].proposed"), (("copyRecommendations", 0, "evidence"), [], "agent-review.copy.c.evidence", "$.copyRecommendations[0].evidence"),
        (("copyRecommendations", 0, "approvalState"), "approval_required", "agent-review.copy.c.approval-boundary", "$.copyRecommendations[0].approvalState")],
    "RETROSPECTIVE_INPUT": [(("status",), None, "workflow-retrospective-input.status", "$.status"), (("targetUrl",), "", "workflow-retrospective-input.target", "$.targetUrl"), (("artifactInventory",), [], "workflow-retrospective-input.sources", "$.sourceArtifacts"), (("dashboardQueues", "approvalQueue"), [1] * 81, "workflow-retrospective-input.bounded", "$.dashboardQueues.nextBestFixes")],
    "RETROSPECTIVE": [(("status",), "x", "workflow-retrospective.status", "$.status"), (("reviewer",), "x", "workflow-retrospective.reviewer", "$.reviewer"), (("targetUrl",), "", "workflow-retrospective.target", "$.targetUrl"), (("sourceArtifacts",), [], "workflow-retrospective.sources", "$.sourceArtifacts"), (("summary",), "", "workflow-retrospective.summary", "$.summary"),
        (("evidence",), [{"url": "u"}], "workflow-retrospective.evidence", "$.evidence"), (("reportUxGaps",), [LEARNING] * 51, "workflow-retrospective.bounded", "$.ruleGaps"), (("ruleGaps", 0, "title"), " ", "workflow-learning.l.title", "$.ruleGaps[0].title"), (("ruleGaps", 0, "summary"), None, "workflow-learning.l.summary", "$.ruleGaps[0].summary"),
        (("maintainerActions", 0, "evidence"), [], "workflow-learning.l.evidence", "$.maintainerActions[0].evidence"), (("ruleGaps", 0, "recommendation"), "", "workflow-learning.l.recommendation", "$.ruleGaps[0].recommendation"), (("ruleGaps", 0, "maintainerActionStatus"), "x", "workflow-learning.l.action-status", "$.ruleGaps[0].maintainerActionStatus")],
}


def broken(doc, place, value):
    out = json.loads(json.dumps(doc))
    at = out
    for p in place[:-1]:
        at = at[p]
    at[place[-1]] = value
    return out


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_each_break_is_found_at_its_path_and_nothing_else(spark, name):
    contract, doc = getattr(ct, name), WHOLE[name]
    rows = [(0, json.dumps(doc))] + [(i, json.dumps(broken(doc, p, v))) for i, (p, v, _, _) in enumerate(BREAKS[name], 1)]
    got = {}
    for r in ct.violations(spark.createDataFrame(rows, "k int, body string"), ["k"], "body", contract).collect():
        got.setdefault(r.k, set()).add((r.check_id, r.path))
    want = {i: {(c, p)} for i, (_, _, c, p) in enumerate(BREAKS[name], 1)}
    if name == "SCORE":  # a total out of bounds is not the profile's score either
        want[1].add(("score.primary-profile", "$.profiles.core_seo.score"))
    assert got == want
    # Every check of the contract is broken at least once above.
    told = {c for _, _, c, _ in BREAKS[name]}
    assert set(contract.checks) <= told and len(told) == len(contract.checks) + sum(len(g.checks) for g in contract.items)


def test_pending_documents_need_no_summary(spark):
    doc = {**WHOLE["REVIEW"], "status": "pending", "executiveSummary": "", "finalAudit": None, "searchIntent": None, "agentSkills": None, "strategicFindings": [], "copyRecommendations": None}
    assert ct.violations(spark.createDataFrame([(json.dumps(doc),)], "body string"), [], "body", ct.REVIEW).count() == 0


def test_odd_bodies_fail_all_checks_of_the_document(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "null"), (6, "3"), (7, '{"evidence": {"id": 1}}')]
    out = ct.contract_rows(spark.createDataFrame(rows, "check_id int, body string").withColumnRenamed("check_id", "k"), ["k"], "body", ct.FINDING)
    assert {(r.k, r.status) for r in out.collect()} == {(k, "failed") for k, _ in rows} and out.count() == 9 * len(rows)
    counted = {r.check_id: (r.passed, r.failed) for r in ct.counts(spark.createDataFrame(rows, "k int, body string"), "body", ct.FINDING).collect()}
    assert set(counted.values()) == {(0, len(rows))}
    assert ct.contract_rows(spark.createDataFrame([], "k int, body string"), ["k"], "body", ct.REVIEW).count() == 0
