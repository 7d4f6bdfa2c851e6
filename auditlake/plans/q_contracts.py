"""Contract queries: documents made from rows of the given tables, with every check broken in some of them."""

from __future__ import annotations

from auditlake.operators import contracts as ct
from auditlake.plans import inputs
from auditlake.plans.registry import query

K = "CAST(k AS STRING)"


def _pick(cases: list[tuple[int, str]], other: str) -> str:
    """JSON text by the first divisor of k; texts are SQL expressions."""
    arms = " ".join(f"WHEN k % {n} = 0 THEN {text}" for n, text in cases)
    return f"CASE {arms} ELSE {other} END"


def _json(fields: dict[str, str]) -> str:
    """SQL expression of a JSON object from SQL expressions of its values' JSON."""
    parts = " || ',' || ".join(f"'\"{name}\":' || {text}" for name, text in fields.items())
    return f"'{{' || {parts} || '}}'"


def _doc(table: str, key: str, fields: dict[str, str], broken: int = 997) -> str:
    """SELECT of (k, body); one document in ``broken`` is no JSON."""
    return f"SELECT k, CASE WHEN k % {broken} = 0 THEN '{{' ELSE {_json(fields)} END AS body FROM (SELECT {key} AS k FROM {table})"


_S = lambda text: f"'\"{text}\"'"
_MANY = lambda n: "'[" + ",".join(["1"] * n) + "]'"
_EVIDENCE = """'[{"id":"e","type":"http","timestamp":"2024"}]'"""
FINDING_DOC = _doc("orders", "o_orderkey", {
    "id": _pick([(31, _S(""))], f"'\"F-' || {K} || '\"'"), "title": _pick([(29, _S("")), (37, "'null'")], _S("Missing title")),
    "confidence": _pick([(23, "'101'"), (19, "'null'"), (41, _S("50"))], "CAST(k % 101 AS STRING)"),
    "evidence": _pick([(17, "'[]'"), (13, """'[{"id":"","type":"x","timestamp":"t"},{"id":"e","type":"","timestamp":""}]'"""), (43, _S("x"))], _EVIDENCE),
    "impact": _pick([(47, _S(""))], _S("Pages are not found.")), "rootCause": _pick([(53, _S(""))], _S("No template.")),
    "recommendation": _pick([(59, "'null'")], _S("Add one.")), "validation": _pick([(61, "'[]'"), (67, _S("run"))], """'["run again"]'"""),
    "affectedUrls": _pick([(7, "'[]'")], """'["https://a.test/"]'"""), "affectedTemplates": _pick([(11, "'[]'")], """'["Blog"]'"""),
})
SCORE_DOC = _doc("customer", "c_custkey", {
    "total": _pick([(31, "'101'"), (29, "'null'")], "CAST(k % 100 AS STRING)"), "categories": _pick([(13, "'[]'")], "'[1]'"),
    "profiles": "'{\"core_seo\":{\"score\":' || " + _pick([(11, "'1000'")], "CAST(k % 100 AS STRING)") + " || ',\"includedInPrimary\":' || " + _pick([(17, "'false'")], "'true'")
    + " || '},\"agent_readiness\":{\"includedInPrimary\":' || " + _pick([(19, "'true'")], "'false'") + " || '}}'",
    "coverage": _pick([(23, "'null'"), (7, """'{"measuredRules":9,"applicableRules":8,"percentMeasured":50}'"""), (5, """'{"measuredRules":7,"applicableRules":8,"percentMeasured":100.5}'""")], """'{"measuredRules":7,"applicableRules":8,"percentMeasured":87.5}'"""),
    "experimentalCombined": _pick([(37, _S("40"))], "'40.5'"),
})
PLAN_DOC = _doc("supplier", "s_suppkey", {
    "phases": _pick([(7, "'[]'"), (11, "'null'")], "'[1]'"), "safeFixes": _pick([(5, "'null'")], "'[]'"), "approvalRequired": _pick([(9, _S("none"))], "'[]'"), "manualRecommendations": "'[]'",
})
_ITEM = lambda at: _json({
    "id": f"'\"{at}' || {K} || '\"'", "findingId": _pick([(11, _S(""))], _S("F")), "title": _pick([(13, _S(""))], _S("T")), "owner": _pick([(17, "'null'")], _S("seo")),
    "validationCommand": _pick([(19, _S(""))], _S("run")), "nextStep": _pick([(23, _S(""))], _S("do")),
})
DASHBOARD_DOC = _doc("part", "p_partkey", {
    "targetUrl": _pick([(29, _S(""))], _S("https://a.test")), "score": _pick([(31, """'{"total":-1}'""")], """'{"total":80}'"""), "nextBestFixes": f"'[' || {_ITEM('n')} || ']'",
    "implementationQueue": _pick([(37, "'null'"), (41, "'[]'")], f"'[' || {_ITEM('i')} || ',' || {_ITEM('j')} || ']'"), "approvalQueue": "'[]'", "impactEffortMatrix": _pick([(43, _MANY(3))], _MANY(4)),
    "performanceSummary": "'{\"metrics\":' || " + _pick([(47, "'[]'")], "'[1]'") + " || ',\"browserEvidence\":{\"status\":' || " + _pick([(7, _S("partial"))], _S("ok")) + " || '},\"fieldData\":{\"status\":' || " + _pick([(5, _S("partial")), (6, _S("broken"))], _S("ok")) + " || '}}'",
    "evidenceStats": _pick([(53, """'{"evidenceEntries":-1,"groupedFindings":0}'"""), (59, """'{"evidenceEntries":1}'""")], """'{"evidenceEntries":1,"groupedFindings":0}'"""),
    "agentReview": _pick([(61, "'null'")], """'{"status":"pending"}'"""),
})
REVIEW_INPUT_DOC = _doc("labels", "doc_id", {
    "status": _pick([(5, _S("pending"))], _S("ready")), "targetUrl": _pick([(7, _S(""))], _S("u")), "sourceArtifacts": _pick([(11, "'null'")], "'[1]'"), "findingCount": _pick([(13, "'-1'")], "'3'"),
    "groupedFindingCount": _pick([(17, "'null'")], "'2'"), "topFindings": _pick([(19, _MANY(31))], _MANY(30)), "nextBestFixes": _pick([(23, _MANY(21)), (3, "'null'")], _MANY(20)), "implementationQueue": "'[]'", "approvalQueue": _pick([(9, _MANY(81))], _MANY(80)),
})
_PART = lambda name, a, b, c: "'{\"status\":' || " + _pick([(a, _S("pending"))], _S("complete")) + f" || ',\"{name}\":' || " + _pick([(b, _S("  "))], _S("text")) + " || ',\"evidence\":' || " + _pick([(c, "'[]'")], "'[1]'") + " || '}'"
_LINKS = _pick([(7, "'[]'"), (11, """'[{"evidenceId":" "},{"url":"u"}]'"""), (13, "'[{}]'")], """'[{"findingId":"F","url":""},{"sourceArtifact":"a"}]'""")
REVIEW_DOC = _doc("documents", "doc_id", {
    "status": _pick([(5, _S("pending")), (31, _S("done"))], _S("complete")), "reviewer": _pick([(29, "'null'")], _S("agent")), "targetUrl": _pick([(23, _S(""))], _S("u")), "sourceArtifacts": _pick([(37, "'[]'")], "'[1]'"),
    "executiveSummary": _pick([(41, _S(" "))], _S("sum")), "finalAudit": _PART("finalAuditMarkdown", 43, 47, 53), "searchIntent": _PART("summary", 59, 61, 67), "agentSkills": _pick([(71, "'null'")], _PART("summary", 73, 79, 83)),
    "strategicFindings": f"""'[{{"id":"s' || {K} || '","evidence":' || {_LINKS} || ',"validation":' || {_pick([(17, "'[]'")], "'[1]'")} || '}}]'""",
    "copyRecommendations": f"""'[{{"id":"c","proposed":' || {_pick([(19, _S(" "))], _S("new"))} || ',"evidence":' || {_LINKS} || ',"safeToApply":' || {_pick([(3, "'true'")], "'false'")} || ',"approvalState":' || {_pick([(2, _S("approval_required"))], _S("not_required"))} || '}}]'""",
})
RETRO_INPUT_DOC = _doc("benchmark", "item_id", {
    "status": _pick([(5, _S("x"))], _S("ready")), "targetUrl": _pick([(7, "'null'")], _S("u")), "sourceArtifacts": _pick([(11, "'[]'")], "'[1]'"), "artifactInventory": _pick([(13, "'[]'")], "'[1]'"),
    "dashboardQueues": _pick([(3, "'null'"), (17, f"'{{\"nextBestFixes\":' || {_MANY(21)} || '}}'")], f"'{{\"implementationQueue\":' || {_MANY(80)} || '}}'"),
})
_LEARNING = f"""'{{"id":"l' || {K} || '","title":' || {_pick([(7, _S(" "))], _S("t"))} || ',"summary":' || {_pick([(11, "'null'")], _S("s"))} || ',"evidence":' || {_pick([(13, "'[]'"), (17, "'[{}]'")], '''\'[{"blockerId":"b"}]\'''')} || ',"recommendation":' || {_pick([(19, _S(""))], _S("r"))} || ',"maintainerActionStatus":' || {_pick([(23, _S("open"))], _S("accepted"))} || '}}'"""
RETRO_DOC = _doc("conversations", "conv_id * 10 + turn", {
    "status": _pick([(3, _S("pending")), (29, _S(""))], _S("complete")), "reviewer": _pick([(31, _S("human"))], _S("fixture")), "targetUrl": _pick([(37, _S(""))], _S("u")), "sourceArtifacts": _pick([(41, "'[]'")], "'[1]'"),
    "summary": _pick([(43, _S(" "))], _S("s")), "evidence": _pick([(47, "'[]'"), (53, """'[{"url":"u"}]'""")], """'[{"reportSection":"r"}]'"""),
    "ruleGaps": f"'[' || {_LEARNING} || ']'", "reportUxGaps": _pick([(59, _MANY(51))], "'[]'"), "agentFriction": "'null'", "maintainerActions": f"'[' || {_LEARNING} || ',' || {_LEARNING} || ']'",
})


# The same contracts as SQL over JSON: what a document has to satisfy, by check, with the path that is reported.
def _t(p: str, d: str = "body") -> str:
    """Text at a path if it is a string."""
    return f"CASE WHEN json_type({d}, '{p}') = 'VARCHAR' THEN json_extract_string({d}, '{p}') END"


def _n(p: str, d: str = "body") -> str:
    return f"CASE WHEN json_type({d}, '{p}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string({d}, '{p}') AS DOUBLE) END"


def _len(p: str, d: str = "body") -> str:
    return f"CASE WHEN json_type({d}, '{p}') = 'ARRAY' THEN json_array_length({d}, '{p}') END"


def _b(p: str, d: str = "body") -> str:
    return f"CASE WHEN json_type({d}, '{p}') = 'BOOLEAN' THEN json_extract_string({d}, '{p}') = 'true' END"


_text = lambda p, d="body": f"length({_t(p, d)}) > 0"
_words = lambda p, d="body": f"length(trim({_t(p, d)})) > 0"
_some = lambda p, d="body": f"({_len(p, d)}) > 0"
_in = lambda p, *v, d="body": f"({_t(p, d)}) IN ({', '.join(repr(x) for x in v)})"
_most = lambda p, n: f"coalesce(({_len(p)}) <= {n}, true)"
_done = lambda cond: f"(coalesce(({_t('$.status')}) <> 'complete', true) OR ({cond}))"


def _cites(p: str, anchors: tuple, d: str = "body") -> str:
    ok = " OR ".join(f"coalesce({_words(a, 'x')}, false)" for a in anchors)
    return f"({_some(p, d)} AND len(list_filter(json_extract({d}, '{p}[*]'), lambda x: NOT ({ok}))) = 0)"


def _part(p: str, text: str) -> str:
    return _done(f"{_in(p + '.status', 'complete')} AND {_words(p + '.' + text)} AND {_some(p + '.evidence')}")


_CITED = ("$.evidenceId", "$.findingId", "$.url", "$.sourceArtifact")
_LEARNED = ("$.sourceArtifact", "$.findingId", "$.evidenceId", "$.validationCheckId", "$.reportSection", "$.blockerId")
_W, _L = "agent-review", "workflow-retrospective"
FINDING_SQL = ({
    "finding.id": ("$.id", _text("$.id")), "finding.title": ("$.title", _text("$.title")), "finding.confidence": ("$.confidence", f"({_n('$.confidence')}) BETWEEN 0 AND 100"), "finding.evidence": ("$.evidence", _some("$.evidence")),
    "finding.impact": ("$.impact", _text("$.impact")), "finding.rootCause": ("$.rootCause", _text("$.rootCause")), "finding.recommendation": ("$.recommendation", _text("$.recommendation")), "finding.validation": ("$.validation", _some("$.validation")),
    "finding.affected": ("$.affectedUrls", f"coalesce({_some('$.affectedUrls')}, false) OR coalesce({_some('$.affectedTemplates')}, false)"),
}, [(["$.evidence"], {f"evidence.{f}": (f".{f}", _text(f"$.{f}", "it")) for f in ("id", "type", "timestamp")})])
SCORE_SQL = ({
    "score.total": ("$.total", f"({_n('$.total')}) BETWEEN 0 AND 100"), "score.categories": ("$.categories", _some("$.categories")),
    "score.primary-profile": ("$.profiles.core_seo.score", f"({_n('$.profiles.core_seo.score')}) = ({_n('$.total')}) AND {_b('$.profiles.core_seo.includedInPrimary')}"),
    "score.coverage": ("$.coverage.measuredRules", f"({_n('$.coverage.measuredRules')}) <= ({_n('$.coverage.applicableRules')}) AND ({_n('$.coverage.percentMeasured')}) BETWEEN 0 AND 100"),
    "score.experimental-separation": ("$.experimentalCombined", f"({_n('$.experimentalCombined')}) IS NOT NULL AND NOT ({_b('$.profiles.agent_readiness.includedInPrimary')})"),
}, [])
PLAN_SQL = ({
    "plan.phases": ("$.phases", _some("$.phases")),
    "plan.classification": ("$.safeFixes", " AND ".join(f"({_len(p)}) >= 0" for p in ("$.safeFixes", "$.approvalRequired", "$.manualRecommendations"))),
}, [])
_P = "$.performanceSummary"
DASHBOARD_SQL = ({
    "dashboard.target": ("$.targetUrl", _text("$.targetUrl")), "dashboard.score": ("$.score.total", f"({_n('$.score.total')}) BETWEEN 0 AND 100"), "dashboard.queues": ("$.implementationQueue", f"({_len('$.implementationQueue')}) >= 0"),
    "dashboard.matrix": ("$.impactEffortMatrix", f"({_len('$.impactEffortMatrix')}) = 4"), "dashboard.performance": (f"{_P}.metrics", _some(f"{_P}.metrics")),
    "dashboard.browser-evidence": (f"{_P}.browserEvidence.status", _in(f"{_P}.browserEvidence.status", "disabled", "ok", "unavailable", "failed")),
    "dashboard.field-data": (f"{_P}.fieldData.status", _in(f"{_P}.fieldData.status", "disabled", "ok", "partial", "unavailable", "failed")),
    "dashboard.evidence": ("$.evidenceStats.evidenceEntries", f"({_n('$.evidenceStats.evidenceEntries')}) >= 0 AND ({_n('$.evidenceStats.groupedFindings')}) >= 0"),
    "dashboard.agent-review": ("$.agentReview.status", _in("$.agentReview.status", "pending", "complete", "invalid")),
}, [(["$.nextBestFixes", "$.implementationQueue", "$.approvalQueue"], {f"dashboard.queue.{{id}}.{n}": (f".{f}", _text(f"$.{f}", "it")) for n, f in (("finding", "findingId"), ("title", "title"), ("owner", "owner"), ("validation", "validationCommand"), ("next-step", "nextStep"))})])
REVIEW_INPUT_SQL = ({
    f"{_W}-input.status": ("$.status", _in("$.status", "ready")), f"{_W}-input.target": ("$.targetUrl", _text("$.targetUrl")), f"{_W}-input.sources": ("$.sourceArtifacts", _some("$.sourceArtifacts")),
    f"{_W}-input.findings": ("$.findingCount", f"({_n('$.findingCount')}) >= 0 AND ({_n('$.groupedFindingCount')}) >= 0"),
    f"{_W}-input.bounded": ("$.topFindings", " AND ".join(_most(f"$.{p}", n) for p, n in (("topFindings", 30), ("nextBestFixes", 20), ("implementationQueue", 80), ("approvalQueue", 80)))),
}, [])
REVIEW_SQL = ({
    f"{_W}.status": ("$.status", _in("$.status", "pending", "complete", "invalid")), f"{_W}.reviewer": ("$.reviewer", _in("$.reviewer", "pending", "agent", "fixture")), f"{_W}.target": ("$.targetUrl", _text("$.targetUrl")), f"{_W}.sources": ("$.sourceArtifacts", _some("$.sourceArtifacts")),
    f"{_W}.summary": ("$.executiveSummary", _done(_words("$.executiveSummary"))), f"{_W}.final-audit": ("$.finalAudit.status", _part("$.finalAudit", "finalAuditMarkdown")), f"{_W}.search-intent": ("$.searchIntent.status", _part("$.searchIntent", "summary")), f"{_W}.agent-skills": ("$.agentSkills.status", _part("$.agentSkills", "summary")),
}, [
    (["$.strategicFindings"], {f"{_W}.finding.{{id}}.evidence": (".evidence", _cites("$.evidence", _CITED, "it")), f"{_W}.finding.{{id}}.validation": (".validation", _some("$.validation", "it"))}),
    (["$.copyRecommendations"], {f"{_W}.copy.{{id}}.proposal": (".proposed", _words("$.proposed", "it")), f"{_W}.copy.{{id}}.evidence": (".evidence", _cites("$.evidence", _CITED, "it")),
      f"{_W}.copy.{{id}}.approval-boundary": (".approvalState", f"NOT coalesce({_b('$.safeToApply', 'it')}, false) OR {_in('$.approvalState', 'not_required', d='it')}")}),
])
RETRO_INPUT_SQL = ({
    f"{_L}-input.status": ("$.status", _in("$.status", "ready")), f"{_L}-input.target": ("$.targetUrl", _text("$.targetUrl")), f"{_L}-input.sources": ("$.sourceArtifacts", f"{_some('$.sourceArtifacts')} AND {_some('$.artifactInventory')}"),
    f"{_L}-input.bounded": ("$.dashboardQueues.nextBestFixes", " AND ".join(_most(f"$.dashboardQueues.{p}", n) for p, n in (("nextBestFixes", 20), ("implementationQueue", 80), ("approvalQueue", 80)))),
}, [])
RETRO_SQL = ({
    f"{_L}.status": ("$.status", _in("$.status", "pending", "complete", "invalid")), f"{_L}.reviewer": ("$.reviewer", _in("$.reviewer", "pending", "agent", "fixture")), f"{_L}.target": ("$.targetUrl", _text("$.targetUrl")), f"{_L}.sources": ("$.sourceArtifacts", _some("$.sourceArtifacts")),
    f"{_L}.summary": ("$.summary", _done(_words("$.summary"))), f"{_L}.evidence": ("$.evidence", _done(_cites("$.evidence", _LEARNED))),
    f"{_L}.bounded": ("$.ruleGaps", " AND ".join(_most(f"$.{p}", n) for p, n in (("ruleGaps", 50), ("reportUxGaps", 50), ("agentFriction", 50), ("maintainerActions", 80)))),
}, [(["$.ruleGaps", "$.reportUxGaps", "$.agentFriction", "$.maintainerActions"], {
    "workflow-learning.{id}.title": (".title", _words("$.title", "it")), "workflow-learning.{id}.summary": (".summary", _words("$.summary", "it")), "workflow-learning.{id}.evidence": (".evidence", _cites("$.evidence", _LEARNED, "it")),
    "workflow-learning.{id}.recommendation": (".recommendation", _words("$.recommendation", "it")), "workflow-learning.{id}.action-status": (".maintainerActionStatus", _in("$.maintainerActionStatus", "proposed", "accepted", "rejected", "implemented", d="it")),
})])


def _rows_sql(doc: str, told: tuple) -> tuple[list[str], str]:
    """CTEs, and all (k, check_id, pattern, path, ok) of the documents."""
    own, items = told
    ctes = [f"raw AS ({doc})", "doc AS (SELECT k, CASE WHEN json_valid(body) THEN CAST(body AS JSON) ELSE CAST('null' AS JSON) END AS body FROM raw)"]
    parts = [f"SELECT k, '{name}' AS check_id, '{name}' AS pattern, '{path}' AS path, coalesce({cond}, false) AS ok FROM doc" for name, (path, cond) in own.items()]
    for g, (paths, checks) in enumerate(items):
        each = " UNION ALL ".join(
            f"SELECT k, '{p}[' || i || ']' AS base, json_extract(body, '{p}[' || i || ']') AS it FROM (SELECT k, body, unnest(range(CAST(coalesce({_len(p)}, 0) AS BIGINT))) AS i FROM doc)" for p in paths
        )
        ctes.append(f"it{g} AS ({each})")
        ident = f"coalesce({_t('$.id', 'it')}, '')"
        parts += [f"SELECT k, replace('{name}', '{{id}}', {ident}), '{name}', base || '{path}', coalesce({cond}, false) FROM it{g}" for name, (path, cond) in checks.items()]
    return ctes, " UNION ALL ".join(parts)


def _register(name: str, doc: str, contract: ct.Contract, told: tuple) -> None:
    ctes, rows = _rows_sql(doc, told)
    with_ = "WITH " + ",\n".join([*ctes, f"chk AS ({rows})"])

    def documents(spark, sf):
        source = doc.rsplit(" FROM ", 1)[1].rstrip(")")
        key = doc.rsplit("(SELECT ", 1)[1].split(" AS k")[0]
        keys = inputs.spread(inputs.table(spark, sf, source).selectExpr(f"{key} AS k"), "k")
        return keys.selectExpr("k", doc.split("SELECT k, ", 1)[1].rsplit(" FROM (SELECT", 1)[0])

    @query(f"{name}_violations", f"{with_} SELECT k, check_id, path FROM chk WHERE NOT ok")
    def violations(spark, sf):
        return ct.violations(documents(spark, sf), ["k"], "body", contract)

    @query(f"{name}_counts", f"{with_} SELECT pattern AS check_id, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM chk GROUP BY 1")
    def counts(spark, sf):
        return ct.counts(documents(spark, sf), "body", contract)


for _name, _docs, _contract, _told in (
    ("V1_finding_documents", FINDING_DOC, ct.FINDING, FINDING_SQL), ("V2_score_documents", SCORE_DOC, ct.SCORE, SCORE_SQL), ("V3_plan_documents", PLAN_DOC, ct.PLAN, PLAN_SQL),
    ("V3_dashboard_documents", DASHBOARD_DOC, ct.DASHBOARD, DASHBOARD_SQL), ("V9_review_inputs", REVIEW_INPUT_DOC, ct.REVIEW_INPUT, REVIEW_INPUT_SQL), ("V9_review_documents", REVIEW_DOC, ct.REVIEW, REVIEW_SQL),
    ("V10_retrospective_inputs", RETRO_INPUT_DOC, ct.RETROSPECTIVE_INPUT, RETRO_INPUT_SQL), ("V10_retrospective_documents", RETRO_DOC, ct.RETROSPECTIVE, RETRO_SQL),
):
    _register(_name, _docs, _contract, _told)
