"""Contracts of run documents: tables of constraints over VARIANT paths, compiled to one expression per document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Items:
    """Checks for every element of the arrays at ``paths``. ``{id}`` in a check's name stands for the element's id."""

    paths: tuple[str, ...]
    checks: dict[str, list[tuple]]


@dataclass(frozen=True)
class Contract:
    """Checks by name; a check is a list of constraints that must all hold. A constraint is (kind, path, arguments...), see
    ``holds``; the first one's path is reported."""

    checks: dict[str, list[tuple]]
    items: list[Items] = field(default_factory=list)


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _string(v: Column, path: str) -> Column:
    """Text at a path; null if it is no string."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    """Number at a path; null if it is none, also where a text spells one."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, path, "double"))


def holds(v: Column, constraint: tuple) -> Column:
    """Whether a document or element satisfies a constraint; what is missing or of another type doesn't.

    text: a string that isn't empty; words: one with more than white space; one_of: one of the given strings; between,
    least: a number in bounds; number: any; order: the number at the first path is at most that at the second; same: both
    are equal; some: an array that isn't empty; array: any array; size: one of so many; most: one of at most so many,
    missing ones count as empty; yes, no: that boolean; cites: a non-empty array whose elements each have a string with
    words at one of the given paths; any: one of the given constraints; when: if the string at the path is the given
    one, the rest holds; unless: if the boolean at the path is true, the rest holds."""
    kind, path, *args = constraint
    if kind == "text":
        ok = F.length(_string(v, path)) > 0
    elif kind == "words":
        ok = _string(v, path).rlike(r"\S")
    elif kind == "one_of":
        ok = _string(v, path).isin(*args)
    elif kind == "between":
        ok = _number(v, path).between(*args)
    elif kind == "least":
        ok = _number(v, path) >= args[0]
    elif kind == "number":
        ok = _number(v, path).isNotNull()
    elif kind == "order":
        ok = _number(v, path) <= _number(v, args[0])
    elif kind == "same":
        ok = _number(v, path) == _number(v, args[0])
    elif kind == "some":
        ok = F.size(_array(v, path)) > 0
    elif kind == "array":
        ok = _array(v, path).isNotNull()
    elif kind == "size":
        ok = F.size(_array(v, path)) == args[0]
    elif kind == "most":
        ok = _array(v, path).isNull() | (F.size(_array(v, path)) <= args[0])
    elif kind in ("yes", "no"):
        ok = F.try_variant_get(v, path, "boolean") == F.lit(kind == "yes")
    elif kind == "cites":
        anchored = lambda link: reduce(lambda a, b: a | b, [F.coalesce(holds(link, ("words", p)), F.lit(False)) for p in args])
        ok = (F.size(_array(v, path)) > 0) & F.forall(_array(v, path), anchored)
    elif kind == "any":
        ok = reduce(lambda a, b: a | b, [holds(v, c) for c in args])
    elif kind == "when":
        value, *rest = args
        ok = ~F.coalesce(_string(v, path) == value, F.lit(False)) | all_hold(v, rest)
    elif kind == "unless":
        ok = ~F.coalesce(F.try_variant_get(v, path, "boolean"), F.lit(False)) | all_hold(v, args)
    else:
        raise ValueError(f"no constraint {kind}")
    return F.coalesce(ok, F.lit(False))


def all_hold(v: Column, constraints: list[tuple]) -> Column:
    return reduce(lambda a, b: a & b, [holds(v, c) for c in constraints])


def _reported(constraint: tuple) -> str:
    """The path that a constraint is about: of one under a condition, that of the rest."""
    kind, path, *args = constraint
    if kind == "when":
        return _reported(args[1])
    if kind == "unless":
        return _reported(args[0])
    return args[0][1] if kind == "any" else path


def _element_results(path: str, checks: dict[str, list[tuple]]) -> Callable[[Column, Column], Column]:
    """For an element of the array at ``path`` and its place, the results of its checks."""

    def each(item: Column, i: Column) -> Column:
        ident = F.coalesce(_string(item, "$.id"), F.lit(""))
        at = lambda c: F.concat(F.lit(path + "["), i.cast("string"), F.lit("]" + _reported(c)[1:]))
        return F.array(*[
            F.struct(F.replace(F.lit(name), F.lit("{id}"), ident).alias("check_id"), at(cs[0]).alias("path"), all_hold(item, cs).alias("ok"))
            for name, cs in checks.items()
        ])

    return each


def results(v: Column, contract: Contract) -> Column:
    """array<struct<check_id, path, ok>> of a document: its own checks, then those of its elements."""
    own = F.array(*[F.struct(F.lit(name).alias("check_id"), F.lit(_reported(cs[0])).alias("path"), all_hold(v, cs).alias("ok")) for name, cs in contract.checks.items()])
    parts = [own]
    none = F.filter(own, lambda _: F.lit(False))
    for group in contract.items:
        parts += [F.coalesce(F.flatten(F.transform(_array(v, path), _element_results(path, group.checks))), none) for path in group.paths]
    return F.flatten(F.array(*parts))


def contract_rows(documents: DataFrame, keys: list[str], body: str, contract: Contract) -> DataFrame:
    """keys, check_id, path, status for every check of every document of ``documents``, whose ``body`` is JSON text. A body
    that doesn't parse fails all checks of the document itself. One narrow stage: a document never leaves its row."""
    parsed = documents.select(*keys, F.try_parse_json(body).alias("_v"))
    rows = parsed.select(*keys, F.explode(results(F.col("_v"), contract)).alias("r"))
    return rows.select(*keys, "r.check_id", "r.path", F.when(F.col("r.ok"), "passed").otherwise("failed").alias("status"))


def violations(documents: DataFrame, keys: list[str], body: str, contract: Contract) -> DataFrame:
    """keys, check_id, path of every check that a document breaks."""
    return contract_rows(documents, keys, body, contract).filter("status = 'failed'").drop("status")


def counts(documents: DataFrame, body: str, contract: Contract) -> DataFrame:
    """check_id, passed, failed over all documents, with the ids of elements taken out of the names."""
    rows = contract_rows(documents.select(body), [], body, contract)
    patterns = [n for g in contract.items for n in g.checks if "{id}" in n]
    name = F.col("check_id")
    for p in patterns:
        start, end = p.split("{id}")
        name = F.when(F.col("check_id").startswith(start) & F.col("check_id").endswith(end), F.lit(p)).otherwise(name)
    return rows.groupBy(name.alias("check_id")).agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"))


# Names, paths and bounds of the contracts.
_CITED = ("$.evidenceId", "$.findingId", "$.url", "$.sourceArtifact")
_LEARNED = ("$.sourceArtifact", "$.findingId", "$.evidenceId", "$.validationCheckId", "$.reportSection", "$.blockerId")

FINDING = Contract(
    {
        "finding.id": [("text", "$.id")],
        "finding.title": [("text", "$.title")],
        "finding.confidence": [("between", "$.confidence", 0, 100)],
        "finding.evidence": [("some", "$.evidence")],
        "finding.impact": [("text", "$.impact")],
        "finding.rootCause": [("text", "$.rootCause")],
        "finding.recommendation": [("text", "$.recommendation")],
        "finding.validation": [("some", "$.validation")],
        "finding.affected": [("any", "$", ("some", "$.affectedUrls"), ("some", "$.affectedTemplates"))],
    },
    [Items(("$.evidence",), {"evidence.id": [("text", "$.id")], "evidence.type": [("text", "$.type")], "evidence.timestamp": [("text", "$.timestamp")]})],
)
SCORE = Contract(
    {
        "score.total": [("between", "$.total", 0, 100)],
        "score.categories": [("some", "$.categories")],
        "score.primary-profile": [("same", "$.profiles.core_seo.score", "$.total"), ("yes", "$.profiles.core_seo.includedInPrimary")],
        "score.coverage": [("order", "$.coverage.measuredRules", "$.coverage.applicableRules"), ("between", "$.coverage.percentMeasured", 0, 100)],
        "score.experimental-separation": [("number", "$.experimentalCombined"), ("no", "$.profiles.agent_readiness.includedInPrimary")],
    }
)
PLAN = Contract(
    {
        "plan.phases": [("some", "$.phases")],
        "plan.classification": [("array", "$.safeFixes"), ("array", "$.approvalRequired"), ("array", "$.manualRecommendations")],
    }
)
DASHBOARD = Contract(
    {
        "dashboard.target": [("text", "$.targetUrl")],
        "dashboard.score": [("between", "$.score.total", 0, 100)],
        "dashboard.queues": [("array", "$.implementationQueue")],
        "dashboard.matrix": [("size", "$.impactEffortMatrix", 4)],
        "dashboard.performance": [("some", "$.performanceSummary.metrics")],
        "dashboard.browser-evidence": [("one_of", "$.performanceSummary.browserEvidence.status", "disabled", "ok", "unavailable", "failed")],
        "dashboard.field-data": [("one_of", "$.performanceSummary.fieldData.status", "disabled", "ok", "partial", "unavailable", "failed")],
        "dashboard.evidence": [("least", "$.evidenceStats.evidenceEntries", 0), ("least", "$.evidenceStats.groupedFindings", 0)],
        "dashboard.agent-review": [("one_of", "$.agentReview.status", "pending", "complete", "invalid")],
    },
    [
        Items(
            ("$.nextBestFixes", "$.implementationQueue", "$.approvalQueue"),
            {
                "dashboard.queue.{id}.finding": [("text", "$.findingId")],
                "dashboard.queue.{id}.title": [("text", "$.title")],
                "dashboard.queue.{id}.owner": [("text", "$.owner")],
                "dashboard.queue.{id}.validation": [("text", "$.validationCommand")],
                "dashboard.queue.{id}.next-step": [("text", "$.nextStep")],
            },
        )
    ],
)
REVIEW_INPUT = Contract(
    {
        "agent-review-input.status": [("one_of", "$.status", "ready")],
        "agent-review-input.target": [("text", "$.targetUrl")],
        "agent-review-input.sources": [("some", "$.sourceArtifacts")],
        "agent-review-input.findings": [("least", "$.findingCount", 0), ("least", "$.groupedFindingCount", 0)],
        "agent-review-input.bounded": [("most", "$.topFindings", 30), ("most", "$.nextBestFixes", 20), ("most", "$.implementationQueue", 80), ("most", "$.approvalQueue", 80)],
    }
)


def _section(path: str, text: str) -> tuple:
    return ("when", "$.status", "complete", ("one_of", f"{path}.status", "complete"), ("words", f"{path}.{text}"), ("some", f"{path}.evidence"))


REVIEW = Contract(
    {
        "agent-review.status": [("one_of", "$.status", "pending", "complete", "invalid")],
        "agent-review.reviewer": [("one_of", "$.reviewer", "pending", "agent", "fixture")],
        "agent-review.target": [("text", "$.targetUrl")],
        "agent-review.sources": [("some", "$.sourceArtifacts")],
        "agent-review.summary": [("when", "$.status", "complete", ("words", "$.executiveSummary"))],
        "agent-review.final-audit": [_section("$.finalAudit", "finalAuditMarkdown")],
        "agent-review.search-intent": [_section("$.searchIntent", "summary")],
        "agent-review.agent-skills": [_section("$.agentSkills", "summary")],
    },
    [
        Items(("$.strategicFindings",), {"agent-review.finding.{id}.evidence": [("cites", "$.evidence", *_CITED)], "agent-review.finding.{id}.validation": [("some", "$.validation")]}),
        Items(
            ("$.copyRecommendations",),
            {
                "agent-review.copy.{id}.proposal": [("words", "$.proposed")],
                "agent-review.copy.{id}.evidence": [("cites", "$.evidence", *_CITED)],
                "agent-review.copy.{id}.approval-boundary": [("unless", "$.safeToApply", ("one_of", "$.approvalState", "not_required"))],
            },
        ),
    ],
)
RETROSPECTIVE_INPUT = Contract(
    {
        "workflow-retrospective-input.status": [("one_of", "$.status", "ready")],
        "workflow-retrospective-input.target": [("text", "$.targetUrl")],
        "workflow-retrospective-input.sources": [("some", "$.sourceArtifacts"), ("some", "$.artifactInventory")],
        "workflow-retrospective-input.bounded": [("most", f"$.dashboardQueues.{q}", n) for q, n in (("nextBestFixes", 20), ("implementationQueue", 80), ("approvalQueue", 80))],
    }
)
RETROSPECTIVE = Contract(
    {
        "workflow-retrospective.status": [("one_of", "$.status", "pending", "complete", "invalid")],
        "workflow-retrospective.reviewer": [("one_of", "$.reviewer", "pending", "agent", "fixture")],
        "workflow-retrospective.target": [("text", "$.targetUrl")],
        "workflow-retrospective.sources": [("some", "$.sourceArtifacts")],
        "workflow-retrospective.summary": [("when", "$.status", "complete", ("words", "$.summary"))],
        "workflow-retrospective.evidence": [("when", "$.status", "complete", ("cites", "$.evidence", *_LEARNED))],
        "workflow-retrospective.bounded": [("most", "$.ruleGaps", 50), ("most", "$.reportUxGaps", 50), ("most", "$.agentFriction", 50), ("most", "$.maintainerActions", 80)],
    },
    [
        Items(
            ("$.ruleGaps", "$.reportUxGaps", "$.agentFriction", "$.maintainerActions"),
            {
                "workflow-learning.{id}.title": [("words", "$.title")],
                "workflow-learning.{id}.summary": [("words", "$.summary")],
                "workflow-learning.{id}.evidence": [("cites", "$.evidence", *_LEARNED)],
                "workflow-learning.{id}.recommendation": [("words", "$.recommendation")],
                "workflow-learning.{id}.action-status": [("one_of", "$.maintainerActionStatus", "proposed", "accepted", "rejected", "implemented")],
            },
        )
    ],
)
