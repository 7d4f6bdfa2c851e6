"""Imports every query module so that the registry is complete."""

from auditlake.plans import q_pages  # noqa: F401
from auditlake.plans import q_sites  # noqa: F401
from auditlake.plans import q_scores  # noqa: F401
from auditlake.plans import q_field  # noqa: F401
from auditlake.plans import q_rules  # noqa: F401
from auditlake.plans import q_compare  # noqa: F401
from auditlake.plans import q_contracts  # noqa: F401
from auditlake.plans import q_lake  # noqa: F401
from auditlake.plans import q_evidence  # noqa: F401
