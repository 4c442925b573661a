"""Which checks a review runs and in which order its stages come."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import fixed


@dataclass(frozen=True)
class Checks:
    coverage: bool = True
    verify: bool = True
    access_control: bool = True


@dataclass(frozen=True)
class ReviewOptions:
    scanners: frozenset[str] = frozenset({"semgrep", "sonarqube", "mcp", "ai"})
    enabled: frozenset[str] = frozenset({"semgrep", "sonarqube"})
    checks: Checks = field(default_factory=Checks)
    reviewers: int = 2
    selections: tuple[str, ...] = ()
    targeted: bool = False


def planned_stages(options: ReviewOptions) -> list[str]:
    """Stage names in order; a stage is dropped when what it needs is off."""
    ai, checks = "ai" in options.scanners, options.checks
    needs = {
        "semgrep": {"semgrep"} <= options.scanners & options.enabled,
        "sonarqube": {"sonarqube"} <= options.scanners & options.enabled,
        "mcp": "mcp" in options.scanners,
        "access_control": checks.access_control,
        "ai_plan": ai, "ai_review": ai, "ai_judge": ai, "ai_exploit": ai,
        "ai_coverage": ai and checks.coverage,
        "ai_access": ai and checks.access_control,
        "ai_verify": ai and checks.verify,
        "dast_access": False, "dast_active": False,
    }
    return [s for s in fixed.STAGES if needs.get(s, True)]
