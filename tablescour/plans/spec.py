"""Cleaning steps as dataclasses with a JSON form, checked before any plan is built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any, ClassVar

from tablescour.errors import CleanError
from tablescour.functions.patterns import NULL_WORDS

# Names of the JSON form.
TEXT_OPS = ("trim", "collapse_spaces", "lowercase", "uppercase", "title_case")
OPERATIONS = (*TEXT_OPS, "empty_to_null", "null_tokens_to_null", "normalize_date", "normalize_phone")
RULES = ("required", "email", "numeric_range", "string_length", "date", "regex", "allowed_values")
SPEC_VERSION = 1


def _bad(message: str, code: str = "invalid_pipeline", **details) -> CleanError:
    return CleanError(code, message, **details)


def _build(cls, raw: Any, what: str, code: str = "invalid_pipeline"):
    """Fill a dataclass from a JSON object; unknown and missing keys are errors."""
    if not isinstance(raw, dict):
        raise _bad(f"{what} must be an object.", code)
    known = {f.name for f in fields(cls)}
    unknown = sorted(set(raw) - known)
    if unknown:
        raise _bad(f"{what} has unknown key(s): {', '.join(unknown)}.", code, keys=unknown)
    try:
        return cls(**raw)
    except TypeError as error:
        raise _bad(f"{what} is incomplete: {error}.", code) from error


def _without_none(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _without_none(v) for k, v in value.items() if v is not None}
    if isinstance(value, (list, tuple)):
        return [_without_none(v) for v in value]
    return value


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    values: list[str] | None = None
    # For dates: two-digit years lie within 50 years of this one; None: the year of the run.
    reference_year: int | None = None

    def __post_init__(self):
        problem = self._problem()
        if problem:
            raise _bad(problem, "invalid_validation_rule", column=self.column, rule=self.rule)

    def _problem(self) -> str | None:
        if not isinstance(self.column, str) or not self.column:
            return "A rule needs a column name."
        if self.rule not in RULES:
            return f"Unsupported rule '{self.rule}'."
        for bound in (self.min_length, self.max_length):
            if bound is not None and bound < 0:
                return "Length bounds must not be negative."
        pairs = {
            "numeric_range": ("min", self.min, "max", self.max),
            "string_length": ("min_length", self.min_length, "max_length", self.max_length),
        }
        if self.rule in pairs:
            low_name, low, high_name, high = pairs[self.rule]
            if low is None and high is None:
                return f"{self.rule} needs '{low_name}' and/or '{high_name}'."
            if low is not None and high is not None and low > high:
                return f"'{low_name}' must not exceed '{high_name}'."
        if self.rule == "regex" and not self.pattern:
            return "regex needs a 'pattern'."
        if self.rule == "allowed_values" and not self.values:
            return "allowed_values needs a non-empty 'values' list."
        return None


@dataclass(frozen=True)
class ValidateConfig:
    rules: list[Rule]
    drop_invalid_rows: bool = False

    def __post_init__(self):
        if not self.rules:
            raise _bad("A validation takes one rule or more.", "invalid_validation_rule")

    @classmethod
    def parse(cls, raw: dict) -> ValidateConfig:
        if not isinstance(raw, dict) or not isinstance(raw.get("rules"), list):
            raise _bad("A validation needs a 'rules' list.", "invalid_validation_rule")
        rules = [
            r if isinstance(r, Rule) else _build(Rule, r, "Rule", "invalid_validation_rule")
            for r in raw["rules"]
        ]
        return cls(rules, bool(raw.get("drop_invalid_rows", False)))


@dataclass(frozen=True)
class ColumnOps:
    column: str
    operations: list[str]

    def __post_init__(self):
        if not isinstance(self.column, str) or not self.column:
            raise _bad("A column to normalize needs a name.")
        if not self.operations:
            raise _bad(f"Column '{self.column}' has no operations.")
        for name in self.operations:
            if name not in OPERATIONS:
                raise _bad(f"Unknown normalization op '{name}'.", "invalid_operation", operation=name)


@dataclass(frozen=True)
class NormalizeConfig:
    columns: list[ColumnOps]
    date_format: str = "%Y-%m-%d"
    day_first: bool = False
    null_tokens: list[str] = field(default_factory=lambda: list(NULL_WORDS))
    # Two-digit years lie within 50 years of this one; None means the year of the run.
    reference_year: int | None = None

    def __post_init__(self):
        if not self.columns:
            raise _bad("A normalize step takes one column or more.")

    @classmethod
    def parse(cls, raw: dict) -> NormalizeConfig:
        if not isinstance(raw, dict) or not isinstance(raw.get("columns"), list):
            raise _bad("A normalize step needs a 'columns' list.")
        columns = [
            c if isinstance(c, ColumnOps) else _build(ColumnOps, c, "Column operations")
            for c in raw["columns"]
        ]
        return _build(cls, {**raw, "columns": columns}, "Normalize config")


@dataclass(frozen=True)
class DedupeConfig:
    mode: str = "exact"
    columns: list[str] = field(default_factory=list)
    keep: str = "first"

    def __post_init__(self):
        if self.mode not in ("exact", "columns"):
            raise _bad(f"Unknown dedupe mode '{self.mode}'.")
        if self.keep not in ("first", "last"):
            raise _bad(f"Unknown keep '{self.keep}'.")

    @classmethod
    def parse(cls, raw: dict) -> DedupeConfig:
        return _build(cls, raw, "Dedupe config")


@dataclass(frozen=True)
class RenameConfig:
    rename: dict[str, str] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: dict) -> RenameConfig:
        return _build(cls, raw, "Rename config")


@dataclass(frozen=True)
class Step:
    CONFIGS: ClassVar[dict[str, type]] = {
        "validate": ValidateConfig,
        "normalize": NormalizeConfig,
        "dedupe": DedupeConfig,
        "rename": RenameConfig,
    }

    id: str
    type: str
    config: Any
    enabled: bool = True

    @classmethod
    def parse(cls, raw: dict) -> Step:
        step = _build(cls, raw, "Step")
        if not isinstance(step.id, str) or not step.id:
            raise _bad("A step needs an id.")
        config_type = cls.CONFIGS.get(step.type)
        if config_type is None:
            raise _bad(f"Unsupported step type '{step.type}'.", step_id=step.id)
        if isinstance(step.config, config_type):
            return step
        try:
            return cls(step.id, step.type, config_type.parse(step.config), bool(step.enabled))
        except CleanError as error:
            error.details.setdefault("step_id", step.id)
            error.details.setdefault("step_type", step.type)
            raise


def parse_steps(raw: Any) -> list[Step]:
    """Steps from JSON text, ``{"steps": [...]}``, or a list of dicts or steps."""
    if isinstance(raw, str):
        raw = json.loads(raw)
    if isinstance(raw, dict):
        raw = raw.get("steps")
    if not isinstance(raw, (list, tuple)) or not raw:
        raise _bad("A cleaning plan takes one step or more.")
    steps = [s if isinstance(s, Step) else Step.parse(s) for s in raw]
    seen: set[str] = set()
    for step in steps:
        if step.id in seen:
            raise _bad(
                f"Two steps share the id '{step.id}'.", "duplicate_pipeline_step", step_id=step.id
            )
        seen.add(step.id)
    return steps


def steps_to_dict(steps: list[Step]) -> dict:
    return {"version": SPEC_VERSION, "steps": [_without_none(asdict(s)) for s in steps]}
