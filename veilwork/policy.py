"""What to look for and what to do with it: a frozen description, read on the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from veilwork.constants import (
    ALERT_EVENT,
    CONTEXT_WINDOW,
    DEFAULT_STRATEGY,
    DEFAULT_THRESHOLD,
    REGEX_TYPES,
    SKIP_ACTION,
)
from veilwork.functions.columns import literal
from veilwork.functions.strategies import REVERSIBLE, Strategy, get_strategy


@dataclass(frozen=True)
class EntityRule:
    """A rule for one type; what is None is inherited from the policy."""

    enabled: bool = True
    strategy: str | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class AlertRoute:
    url: str
    events: tuple[str, ...] = (ALERT_EVENT,)


@dataclass(frozen=True)
class Policy:
    """Defaults, rules and switches of a scan.

    ``detectors`` are further detectors: each takes the SQL of the text and gives
    the SQL of an array with the fields entity_type, start, end, text, confidence.
    ``strategies`` are further (or reconfigured) masking strategies.
    """

    default_strategy: str = DEFAULT_STRATEGY
    default_threshold: float = DEFAULT_THRESHOLD
    entity_rules: Mapping[str, EntityRule] = field(default_factory=dict)
    source_actions: Mapping[str, str] = field(default_factory=dict)
    types: tuple[str, ...] = REGEX_TYPES
    use_regex: bool = True
    use_ner: bool = False
    use_context: bool = True
    use_reversible: bool = False
    context_window: int = CONTEXT_WINDOW
    dry_run: bool = False
    strategies: tuple[Strategy, ...] = ()
    detectors: tuple[Callable[[str], str], ...] = ()

    def __post_init__(self) -> None:
        rules = {kind.upper(): rule for kind, rule in self.entity_rules.items()}
        object.__setattr__(self, "entity_rules", rules)
        for name in {self.default_strategy, *(self.rule_strategy(k) for k in rules)}:
            get_strategy(name, self.strategies)

    def rule_strategy(self, kind: str) -> str:
        return self.entity_rules[kind].strategy or self.default_strategy

    def skipped_sources(self) -> list[str]:
        return [s for s, action in self.source_actions.items() if action == SKIP_ACTION]

    def scans(self, source: str) -> str:
        """SQL: is a text of this source scanned at all?"""
        skipped = self.skipped_sources()
        if not skipped:
            return "true"
        return f"{source} not in ({', '.join(literal(s) for s in skipped)})"

    def keeps(self, kind: str, confidence: str) -> str:
        """SQL: does a detection survive its type's switch and threshold?"""
        cases = []
        for name, rule in self.entity_rules.items():
            limit = self.default_threshold if rule.threshold is None else rule.threshold
            test = f"{confidence} >= {literal(float(limit))}" if rule.enabled else "false"
            cases.append(f"when {literal(name)} then {test}")
        default = f"{confidence} >= {literal(float(self.default_threshold))}"
        return f"case {kind} {' '.join(cases)} else {default} end" if cases else default

    def fallback_strategy(self) -> Strategy:
        """For types without a rule of their own."""
        if self.use_reversible:
            return REVERSIBLE
        return get_strategy(self.default_strategy, self.strategies)

    def _by_type(self) -> dict[str, Strategy]:
        return {
            kind: get_strategy(self.rule_strategy(kind), self.strategies)
            for kind in self.entity_rules
        }

    def strategy_name(self, kind: str) -> str:
        """SQL: the name of the strategy for a type."""
        fallback = literal(self.fallback_strategy().name)
        cases = [f"when {literal(k)} then {literal(s.name)}" for k, s in self._by_type().items()]
        return f"case {kind} {' '.join(cases)} else {fallback} end" if cases else fallback

    def replacement(self, kind: str, text: str) -> str:
        """SQL: the replacement, null where a table has to give it."""
        forms = {
            s.name: s.form(kind, text) if s.form else "cast(null as string)"
            for s in (self.fallback_strategy(), *self._by_type().values())
        }
        if len(forms) == 1:
            return next(iter(forms.values()))
        cases = [f"when {literal(name)} then {form}" for name, form in forms.items()]
        return f"case {self.strategy_name(kind)} {' '.join(cases)} end"

    def strategies_in_use(self) -> list[Strategy]:
        return [self.fallback_strategy(), *self._by_type().values()]

    def needs_tables(self) -> bool:
        """Does some replacement depend on other texts, or on what SQL lacks?"""
        return not self.dry_run and any(s.form is None for s in self.strategies_in_use())

    def without_tokens(self) -> Policy:
        """The policy when there is no key for reversible tokens."""
        return replace(self, use_reversible=False) if self.use_reversible else self

    def uses(self, strategy: str) -> bool:
        names = {self.fallback_strategy().name, *(s.name for s in self._by_type().values())}
        return strategy in names
