"""keysift: hardcoded-secret scanning over tables of source changes and text."""

from keysift.operators.rules import Rule, RuleSet, default_rules
from keysift.plans.scan import ModelOptions, scan

__all__ = ["ModelOptions", "Rule", "RuleSet", "default_rules", "scan"]
