"""Plan choices: lowering rules to expressions that Catalyst sees."""
