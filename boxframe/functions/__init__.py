"""Column functions: geometry, tokens, grammar, arrays of numbers, schedules."""
