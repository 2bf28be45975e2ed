"""Column-level building blocks: keyed randomness, scalar maths and array maths."""
