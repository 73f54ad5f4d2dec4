"""Column builders. Everything here stays inside whole-stage code generation."""
