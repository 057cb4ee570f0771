"""Commands and queries composed of the operators."""
