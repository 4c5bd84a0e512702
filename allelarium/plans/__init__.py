"""Whole analyses composed of operators, the command line and the registered queries."""
