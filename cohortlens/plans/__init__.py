"""Compositions of the operators into whole studies, and the registered queries."""
