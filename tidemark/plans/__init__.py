"""Registered queries, each with SQL that gives the same rows where SQL can."""
