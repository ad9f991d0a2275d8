"""Whole-table queries over the driver tables, each with its plain-SQL statement where SQL can say it."""
