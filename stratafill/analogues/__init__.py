"""The operators on order, line item, part, customer and event tables, with SQL to compare."""
