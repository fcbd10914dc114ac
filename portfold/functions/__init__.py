"""Column expressions. Everything here stays inside whole-stage codegen; there are no Python UDFs."""
